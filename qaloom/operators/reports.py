"""Severity, failure texts, report rows and documents, run status, report events.

`mode="observed"` follows what the source system does, `mode="intended"` what its documentation says:
- severity: observed looks for a verdict that is never produced, so visual issues are always 0; intended uses needs_review;
- stored status: observed 'analyzing', intended 'completed';
- critical_count and warning_count: observed keep the column default 0, intended store the computed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from qaloom.functions import templates as t
from qaloom.functions.ids import stable_id
from qaloom.functions.text import key_path, or_none, render
from qaloom.operators.runs import failed
from qaloom.operators.skew import first_n

DEFAULT_ENDPOINT = "http://localhost:4566"
ARTIFACTS = "artifacts"


def _check(mode: str) -> bool:
    if mode not in ("observed", "intended"):
        raise ValueError(f"mode must be 'observed' or 'intended', not {mode!r}")
    return mode == "intended"


def visual_issue(diff: dict[str, Column], mode: str) -> Column:
    return F.coalesce(diff["needs_review"], F.lit(False)) if _check(mode) else diff["verdict"] == "needs_review"


# --- severity ----------------------------------------------------------------------------------------------------
#
# facts: one wide row per (run, attempt) with the outcome (passed, error, error_context, ...) and, where a comparison
# was made, the diff (page, difference_percent, verdict, needs_review). An attempt has exactly one result and at most one
# diff, so everything below is a column of that row and needs no shuffle.


def _failure_line() -> Column:
    return F.concat(
        F.lit("- "), or_none(F.col("error")), F.lit(" (context: "), or_none(F.col("error_context")), F.lit(")")
    )


def failure_details(facts: DataFrame) -> DataFrame:
    """The failure line of every failed attempt: run_id, attempt, details. Nulls read 'None'."""
    return facts.filter(failed(F.col("passed"))).select("run_id", "attempt", _failure_line().alias("details"))


def severity(failures: Column, issues: Column) -> Column:
    return F.when((failures == 0) & (issues == 0), "info").when(failures > 0, "critical").otherwise("warning")


def with_severity(facts: DataFrame, mode: str = "observed") -> DataFrame:
    """Add failures, visual_issues, severity and the fixed recommendation of clean attempts."""
    issue = visual_issue({"verdict": F.col("verdict"), "needs_review": F.col("needs_review")}, mode)
    return (
        facts.withColumns({
            "failures": failed(F.col("passed")).cast("bigint"),
            "visual_issues": F.coalesce(issue, F.lit(False)).cast("bigint"),
        })
        .withColumn("severity", severity(F.col("failures"), F.col("visual_issues")))
        .withColumn("recommendation", F.when(F.col("severity") == "info", t.CLEAN_RECOMMENDATION))
    )


def analysis_requests(facts: DataFrame) -> DataFrame:
    """Prompts for an external reviewer, only for attempts with something to explain. facts with severity."""
    details = F.when(failed(F.col("passed")), _failure_line()).otherwise("")
    text = render(t.ANALYSIS_PROMPT, failure_details=details, visual_issues=F.col("visual_issues"))
    return facts.filter(F.col("severity") != "info").select("run_id", "attempt", text.alias("prompt"))


def newest_answers(answers: DataFrame) -> DataFrame:
    """The last answer to each request: kind, run_id, attempt, answer. answers adds answered_at; of two answers of one moment the larger
    text counts, so that a rerun takes the same one."""
    last = first_n(answers, ["kind", "run_id", "attempt"], [F.desc("answered_at"), F.desc("answer")])
    return last.select("kind", "run_id", "attempt", "answer")


def answer_ledger(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Every request and every answer once: kind, run_id, attempt, state, answer.

    asked: kind, run_id, attempt. A request is `open` until an answer comes and `answered` then; an answer to nothing that was asked is
    `unasked` and reaches no report.
    """
    key = ["kind", "run_id", "attempt"]
    requests = asked.select(*key).distinct().withColumn("_asked", F.lit(True))
    rows = requests.join(newest_answers(answers).withColumn("_answered", F.lit(True)), key, "full")
    state = F.when(F.col("_asked").isNull(), "unasked").when(F.col("_answered").isNull(), "open").otherwise("answered")
    return rows.select(*key, state.alias("state"), "answer")


def with_analysis(severities: DataFrame, answers: DataFrame) -> DataFrame:
    """Join the reviewer's answers: root_cause and recommendation; clean attempts keep the fixed text."""
    return (
        severities.join(answers.select("run_id", "attempt", "answer"), ["run_id", "attempt"], "left")
        .withColumn("root_cause", F.when(F.col("severity") != "info", F.col("answer")))
        .withColumn("recommendation", F.coalesce("recommendation", "answer"))
        .drop("answer")
    )


def refreshed(reports: DataFrame, facts: DataFrame, answers: DataFrame, build) -> DataFrame:
    """Reports after a batch of answers: those of attempts that were answered are built anew from their facts, the rest stay.

    reports: run_id, attempt and what `build(facts)` returns; facts: the wide rows, with earlier and new answers joined.
    """
    key = ["run_id", "attempt"]
    touched = answers.select(*key).distinct()
    return reports.join(touched, key, "left_anti").unionByName(build(facts.join(touched, key, "left_semi")))


# --- report rows -------------------------------------------------------------------------------------------------


def report_summary(facts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tests run, passed, failed, diffs to review."""
    ok = F.coalesce("passed", F.lit(False))
    return facts.groupBy(*(by or ["run_id"])).agg(
        F.count(F.lit(1)).alias("tests"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"),
        F.count_if("needs_review").alias("diffs"),
    )


def report_key(tenant: Column, project: Column, run: Column) -> Column:
    return key_path(tenant, project, run, "report.html")


def report_rows(
    severities: DataFrame, runs: DataFrame, mode: str = "observed", endpoint: str = DEFAULT_ENDPOINT, bucket: str = ARTIFACTS
) -> DataFrame:
    """Rows for the reports table, one per attempt, in its declared column order without created_at."""
    intended = _check(mode)
    key = report_key(F.col("tenant_id"), F.col("project_id"), F.col("run_id"))
    flag = lambda s: (F.col("severity") == s).cast("int") if intended else F.lit(0)
    return severities.join(runs.select("run_id", "tenant_id", "project_id"), "run_id").select(
        stable_id(F.col("run_id"), F.col("attempt")).alias("id"),
        "tenant_id", "project_id", "run_id", "attempt",
        F.lit("completed" if intended else "analyzing").alias("status"),
        F.coalesce("severity", F.lit("info")).alias("severity"),
        key_path(endpoint, bucket, key).alias("report_url"),
        key.alias("s3_path"),
        F.lit("html").alias("format"),
        flag("critical").alias("critical_count"),
        flag("warning").alias("warning_count"),
    )


def severity_counts(reports: DataFrame, by: list[str]) -> DataFrame:
    """Critical and warning reports per group, from the severity and not from the stored counters."""
    return reports.groupBy(*by).agg(
        F.count_if(F.col("severity") == "critical").alias("critical_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
    )


PENDING = "pending"  # a report that no answer of the model has reached yet never claims success


def label(c: Column) -> Column:
    return F.upper(F.replace(c, F.lit("_"), F.lit(" ")))


def report_fragments(
    facts: DataFrame, timestamp: str, mode: str = "observed", endpoint: str = DEFAULT_ENDPOINT, bucket: str = ARTIFACTS
) -> DataFrame:
    """Report content as ordered text lines: run_id, attempt, section, ord, line.

    facts with severity, plus url, the artifact keys, console_text and, where a reviewer answered, ai_analysis. The
    lines of a report come out of its own row.
    `timestamp` is a job parameter: a rerun writes the same report.
    """
    return facts.select("run_id", "attempt", F.posexplode(_sections(facts, timestamp, mode, endpoint, bucket)).alias("section", "l")).select(
        "run_id", "attempt", "section", F.posexplode("l").alias("ord", "line")
    )


def report_documents(
    facts: DataFrame, timestamp: str, mode: str = "observed", endpoint: str = DEFAULT_ENDPOINT, bucket: str = ARTIFACTS
) -> DataFrame:
    """The same lines as one text per (run, attempt): body."""
    body = F.array_join(F.flatten(_sections(facts, timestamp, mode, endpoint, bucket)), "\n")
    return facts.select("run_id", "attempt", body.alias("body"))


def _sections(facts: DataFrame, timestamp: str, mode: str, endpoint: str, bucket: str) -> Column:
    ok = F.coalesce("passed", F.lit(False))
    text = lambda name, c: F.concat(F.lit(f"{name}: "), c.cast("string"))
    link = lambda name, c: F.concat(F.lit(f"{name}: {endpoint}/{bucket}/"), F.nullif(F.col(c), F.lit("")))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    error = F.nullif(F.col("error"), F.lit(""))
    compared = F.col("verdict").isNotNull()
    lines = [
        [
            text("Run ID", F.col("run_id")),
            F.lit("Status: " + ("COMPLETED" if _check(mode) else "ANALYZING")),
            text("URL", F.coalesce("url", F.lit("Unknown"))),
            F.lit(f"Executed: {timestamp}"),
        ],
        [
            F.concat(F.col("url"), F.when(ok, " ✓ PASSED").otherwise(" ✗ FAILED")),
            text("Error", error),
            F.when(error.isNotNull(), text("Context", F.nullif(F.col("error_context"), F.lit("")))),
            link("Screenshot", "screenshot_s3_path"), link("DOM", "dom_s3_path"), F.col("console_text"),
        ],
        [
            F.when(compared, F.col("page")),
            F.concat(text("Pixel Difference", F.col("difference_percent")), F.lit("%")), label(F.col("verdict")),
            text("AI Analysis", F.nullif(F.col("ai_analysis"), F.lit("")))
            if "ai_analysis" in facts.columns else F.lit(None).cast("string"),
        ],
        [text("Recommendation", F.when(F.coalesce("severity", F.lit("info")) == "info", F.coalesce("recommendation", F.lit(t.REPORT_RECOMMENDATION)))
              .otherwise(F.coalesce("recommendation", F.lit(PENDING))))],
        [
            text("Severity Level", F.upper(F.coalesce("severity", F.lit("info")))), F.lit("Tests Run: 1"),
            text("Passed", flag(ok)), text("Failed", flag(~ok)), text("Visual Diffs", flag(F.col("needs_review"))),
        ],
    ]
    return F.array(*[F.filter(F.array(*part), lambda x: x.isNotNull()) for part in lines])


# --- events ------------------------------------------------------------------------------------------------------


def to_event(*fields: tuple[str, Column]) -> Column:
    """JSON text of an event; missing values are written as null."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields]), {"ignoreNullFields": "false"})


def report_events(finished: DataFrame, crashed: DataFrame, max_attempts: int = 3) -> DataFrame:
    """report.ready events. finished: run_id, tenant_id, project_id, attempt, severity, report_url, correlation_id.
    crashed adds error, error_type. A crash event has no attempts_total and no report."""
    text = lambda c: F.col(c).cast("string")
    base = [
        ("eventType", F.lit("report.ready")), ("tenantId", text("tenant_id")), ("projectId", text("project_id")),
        ("runId", text("run_id")),
    ]
    normal = to_event(
        *base, ("reportUrl", F.col("report_url")), ("severity", F.col("severity")),
        ("correlationId", F.col("correlation_id")), ("attempt", F.col("attempt")), ("attempts_total", F.lit(max_attempts)),
    )
    crash = to_event(
        *base, ("reportUrl", F.lit(None).cast("string")), ("severity", F.lit("critical")), ("error", F.col("error")),
        ("error_type", F.col("error_type")), ("correlationId", F.col("correlation_id")), ("attempt", F.col("attempt")),
    )
    return finished.select("run_id", normal.alias("value")).unionByName(crashed.select("run_id", crash.alias("value")))


# --- lookups and updates -----------------------------------------------------------------------------------------


def last_report(reports: DataFrame) -> DataFrame:
    """One report per run: the last attempt."""
    return first_n(reports, ["run_id"], [F.desc("attempt"), "id"])


def run_status(requested: DataFrame, runs: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, not_found) for requested run ids. found: the run row and its report columns or nulls."""
    ids = requested.select("run_id").distinct()
    found = runs.join(ids, "run_id", "left_semi").join(
        last_report(reports).select("run_id", "s3_path", "critical_count", "warning_count"), "run_id", "left"
    )
    missing = ids.join(runs.select("run_id"), "run_id", "left_anti").withColumn("error", F.lit("run not found"))
    return found, missing


def apply_run_updates(runs: DataFrame, updates: DataFrame, order: str = "attempt") -> DataFrame:
    """runs with status and completed_at replaced where an update exists; the last update of a run wins.
    updates: run_id, status, completed_at and an order column."""
    last = updates.groupBy("run_id").agg(
        F.max_by(F.struct("status", "completed_at"), order).alias("_u")
    )
    return (
        runs.join(last, "run_id", "left")
        .withColumn("status", F.coalesce("_u.status", "status"))
        .withColumn("completed_at", F.coalesce("_u.completed_at", "completed_at"))
        .drop("_u")
    )
