"""Queries for severity, reports, events and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaloom.functions import templates as t
from qaloom.operators import reports, runs, visual
from qaloom.plans.execution import _ARTIFACTS, CLASSIFIED, TOP, effective, explained, with_artifacts, with_run
from qaloom.plans.registry import CHECKS, filled, query, quoted
from qaloom.plans.views import view, with_views
from qaloom.session import written

STAMP = "2024-02-01 00:00:00 UTC"

# results = effective attempts that did not crash; diffs only for passed ones
_RESULTS = CLASSIFIED + "," + _ARTIFACTS + """,
results AS (SELECT k.*, r.url FROM keyed k JOIN fx_runs r USING (run_id) WHERE pipeline_error IS NULL),
measured AS (SELECT run_id, attempt, url AS page, round((CAST(1.0 AS DOUBLE) - (CAST(1.0 AS DOUBLE) - tax)) * 100, 2) AS difference_percent FROM results WHERE passed),
diffs AS (SELECT *, CASE WHEN difference_percent < 1.0 THEN 'no_change' WHEN difference_percent < 5.0 THEN 'minor_change' ELSE 'significant_change' END AS verdict,
  difference_percent >= 1.0 AS needs_review, CASE WHEN difference_percent < 5.0 THEN 'info' ELSE 'warning' END AS diff_severity,
  difference_percent >= 1.0 AND difference_percent > 2.0 AS ask_model FROM measured),"""


def _severity_ctes(mode: str) -> str:
    issue = "d.needs_review" if mode == "intended" else "d.verdict = 'needs_review'"
    return _RESULTS + f"""
counted AS (SELECT r.run_id, r.attempt, count(*) FILTER (NOT r.passed) AS failures,
  count(*) FILTER (coalesce({issue}, false)) AS visual_issues
  FROM results r LEFT JOIN diffs d USING (run_id, attempt) GROUP BY r.run_id, r.attempt),
sev AS (SELECT *, CASE WHEN failures = 0 AND visual_issues = 0 THEN 'info' WHEN failures > 0 THEN 'critical' ELSE 'warning' END AS severity FROM counted),
reported AS (SELECT s.*, r.tenant_id, r.project_id, concat_ws('/', r.tenant_id, r.project_id, s.run_id, 'report.html') AS s3_path,
  sha256(concat_ws('|', s.run_id, s.attempt)) AS id FROM sev s JOIN fx_runs r USING (run_id))"""


def outcomes(spark, d):
    """Effective attempts that did not crash, with the diff of the passed ones: the wide row, without texts."""
    eff = effective(spark, d).filter("pipeline_error is null")
    compared = runs.route(eff).withColumn("score", F.when(F.col("route") == "visual_analysis", F.lit(1.0) - F.col("tax")))
    return visual.verdict(compared.drop("tax", "route"))


def with_page(spark, d, facts):
    return with_run(spark, d, facts).withColumn("page", F.col("url"))


def explained_outcomes(spark, d):
    return explained(spark, d, with_page(spark, d, outcomes(spark, d)))


@query("verdict", with_views("""
SELECT run_id, attempt, page, difference_percent, verdict, needs_review, diff_severity, ask_model FROM diffs""",
    _RESULTS.rstrip(",")))
def verdict(spark, d):
    return with_page(spark, d, outcomes(spark, d).filter("score is not null")).select(
        "run_id", "attempt", "page", "difference_percent", "verdict", "needs_review", "diff_severity", "ask_model")


@query("visual_requests", with_views(
    f"SELECT run_id, attempt, {filled(t.VISUAL_PROMPT, page_url='page', difference_percent='difference_percent')} AS prompt FROM diffs WHERE ask_model",
    _RESULTS.rstrip(",")))
def visual_requests(spark, d):
    return visual.visual_requests(with_page(spark, d, outcomes(spark, d).filter("ask_model"))).select("run_id", "attempt", "prompt")


def severities(spark, d, mode="observed"):
    return reports.with_severity(outcomes(spark, d), mode)


for _mode, _suffix in (("observed", ""), ("intended", "_intended")):

    @query("run_severity" + _suffix, with_views(f"""
SELECT run_id, attempt, failures, visual_issues, severity,
  CASE WHEN severity = 'info' THEN '{t.CLEAN_RECOMMENDATION}' END AS recommendation FROM sev""", _severity_ctes(_mode)))
    def run_severity(spark, d, mode=_mode):
        return severities(spark, d, mode).select(
            "run_id", "attempt", "failures", "visual_issues", "severity", "recommendation")

    @query("report_rows" + _suffix, with_views(f"""
SELECT id, tenant_id, project_id, run_id, attempt, '{"completed" if _mode == "intended" else "analyzing"}' AS status, severity,
  concat('http://localhost:4566/artifacts/', s3_path) AS report_url, s3_path, 'html' AS format,
  CAST({"severity = 'critical'" if _mode == "intended" else "0"} AS INT) AS critical_count,
  CAST({"severity = 'warning'" if _mode == "intended" else "0"} AS INT) AS warning_count FROM reported""", _severity_ctes(_mode)))
    def report_rows(spark, d, mode=_mode):
        return reports.report_rows(severities(spark, d, mode), view(spark, d, "fx_runs"), mode)

    @query("severity_counts" + _suffix, with_views("""
SELECT tenant_id, project_id, count(*) FILTER (severity = 'critical') AS critical_count,
  count(*) FILTER (severity = 'warning') AS warning_count FROM reported GROUP BY tenant_id, project_id""", _severity_ctes(_mode)))
    def severity_counts(spark, d, mode=_mode):
        return reports.severity_counts(report_rows(spark, d, mode), ["tenant_id", "project_id"])


_DETAILS = """
SELECT run_id, attempt, concat('- ', coalesce(error, 'None'), ' (context: ', coalesce(error_context, 'None'), ')') AS details
FROM results WHERE NOT passed"""


@query("failure_details", with_views(_DETAILS, _RESULTS.rstrip(",")))
def failure_details(spark, d):
    return reports.failure_details(explained_outcomes(spark, d))


@query("analysis_requests", with_views(f"""
SELECT s.run_id, s.attempt, {filled(t.ANALYSIS_PROMPT, failure_details="coalesce(x.details, '')", visual_issues="s.visual_issues")} AS prompt
FROM sev s LEFT JOIN ({_DETAILS}) x USING (run_id, attempt) WHERE s.severity <> 'info'""", _severity_ctes("intended")))
def analysis_requests(spark, d):
    return reports.analysis_requests(reports.with_severity(explained_outcomes(spark, d), "intended"))


# --- answers of the model ----------------------------------------------------------------------------------------

ANSWERS = """
newest AS (SELECT kind, run_id, attempt, answer FROM fx_answers
  QUALIFY row_number() OVER (PARTITION BY kind, run_id, attempt ORDER BY answered_at DESC, answer DESC) = 1),
analyses AS (SELECT run_id, attempt, answer FROM newest WHERE kind = 'analysis'),
reviews AS (SELECT n.run_id, n.attempt, n.answer FROM newest n JOIN diffs USING (run_id, attempt) WHERE kind = 'review' AND ask_model)"""


def answers(spark, d, kind):
    return reports.newest_answers(view(spark, d, "fx_answers").filter(F.col("kind") == kind))


def asked(facts):
    """Requests that the model got: analyses of attempts that are not clean, reviews of larger differences."""
    analyses = facts.filter("severity <> 'info'").select(F.lit("analysis").alias("kind"), "run_id", "attempt")
    return analyses.unionByName(facts.filter("ask_model").select(F.lit("review").alias("kind"), "run_id", "attempt"))


@query("answer_ledger", with_views("""
SELECT coalesce(a.kind, n.kind) AS kind, coalesce(a.run_id, n.run_id) AS run_id, coalesce(a.attempt, n.attempt) AS attempt,
  CASE WHEN a.kind IS NULL THEN 'unasked' WHEN n.kind IS NULL THEN 'open' ELSE 'answered' END AS state, answer
FROM (SELECT 'analysis' AS kind, run_id, attempt FROM sev WHERE severity <> 'info' UNION ALL SELECT 'review', run_id, attempt FROM diffs WHERE ask_model) a
FULL JOIN newest n ON n.kind = a.kind AND n.run_id = a.run_id AND n.attempt = a.attempt""", _severity_ctes("observed") + "," + ANSWERS))
def answer_ledger(spark, d):
    return reports.answer_ledger(asked(severities(spark, d)), view(spark, d, "fx_answers"))


@query("analysis_results", with_views(f"""
SELECT s.run_id, s.attempt, severity, CASE WHEN severity <> 'info' THEN answer END AS root_cause,
  CASE WHEN severity = 'info' THEN {quoted(t.CLEAN_RECOMMENDATION)} ELSE answer END AS recommendation
FROM sev s LEFT JOIN analyses USING (run_id, attempt)""", _severity_ctes("observed") + "," + ANSWERS))
def analysis_results(spark, d):
    return reports.with_analysis(severities(spark, d), answers(spark, d, "analysis")).select(
        "run_id", "attempt", "severity", "root_cause", "recommendation")


@query("reviewed_diffs", with_views("""
SELECT run_id, attempt, page, difference_percent, verdict, ask_model, answer AS ai_analysis FROM diffs LEFT JOIN reviews USING (run_id, attempt)""",
    _RESULTS + ANSWERS))
def reviewed_diffs(spark, d):
    diffs = with_page(spark, d, outcomes(spark, d).filter("score is not null"))
    return visual.with_review(diffs, answers(spark, d, "review")).select(
        "run_id", "attempt", "page", "difference_percent", "verdict", "ask_model", "ai_analysis")


@query("report_summary", with_views("""
SELECT r.run_id, count(*) AS tests, count(*) FILTER (r.passed) AS passed, count(*) FILTER (NOT r.passed) AS failed,
  count(*) FILTER (coalesce(d.needs_review, false)) AS diffs
FROM results r LEFT JOIN diffs d USING (run_id, attempt) GROUP BY r.run_id""", _RESULTS.rstrip(",")))
def report_summary(spark, d):
    return reports.report_summary(outcomes(spark, d))


@query("report_documents", with_views(f"""
SELECT r.run_id, r.attempt, array_to_string(list_filter([
  concat('Run ID: ', r.run_id), 'Status: ANALYZING', concat('URL: ', r.url), 'Executed: {STAMP}',
  concat(r.url, CASE WHEN r.passed THEN ' ✓ PASSED' ELSE ' ✗ FAILED' END), 'Error: ' || r.error, 'Context: ' || r.error_context,
  'Screenshot: http://localhost:4566/artifacts/' || r.screenshot_s3_path, 'DOM: http://localhost:4566/artifacts/' || r.dom_s3_path, c.text,
  d.page, 'Pixel Difference: ' || CAST(d.difference_percent AS VARCHAR) || '%', upper(replace(d.verdict, '_', ' ')),
  'AI Analysis: ' || v.answer, concat('Recommendation: ', CASE WHEN s.severity = 'info' THEN {quoted(t.CLEAN_RECOMMENDATION)} ELSE coalesce(n.answer, '{reports.PENDING}') END),
  concat('Severity Level: ', upper(s.severity)), 'Tests Run: 1', concat('Passed: ', CASE WHEN r.passed THEN 1 ELSE 0 END),
  concat('Failed: ', CASE WHEN r.passed THEN 0 ELSE 1 END), concat('Visual Diffs: ', CASE WHEN coalesce(d.needs_review, false) THEN 1 ELSE 0 END)
  ], lambda x: x IS NOT NULL), chr(10)) AS body
FROM results r JOIN sev s USING (run_id, attempt) LEFT JOIN diffs d USING (run_id, attempt) LEFT JOIN top c ON c.run_id = r.run_id AND c.attempt = r.attempt
LEFT JOIN analyses n ON n.run_id = r.run_id AND n.attempt = r.attempt LEFT JOIN reviews v ON v.run_id = r.run_id AND v.attempt = r.attempt""",
    _severity_ctes("observed") + "," + TOP + "," + ANSWERS))
def report_documents(spark, d):
    return reports.report_documents(report_facts(spark, d), STAMP)


def unanswered_facts(spark, d):
    """The wide row with texts, artifact keys and the console part. Console and request logs have one row per attempt by then."""
    return reports.with_severity(with_artifacts(explained_outcomes(spark, d)))


def answered(spark, d, facts):
    """facts with the model's answers, where it was asked and has answered."""
    return visual.with_review(reports.with_analysis(facts, answers(spark, d, "analysis")), answers(spark, d, "review"))


def report_facts(spark, d):
    return answered(spark, d, unanswered_facts(spark, d))


# the reports written before any answer, brought up to date by a batch of answers that touches some of them
@query("report_documents_refreshed", CHECKS["report_documents"])
def report_documents_refreshed(spark, d):
    # the reports so far, the requests and the reports to build anew are all read from the facts, so these are made once
    facts = written(unanswered_facts(spark, d), "facts")
    build = lambda f: reports.report_documents(f, STAMP)
    ledger = reports.answer_ledger(asked(facts), view(spark, d, "fx_answers")).filter("state = 'answered'")
    touched = facts.join(ledger.select("run_id", "attempt").distinct(), ["run_id", "attempt"], "left_semi")
    return reports.refreshed(build(facts), answered(spark, d, touched), ledger, build)


@query("report_fragments", with_views(f"""
SELECT r.run_id, r.attempt, 4 AS section, u.ord, u.line FROM results r JOIN sev s USING (run_id, attempt) LEFT JOIN diffs d USING (run_id, attempt),
  LATERAL (SELECT unnest([0, 1, 2, 3, 4]) AS ord, unnest([concat('Severity Level: ', upper(s.severity)), 'Tests Run: 1',
    concat('Passed: ', CASE WHEN r.passed THEN 1 ELSE 0 END), concat('Failed: ', CASE WHEN r.passed THEN 0 ELSE 1 END),
    concat('Visual Diffs: ', CASE WHEN coalesce(d.needs_review, false) THEN 1 ELSE 0 END)]) AS line) u
UNION ALL SELECT run_id, attempt, 0, 0, concat('Run ID: ', run_id) FROM results
UNION ALL SELECT run_id, attempt, 0, 1, 'Status: ANALYZING' FROM results
UNION ALL SELECT run_id, attempt, 0, 2, concat('URL: ', url) FROM results
UNION ALL SELECT run_id, attempt, 0, 3, 'Executed: {STAMP}' FROM results
UNION ALL SELECT run_id, attempt, 3, 0, concat('Recommendation: ', CASE WHEN severity = 'info' THEN {quoted(t.CLEAN_RECOMMENDATION)} ELSE coalesce(answer, '{reports.PENDING}') END)
  FROM sev LEFT JOIN analyses USING (run_id, attempt)
UNION ALL SELECT run_id, attempt, 2, 3, concat('AI Analysis: ', answer) FROM reviews
UNION ALL SELECT run_id, attempt, 2, 0, page FROM diffs
UNION ALL SELECT run_id, attempt, 2, 1, 'Pixel Difference: ' || CAST(difference_percent AS VARCHAR) || '%' FROM diffs
UNION ALL SELECT run_id, attempt, 2, 2, upper(replace(verdict, '_', ' ')) FROM diffs
UNION ALL SELECT r.run_id, r.attempt, 1, CAST(row_number() OVER (PARTITION BY r.run_id, r.attempt ORDER BY l.k) AS INT) - 1, l.line FROM results r LEFT JOIN top c ON c.run_id = r.run_id AND c.attempt = r.attempt,
  LATERAL (SELECT unnest(range(6)) AS k, unnest([concat(r.url, CASE WHEN r.passed THEN ' ✓ PASSED' ELSE ' ✗ FAILED' END), 'Error: ' || r.error, 'Context: ' || r.error_context,
    'Screenshot: http://localhost:4566/artifacts/' || r.screenshot_s3_path, 'DOM: http://localhost:4566/artifacts/' || r.dom_s3_path, c.text]) AS line) l
  WHERE l.line IS NOT NULL""", _severity_ctes("observed") + "," + TOP + "," + ANSWERS))
def report_fragments(spark, d):
    return reports.report_fragments(report_facts(spark, d), STAMP)


# --- events, lookups, updates ------------------------------------------------------------------------------------


def _finished(spark, d):
    """The report of each run's last attempt, for runs that did not crash."""
    last = runs.final_attempt(view(spark, d, "fx_attempts"), unique=True).select("run_id", "attempt")
    rows = report_rows(spark, d, "observed").join(last, ["run_id", "attempt"])
    return rows.withColumn("correlation_id", F.concat(F.lit("corr-"), F.col("run_id").cast("string")))


def _crashed(spark, d):
    return (
        runs.crashed_runs(view(spark, d, "fx_attempts"), unique=True)
        .join(view(spark, d, "fx_runs").select("run_id", "tenant_id", "project_id"), "run_id")
        .select(
            "run_id", "tenant_id", "project_id", "attempt", F.col("pipeline_error").alias("error"),
            F.lit("RuntimeError").alias("error_type"), F.concat(F.lit("corr-"), F.col("run_id").cast("string")).alias("correlation_id"))
    )


@query("event_report_ready", with_views("""
SELECT run_id, concat('{"eventType":"report.ready","tenantId":"', tenant_id, '","projectId":"', project_id, '","runId":"', run_id,
  '","reportUrl":"http://localhost:4566/artifacts/', s3_path, '","severity":"', severity, '","correlationId":"corr-', run_id,
  '","attempt":', attempt, ',"attempts_total":3}') AS value
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY attempt DESC) AS n FROM reported
  WHERE run_id NOT IN (SELECT run_id FROM eff WHERE pipeline_error IS NOT NULL)) WHERE n = 1
UNION ALL
SELECT e.run_id, concat('{"eventType":"report.ready","tenantId":"', r.tenant_id, '","projectId":"', r.project_id, '","runId":"', e.run_id,
  '","reportUrl":null,"severity":"critical","error":"', pipeline_error, '","error_type":"RuntimeError","correlationId":"corr-', e.run_id,
  '","attempt":', attempt, '}') FROM eff e JOIN fx_runs r USING (run_id) WHERE pipeline_error IS NOT NULL""", _severity_ctes("observed")))
def event_report_ready(spark, d):
    return reports.report_events(_finished(spark, d), _crashed(spark, d))


# asked ids: one per line item supplier pair, some of which no run has
_ASKED = "asked AS (SELECT l_orderkey + 1000 * (l_suppkey % 3) AS run_id FROM lineitem)"


def _asked(spark, d):
    return view(spark, d, "lineitem").select((F.col("l_orderkey") + 1000 * (F.col("l_suppkey") % 3)).alias("run_id"))


@query("run_status", with_views("""
SELECT r.run_id, r.status, p.s3_path, p.critical_count, p.warning_count
FROM fx_runs r LEFT JOIN (SELECT run_id, s3_path, CAST(0 AS INT) AS critical_count, CAST(0 AS INT) AS warning_count,
    row_number() OVER (PARTITION BY run_id ORDER BY attempt DESC) AS n FROM reported) p ON p.run_id = r.run_id AND p.n = 1
WHERE r.run_id IN (SELECT run_id FROM asked)""", _severity_ctes("observed") + "," + _ASKED))
def run_status(spark, d):
    found, _ = reports.run_status(_asked(spark, d), view(spark, d, "fx_runs"), report_rows(spark, d, "observed"))
    return found.select("run_id", "status", "s3_path", "critical_count", "warning_count")


@query("run_not_found", with_views("""
SELECT DISTINCT run_id, 'run not found' AS error FROM asked WHERE run_id NOT IN (SELECT run_id FROM fx_runs)""", _ASKED))
def run_not_found(spark, d):
    return reports.run_status(_asked(spark, d), view(spark, d, "fx_runs"), report_rows(spark, d, "observed"))[1]


for _mode, _suffix in (("observed", ""), ("intended", "_intended")):

    @query("run_status_update" + _suffix, with_views(f"""
SELECT r.run_id, CASE WHEN p.run_id IS NULL THEN r.status ELSE '{"completed" if _mode == "intended" else "analyzing"}' END AS status,
  CASE WHEN p.run_id IS NOT NULL THEN '{STAMP}' END AS completed_at
FROM fx_runs r LEFT JOIN (SELECT DISTINCT run_id FROM reported) p USING (run_id)""", _severity_ctes(_mode)))
    def run_status_update(spark, d, mode=_mode):
        rows = view(spark, d, "fx_runs").withColumn("completed_at", F.lit(None).cast("string"))
        updates = report_rows(spark, d, mode).select("run_id", "attempt", "status", F.lit(STAMP).alias("completed_at"))
        return reports.apply_run_updates(rows, updates).select("run_id", "status", "completed_at")
