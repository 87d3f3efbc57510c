from pyspark.sql import functions as F

from qaloom.operators import events, reports, runs

LOG = [
    # passes on 2; a third attempt in the log never ran
    ("a", 1, False, None), ("a", 2, True, None), ("a", 3, True, None),
    # fails three times, a fourth is beyond the limit
    ("b", 1, False, None), ("b", 2, False, None), ("b", 3, False, None), ("b", 4, True, None),
    # pipeline crash ends the run
    ("c", 1, False, "boom"), ("c", 2, True, None),
    # no outcome: counts as passed for failures and retries, as failed for the route
    ("d", 1, None, None), ("d", 2, False, None),
]


def log(spark, copies=1):
    return spark.createDataFrame(LOG * copies, "run_id string, attempt int, passed boolean, pipeline_error string")


def test_effective_attempts_even_with_copies(spark):
    want = {("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("c", 1), ("d", 1)}
    for df, unique in ((log(spark), True), (log(spark), False), (log(spark, 3), False)):
        rows = runs.effective_attempts(df, unique=unique).collect()
        assert len(rows) == 7 and {(r.run_id, r.attempt) for r in rows} == want


def test_final_and_retry(spark):
    got = {r.run_id: (r.attempt, r.passed, r.attempts_made) for r in runs.final_attempt(log(spark)).collect()}
    assert got == {"a": (2, True, 2), "b": (3, False, 3), "c": (1, False, 1), "d": (1, None, 1)}
    retry = {(r.run_id, r.attempt): r.retry for r in runs.should_retry(log(spark)).collect()}
    assert retry == {("a", 1): True, ("a", 2): False, ("b", 1): True, ("b", 2): True, ("b", 3): False, ("c", 1): False, ("d", 1): False}


def test_missing_outcome_differs_between_failure_and_route(spark):
    d = log(spark).filter("run_id = 'd' and attempt = 1")
    assert runs.run_failures(d).count() == 0
    assert runs.route(d).first().route == "analysis"
    assert {r.run_id: r.has_failures for r in runs.any_failure(log(spark).filter("attempt = 1")).collect()} == {"a": True, "b": True, "c": True, "d": False}


def test_retry_context(spark):
    df = log(spark).withColumn("error", F.concat(F.lit("e"), F.col("attempt").cast("string")))
    got = {(r.run_id, r.attempt): (r.is_retry, r.attempt_number, r.previous_error) for r in runs.retry_context(df).collect()}
    assert got[("a", 1)] == (False, None, None) and got[("b", 3)] == (True, 2, "e2") and len(got) == 7


def test_retry_context_marked_and_raw(spark):
    """Attempts that never ran stay, told apart, and columns are handed on as they were logged."""
    df = log(spark).withColumn("raw_error", F.concat(F.lit("e"), F.col("attempt").cast("string")))
    plain = {(r.run_id, r.attempt): r.attempt_number for r in runs.retry_context(df, unique=True).collect()}
    rows = runs.retry_context(df, unique=True, raw=["raw_error", "passed"], mark="ran").collect()
    assert len(rows) == len(LOG) and {(r.run_id, r.attempt): r.attempt_number for r in rows if r.ran} == plain
    got = {(r.run_id, r.attempt): (r.previous_raw_error, r.previous_passed) for r in rows if r.ran}
    assert got[("a", 1)] == (None, None) and got[("b", 3)] == ("e2", False)


def test_status(spark):
    status = runs.status_log(log(spark))
    assert {r.run_id: r.status for r in runs.current_status(status).collect()} == {"a": "completed", "b": "completed", "c": "queued", "d": "completed"}
    assert runs.illegal_jumps(status).count() == 0
    bad = spark.createDataFrame([("z", 1, 0, "queued"), ("z", 1, 1, "completed"), ("y", 1, 0, "passed")], "run_id string, attempt int, step int, status string")
    assert {(r.run_id, r.status) for r in runs.illegal_jumps(bad).collect()} == {("z", "completed"), ("y", "passed")}


FACTS = "run_id string, attempt int, passed boolean, error string, error_context string, verdict string, needs_review boolean, page string, difference_percent double, url string, screenshot_s3_path string, dom_s3_path string, console_text string"


def facts(spark):
    return spark.createDataFrame([
        ("r1", 1, True, None, None, "no_change", False, "u", 0.5, "u", "s.png", "d.html", None),
        ("r2", 1, True, None, None, "minor_change", True, "u", 2.5, "u", None, None, None),
        ("r3", 1, False, None, "ctx", None, None, None, None, "u", "", None, "Console Errors (1):\n• x"),
        ("r4", 1, False, "E", None, None, None, None, None, None, None, None, None),
    ], FACTS)


def test_severity_modes(spark):
    got = {m: {r.run_id: (r.visual_issues, r.severity, r.recommendation) for r in reports.with_severity(facts(spark), m).collect()} for m in ("observed", "intended")}
    clean = "No issues detected. All checks passed."
    assert got["observed"]["r2"] == (0, "info", clean) and got["intended"]["r2"] == (1, "warning", None)
    for m in got:
        assert got[m]["r1"] == (0, "info", clean) and got[m]["r3"][1] == got[m]["r4"][1] == "critical"


def test_details_print_none_for_null(spark):
    got = {r.run_id: r.details for r in reports.failure_details(facts(spark)).collect()}
    assert got == {"r3": "- None (context: ctx)", "r4": "- E (context: None)"}


def test_report_rows_modes(spark):
    sev = reports.with_severity(facts(spark), "intended")
    rows = spark.createDataFrame([(f"r{i}", "t", "p") for i in range(1, 5)], "run_id string, tenant_id string, project_id string")
    got = {m: {r.run_id: (r.status, r.critical_count, r.warning_count) for r in reports.report_rows(sev, rows, m).collect()} for m in ("observed", "intended")}
    assert set(got["observed"].values()) == {("analyzing", 0, 0)}
    assert got["intended"] == {"r1": ("completed", 0, 0), "r2": ("completed", 0, 1), "r3": ("completed", 1, 0), "r4": ("completed", 1, 0)}
    first = reports.report_rows(sev, rows).filter("run_id = 'r1'").first()
    assert first.s3_path == "t/p/r1/report.html" and first.report_url == "http://localhost:4566/artifacts/t/p/r1/report.html"


def test_report_text(spark):
    body = {r.run_id: r.body for r in reports.report_documents(reports.with_severity(facts(spark)), "2024").collect()}
    assert body["r2"].split("\n") == [
        "Run ID: r2", "Status: ANALYZING", "URL: u", "Executed: 2024", "u ✓ PASSED", "u", "Pixel Difference: 2.5%", "MINOR CHANGE",
        "Recommendation: No issues detected. All checks passed.", "Severity Level: INFO", "Tests Run: 1", "Passed: 1", "Failed: 0", "Visual Diffs: 1",
    ]
    assert "Context" not in body["r3"] and "• x" in body["r3"] and "Screenshot" not in body["r3"]
    assert "URL: Unknown" in body["r4"] and "Recommendation: pending" in body["r4"]


def test_run_status_and_update(spark):
    rows = spark.createDataFrame([("r1", "queued", None), ("r2", "queued", None)], "run_id string, status string, completed_at string")
    rep = spark.createDataFrame([("r1", 1, "x", "k1", 0, 0), ("r1", 2, "y", "k2", 1, 0)], "run_id string, attempt int, id string, s3_path string, critical_count int, warning_count int")
    asked = spark.createDataFrame([("r1",), ("r1",), ("r2",), ("zz",)], "run_id string")
    found, missing = reports.run_status(asked, rows, rep)
    assert {(r.run_id, r.s3_path) for r in found.collect()} == {("r1", "k2"), ("r2", None)}
    assert [tuple(r) for r in missing.collect()] == [("zz", "run not found")]
    upd = spark.createDataFrame([("r1", 1, "analyzing", "t1"), ("r1", 2, "completed", "t2")], "run_id string, attempt int, status string, completed_at string")
    assert {tuple(r) for r in reports.apply_run_updates(rows, upd).collect()} == {("r1", "completed", "t2"), ("r2", "queued", None)}


def test_events_keep_nulls_and_shapes(spark):
    import json

    fin = spark.createDataFrame([("r", "t", "p", 2, "info", None, None)], "run_id string, tenant_id string, project_id string, attempt int, severity string, report_url string, correlation_id string")
    crash = spark.createDataFrame([("c", "t", "p", 1, 'a "q"', "ValueError", "k")], "run_id string, tenant_id string, project_id string, attempt int, error string, error_type string, correlation_id string")
    got = {r.run_id: json.loads(r.value) for r in reports.report_events(fin, crash).collect()}
    assert got["r"] == {"eventType": "report.ready", "tenantId": "t", "projectId": "p", "runId": "r", "reportUrl": None, "severity": "info", "correlationId": None, "attempt": 2, "attempts_total": 3}
    assert got["c"]["error"] == 'a "q"' and got["c"]["severity"] == "critical" and "attempts_total" not in got["c"]


def test_parse_events(spark):
    from qaloom.schemas import DOCUMENT_UPLOADED

    lines = ['{"documentId":"d1","s3Path":"k"}', "{broken", '{"tenantId":"t"}', "[1,2]", "", None]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    good, bad = events.parse_events(df, DOCUMENT_UPLOADED, ["documentId", "s3Path"])
    assert [r.documentId for r in good.collect()] == ["d1"]
    assert sorted(r.reason for r in bad.collect())[:1] == ["malformed"] and bad.count() == 5
    assert len(DOCUMENT_UPLOADED.fields) == 7


def test_analysis_requests_and_answers(spark):
    sev = reports.with_severity(facts(spark), "intended")
    ask = {r.run_id: r.prompt for r in reports.analysis_requests(sev).collect()}
    assert set(ask) == {"r2", "r3", "r4"} and ask["r4"].startswith("Test failures detected:\n- E (context: None)\n\nVisual issues: 0 found\n")
    assert ask["r2"].startswith("Test failures detected:\n\n\nVisual issues: 1 found")
    ans = spark.createDataFrame([("r1", 1, "ignored"), ("r4", 1, "because")], "run_id string, attempt int, answer string")
    got = {r.run_id: (r.root_cause, r.recommendation) for r in reports.with_analysis(sev, ans).collect()}
    assert got == {"r1": (None, "No issues detected. All checks passed."), "r2": (None, None), "r3": (None, None), "r4": ("because", "because")}


def test_reviewer_text_in_the_report(spark):
    f = reports.with_severity(facts(spark)).withColumn("ai_analysis", F.when(F.col("run_id") == "r2", "real_bug"))
    body = {r.run_id: r.body for r in reports.report_documents(f, "2024").collect()}
    assert "MINOR CHANGE\nAI Analysis: real_bug\n" in body["r2"] and "AI Analysis" not in body["r1"]


def test_newest_copy_of_an_attempt_wins(spark):
    log = spark.createDataFrame([("r", 1, False, 5), ("r", 1, True, 7), ("r", 1, False, None), ("s", 1, True, 1)], "run_id string, attempt int, passed boolean, seen int")
    got = {(r.run_id, r.passed, r.seen) for r in runs.dedupe_attempts(log, "seen").collect()}
    assert got == {("r", True, 7), ("s", True, 1)}
