import pytest
from pyspark.sql import functions as F

from qaloom.operators import execution as x, runs


def locator(msg):
    return msg.split("waiting for")[-1].split("to")[0].strip()


CASES = [
    (None, None, None, None),
    ("nav_timeout", "whatever", "Navigation timeout: page did not load within 30000ms", None),
    ("TimeoutError", "Timeout. waiting for #a to be visible", "Timeout: element not found or not visible: #a", None),
    ("TimeoutError", "waiting for a waiting for b to c to d", "Timeout: element not found or not visible: b", None),
    ("TimeoutError", "waiting for button('x')", "Timeout: element not found or not visible: but", None),
    ("TimeoutError", "WAITING FOR #x to show", "Timeout: element not found or not visible: WAITING FOR #x", None),
    ("TimeoutError", "z" * 200, "Timeout: " + "z" * 150, None),
    ("AssertionError", "e" * 120, "Assertion failed: " + "e" * 100, None),
    ("AssertionError", "", "Assertion failed: ", None),
    ("AssertionError", "strict mode", "Assertion failed: strict mode", None),
    ("Error", "Strict Mode violation", "Strict mode violation: selector matched multiple elements", "Error"),
    ("ValueError", "v" * 130, "ValueError: " + "v" * 100, "ValueError"),
    ("crash", "strict mode " + "c" * 130, "Execution crashed: strict mode " + "c" * 88, None),
]


def test_error_classes(spark):
    rows = [(i, c is None, c, m) for i, (c, m, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "run_id int, passed boolean, exc_class string, raw_error string")
    got = {r.run_id: (r.error, r.error_type, r.status) for r in x.classify_errors(df).collect()}
    assert got == {i: (e, t, "passed" if c is None else "failed") for i, (c, _, e, t) in enumerate(CASES)}
    assert locator(CASES[4][1]) == "but" and locator(CASES[5][1]) == "WAITING FOR #x"


RUN = ["run_id"]


@pytest.fixture(scope="module")
def console(spark):
    rows = [(1, i, "error" if i % 2 else ("warning" if i % 4 else "info"), f"m{i}") for i in range(10)] + [(2, 20, "log", "only")]
    return spark.createDataFrame(rows, "run_id int, event_id int, msg_type string, msg string")


def test_console(spark, console):
    got = {r.run_id: (r.errors, r.warnings, r.logs) for r in x.console_buckets(console, RUN).collect()}
    assert got == {1: (5, 2, 3), 2: (0, 0, 1)}
    top = x.console_top(console, by=RUN).collect()
    assert [(r.run_id, r.first3, r.more) for r in top] == [(1, "m1\nm3\nm5", 2)]
    assert top[0].text == "Console Errors (5):\n• m1\n• m3\n• m5\n... and 2 more"
    lines = {(r.run_id, r.bucket, r.seq): r.msg for r in x.console_lines(console, RUN).collect()}
    assert len(lines) == 11 and lines[(1, "errors", 5)] == "m9" and lines[(1, "warnings", 1)] == "m2" and lines[(2, "logs", 1)] == "only"


def test_failed_requests(spark):
    df = spark.createDataFrame([(1, 5, "u1", None), (1, 2, "u0", "f" * 300), (1, 9, "u2", "")], "run_id int, event_id int, url string, failure string")
    got = [(r.seq, r.url, r.failure) for r in x.failed_requests(df, RUN).orderBy("seq").collect()]
    assert got == [(1, "u0", "f" * 200), (2, "u1", "Unknown"), (3, "u2", "Unknown")]


def test_timeout_context_has_counts_and_first_error(spark, console):
    a = spark.createDataFrame(
        [(1, 1, False, "TimeoutError", "t", 77), (2, 1, False, "TimeoutError", "t", 5), (3, 1, False, "ValueError", "boom", 0), (4, 1, True, None, None, 0)],
        "run_id int, attempt int, passed boolean, exc_class string, raw_error string, page_size int",
    ).withColumn("traceback", F.lit("T" * 600))
    urls = spark.createDataFrame([(i, f"http://u{i}") for i in range(1, 5)], "run_id int, url string")
    req = spark.createDataFrame([(1, 3, "u", "f"), (1, 4, "u", "f")], "run_id int, event_id int, url string, failure string")
    rows = x.error_contexts(a.join(urls, "run_id"), x.first_errors(console, by=RUN), x.failed_request_counts(req, RUN), RUN).collect()
    got = {r.run_id: r.error_context for r in rows}
    assert {r.run_id: r.console_text for r in rows}[1].startswith("Console Errors (5):\n• m1")
    assert "- Page URL: http://u1\n- Page size: 77 bytes\n- Errors on page: 5\n- Failed requests: 2\n\nFirst error: m1\n" in got[1]
    assert got[2].endswith("- Errors on page: 0\n- Failed requests: 0\n\n\n")
    assert got[3] == "ValueError: boom\n\nTraceback (last 500 chars):\n" + "T" * 500 + "\n"
    assert got[4] is None


def test_strategies(spark):
    rows = [
        (1, 1, "id", "raised", "a" * 250), (1, 2, "label", "invisible", None), (1, 3, "name", "ok", None), (1, 4, "text", "raised", "late"),
        (2, 1, "id", "raised", "e1"), (2, 2, "role", "raised", "e2"), (3, 1, "id", "invisible", None),
    ]
    df = spark.createDataFrame(rows, "run_id int, rank int, name string, outcome string, error string")
    got = {r.run_id: (r.winner, r.failures, r.message) for r in x.resolve_strategies(df).collect()}
    assert got == {
        1: ("name", "  - id: " + "a" * 200, None),
        2: (None, "  - id: e1\n  - role: e2", "Element not found with any strategy:\n  - id: e1\n  - role: e2"),
        3: (None, "", "Element not found with any strategy:\n"),
    }


def test_artifact_keys(spark):
    df = spark.createDataFrame([("t", "p", "r", 2, True), ("t", "p", "r", 3, False)], "tenant_id string, project_id string, run_id string, attempt int, ok boolean")
    got = [tuple(r)[-2:] for r in x.artifact_keys(df, F.col("ok")).orderBy("attempt").collect()]
    assert got == [("t/p/r/screenshot_attempt_2.png", "t/p/r/dom_attempt_2.html"), (None, None)]


def test_messages_belong_to_the_attempt_under_way(spark):
    attempts = spark.createDataFrame(
        [(1, 1, "2024-01-01 10:00:00"), (1, 2, "2024-01-01 10:05:00"), (2, 1, "2024-01-01 10:00:00"), (3, 1, None)], "run_id int, attempt int, started_at string",
    ).withColumn("started_at", F.col("started_at").cast("timestamp"))
    rows = [
        (1, 1, "2024-01-01 09:59:59"), (1, 2, "2024-01-01 10:00:00"), (1, 3, "2024-01-01 10:04:59"), (1, 4, "2024-01-01 10:05:00"), (1, 5, "2024-02-01 00:00:00"),
        (2, 6, "2024-01-01 10:06:00"), (3, 7, "2024-01-01 10:06:00"), (4, 8, "2024-01-01 10:06:00"), (None, 9, "2024-01-01 10:06:00"), (1, 10, None),
    ]
    log = spark.createDataFrame(rows, "run_id int, event_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    log = log.withColumns({"msg_type": F.lit("error"), "msg": F.concat(F.lit("m"), F.col("event_id"))})
    got = x.of_attempts(log, attempts)
    assert {r.event_id: r.attempt for r in got.collect()} == {1: None, 2: 1, 3: 1, 4: 2, 5: 2, 6: 1, 7: None, 8: None, 9: None, 10: None}
    texts = {(r.run_id, r.attempt): r.console_errors for r in x.error_lines(got).collect()}
    assert texts[(1, 1)] == "- m2\n- m3" and texts[(1, 2)] == "- m4\n- m5" and texts[(1, None)] == "- m1\n- m10" and len(texts) == 7
    top = {(r.run_id, r.attempt): r.errors for r in x.first_errors(got, 1).collect()}
    assert top[(1, 1)] == 2 and top[(None, None)] == 1 and len(top) == 7
    # a retry is told the errors of the attempt before it, and of no other
    tried = attempts.filter("run_id < 3").withColumns({"passed": F.lit(False), "error": F.lit("e")})
    told = {(r.run_id, r.attempt): r.console_errors for r in runs.retry_context(tried, console_errors=x.error_lines(got)).collect()}
    assert told == {(1, 1): None, (1, 2): "- m2\n- m3", (2, 1): None}
