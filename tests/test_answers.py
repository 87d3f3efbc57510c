"""Answers of the model: ledger, joins and reports that are brought up to date."""

from pyspark.sql import functions as F

from qaloom.operators import reports, visual


def test_ledger_and_refreshed_reports(spark):
    asked = spark.createDataFrame([("analysis", 1, 1), ("analysis", 1, 1), ("analysis", 2, 1), ("review", 3, 1)], "kind string, run_id int, attempt int")
    answers = spark.createDataFrame(
        [("analysis", 1, 1, 5, "old"), ("analysis", 1, 1, 9, "new"), ("analysis", 1, 1, 9, "a tie"), ("review", 3, 1, 1, None), ("review", 9, 1, 1, "x")],
        "kind string, run_id int, attempt int, answered_at int, answer string")
    got = {(r.kind, r.run_id): (r.state, r.answer) for r in reports.answer_ledger(asked, answers).collect()}
    assert got == {("analysis", 1): ("answered", "new"), ("analysis", 2): ("open", None), ("review", 3): ("answered", None), ("review", 9): ("unasked", "x")}
    assert reports.answer_ledger(asked, answers.limit(0)).filter("state <> 'open'").count() == 0

    facts = spark.createDataFrame([(i, 1, f"f{i}") for i in range(4)], "run_id int, attempt int, text string")
    build = lambda f: f.select("run_id", "attempt", F.concat(F.lit("report "), "text").alias("body"))
    now = reports.refreshed(build(facts), facts.withColumn("text", F.lit("answered")), spark.createDataFrame([(2, 1), (2, 1), (7, 1)], "run_id int, attempt int"), build)
    assert {r.run_id: r.body for r in now.collect()} == {0: "report f0", 1: "report f1", 2: "report answered", 3: "report f3"} and now.count() == 4


def test_only_differences_that_were_asked_about_take_a_review(spark):
    diffs = spark.createDataFrame([(1, 1, True), (2, 1, False), (3, 1, None)], "run_id int, attempt int, ask_model boolean")
    answers = spark.createDataFrame([(i, 1, "bug") for i in (1, 2, 3)], "run_id int, attempt int, answer string")
    assert {r.run_id: r.ai_analysis for r in visual.with_review(diffs, answers).collect()} == {1: "bug", 2: None, 3: None}
