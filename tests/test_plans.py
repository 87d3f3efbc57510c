"""Shapes that would not survive a large cluster must not appear in any plan."""

import re

import pytest

from qaloom.plans import QUERIES

IN_ROW = [
    "chunks", "chunk_counts", "hash_embed", "document_points", "knowledge_indexed", "dom_counts", "dom_sections", "dom_map", "element_attrs",
    "page_structure", "parse_events", "event_rejects", "fence_strip", "key_parse", "file_gate", "extract_text",
]


def plan_of(spark, name, sf):
    return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_pairs_and_no_single_task(no_broadcast, sf, name):
    plan = plan_of(no_broadcast, name, sf)
    assert not re.search(r"CartesianProduct|NestedLoopJoin|SinglePartition|CollectLimit", plan)
    # broadcasts forced by a hint hold the bounded list of hot keys only
    for line in re.findall(r"BroadcastExchange.*\n.*\n.*", plan):
        assert "TakeOrderedAndProject" in line or "Filter isnotnull" in line, line


@pytest.mark.parametrize("name", IN_ROW)
def test_row_work_has_no_shuffle_but_the_spreading_one(spark, sf, name):
    plan = plan_of(spark, name, sf)
    assert len(re.findall(r"Exchange", plan)) == len(re.findall(r"REPARTITION_BY_NUM", plan)) <= 1


def test_partition_filter_and_pruned_columns(spark, sf):
    plan = plan_of(spark, "list_projects", sf)
    assert "PushedFilters: [IsNotNull(c_nationkey), EqualTo(c_nationkey,7)]" in plan and "c_acctbal" not in plan
    assert "ReadSchema: struct<label:int>" in plan_of(spark, "collection_counts", sf)


def test_attempts_shuffle_once(spark, sf):
    for name in ("attempts_effective", "final_attempt", "run_severity", "report_summary"):
        assert plan_of(spark, name, sf).count("Exchange hashpartitioning") == 1, name


@pytest.mark.parametrize("name", ["illegal_jumps", "status_progress"])
def test_attempts_of_a_large_table_are_dealt_to_more_tasks(spark, monkeypatch, sf, name):
    """Rows of a task stay bounded when the number of shuffle partitions does not grow with the table."""
    from qaloom.plans import views

    want = sorted(map(tuple, QUERIES[name](spark, sf).collect()), key=repr)
    monkeypatch.setattr(views, "ROWS_PER_TASK", 200, raising=False)
    df = QUERIES[name](spark, sf)
    assert df.rdd.getNumPartitions() >= 20 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, df.collect()), key=repr) == want
    assert plan_of(spark, name, sf).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name,most", [("retry_context", 1), ("report_documents_refreshed", 0)])
def test_attempts_are_not_made_again_for_every_reader(spark, sf, name, most):
    """Logs and facts that several steps read are written once; what is left reads the line items at most once."""
    assert plan_of(spark, name, sf).count("ReadSchema: struct<l_orderkey") <= most


def test_page_texts_join_prompts_last(spark, sf):
    """The text of a page, the same for many attempts, is not shuffled with each of them: the topmost join is the one of the page."""
    plan = QUERIES["prompt_rows"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "page_id" in next(line for line in plan.split("\n") if "Join " in line)


@pytest.mark.parametrize("name", ["prompt_rows", "retry_context"])
def test_prompts_meet_everything_by_run(no_broadcast, monkeypatch, sf, name):
    """Attempts are made in one pass over the line items, and what belongs to them joins by run: the rows don't move anew for each join."""
    from qaloom.plans import views

    passes = []
    monkeypatch.setattr(views, "deal_by_key", lambda scan, *rest: passes.append(rest) or scan)
    plan = plan_of(no_broadcast, name, sf)
    assert len(passes) == 1 and "struct<l_orderkey" not in plan
    assert not re.search(r"SortMergeJoin(\(.*?\))? \[run_id#\d+L?, attempt", plan)


def test_joins_by_run_have_bounded_tasks(spark, monkeypatch, sf):
    """The stage that joins everything by run gets more tasks as attempts grow, whatever the number of shuffle partitions."""
    from qaloom.plans import execution

    want = sorted(map(tuple, QUERIES["retry_context"](spark, sf).collect()), key=repr)
    monkeypatch.setattr(execution, "ROWS_PER_TASK", 50, raising=False)
    df = QUERIES["retry_context"](spark, sf)
    assert df.rdd.getNumPartitions() >= 20 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, df.collect()), key=repr) == want
