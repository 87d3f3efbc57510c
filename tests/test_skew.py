from collections import Counter

from pyspark.sql import functions as F

from qaloom.operators.skew import asof, first_n, hot_keys, join_within, joined_text, lookup_join, ordinal, slices


def facts(spark, n=3000):
    # key 'hot' holds a third of the rows, 'n' stands for null keys
    k = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string")))
    return spark.range(n).withColumn("k", k)


def test_hot_keys(spark):
    got = {r.k: r._parts for r in hot_keys(facts(spark), ["k"], rows_per_part=300).collect()}
    assert got == {"hot": 4}


def test_lookup_join_equals_plain_join_and_spreads(spark):
    left = facts(spark)
    right = left.select("k").distinct().filter("k is not null and k <> 'k5'").withColumn("v", F.length("k"))
    for how in ("left", "inner", "left_anti", "left_semi"):
        a = lookup_join(left, right, ["k"], ["id"], how, rows_per_part=100)
        b = left.join(right, "k", how)
        assert sorted(map(repr, a.select(*sorted(b.columns)).collect())) == sorted(map(repr, b.select(*sorted(b.columns)).collect())), how


def test_ordinal_across_slices(spark):
    df = facts(spark).filter("k is not null")
    want, seen = {}, Counter()
    for r in df.orderBy("id").collect():
        seen[r.k] += 1
        want[r.id] = seen[r.k]
    got = {r.id: r.seq for r in ordinal(df, ["k"], "id", rows_per_part=64).collect()}
    assert got == want


def test_sparse_ids_of_a_hot_key_are_cut_into_even_ranges(spark):
    # ids far apart in the whole range of 64 bits, null keys among them
    far = facts(spark).withColumn("far", (F.col("id") - 1500) * 6_000_000_000_000_000 + F.pmod(F.xxhash64("id"), F.lit(1000)))
    cut, any_hot = slices(far, ["k"], "far", rows_per_part=100)
    sizes = [r["count"] for r in cut.groupBy("k", "_slice").count().collect()]
    assert any_hot and max(sizes) < 150 and len(sizes) > 50
    got = {(r.k, r.id): r.seq for r in ordinal(far, ["k"], "far", rows_per_part=100).collect()}
    seen = Counter()
    for r in far.orderBy("far").collect():
        seen[r.k] += 1
        assert got[(r.k, r.id)] == seen[r.k]
    assert not slices(far, ["k"], "far")[1]


def test_asof_finds_the_last_mark(spark):
    # every second fact of the hot key has one and the same time; key k9 has marks only after its facts, k8 has none
    sec = lambda c: F.timestamp_seconds(c)
    left = facts(spark).withColumn("at", sec(F.when((F.col("k") == "hot") & (F.col("id") % 2 == 0), 1000).otherwise(F.col("id")))).withColumn("n", F.lit("fact"))
    left = left.withColumn("at", F.when(F.col("id") != 77, F.col("at")))
    marks = spark.range(400).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"), sec(F.col("id") * 8).alias("since"),
        (F.col("id") % 7).alias("n")).filter("k <> 'k8'").withColumn("since", F.when(F.col("k") == "k9", sec(F.lit(9999))).otherwise(F.col("since")))
    marks = marks.unionByName(marks.filter("k = 'hot'").withColumn("n", F.col("n") + 1)).unionByName(marks.limit(1).withColumn("k", F.lit(None).cast("string")))
    by_key = {}
    for r in marks.collect():
        by_key.setdefault(r.k, []).append((r.since, r.n))
    facts_ = left.collect()
    want = {}
    for r in facts_:
        seen = [m for m in by_key.get(r.k, []) if r.k is not None and r["at"] is not None and m[0] <= r["at"]]
        want[r.id] = max(seen)[1] if seen else None
    for size in (10**6, 300, 60):
        got = asof(left.drop("n").withColumn("m", F.lit("fact")), marks, ["k"], "at", "since", ["n"], ["id"], rows_per_part=size).collect()
        assert len(got) == len(facts_) and {r.id: r.n for r in got} == want and {r.m for r in got} == {"fact"}
    assert sum(v is None for v in want.values()) > 60


def test_joined_text_across_slices(spark):
    df = facts(spark).filter("k is not null")
    want = {}
    for r in df.orderBy("id").collect():
        want.setdefault(r.k, []).append(str(r.id))
    got = {r.k: r.text for r in joined_text(df, ["k"], "id", F.col("id").cast("string"), ",", rows_per_part=50).collect()}
    assert got == {k: ",".join(v) for k, v in want.items()}


def test_first_n_limits_before_the_shuffle(spark):
    plan = first_n(facts(spark), ["k"], ["id"], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_large_scans_are_dealt_without_holding_them(spark):
    """More tasks than Spark writes straight to files for make each task of the scan hold its rows."""
    from qaloom.operators.skew import deal_by_key

    parts = lambda n: deal_by_key(spark.range(5000), "id", n).rdd.getNumPartitions()
    assert [parts(n) for n in (1000, 100, 10, 2)] == [spark.range(5000).rdd.getNumPartitions(), 50, 200, 313]
    assert deal_by_key(spark.range(5000), "id", 10).distinct().count() == 5000


def test_facts_of_hot_keys_move_once(spark):
    """The lists of hot keys, cuts and first marks are short and known to be: the facts are shuffled for the sweep only."""
    sec = F.timestamp_seconds
    left, marks = facts(spark).withColumn("at", sec("id")), spark.range(400).select(F.lit("hot").alias("k"), sec(F.col("id") * 8).alias("since"), F.col("id").alias("n"))
    plan = asof(left, marks, ["k"], "at", "since", ["n"], ["id"], rows_per_part=60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_join_within_deals_by_the_first_key(spark):
    left = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, None, "c"), (2, 1, "d"), (None, 1, "e")], "run_id int, attempt int, l string")
    right = spark.createDataFrame([(1, 1, "A"), (1, 3, "B"), (2, None, "C"), (None, 1, "D")], "run_id int, attempt int, r string")
    for how in ("left", "inner"):
        got = join_within(left, right, "run_id", "attempt", how)
        assert got.columns == ["run_id", "attempt", "l", "r"]
        assert sorted(map(repr, got.collect())) == sorted(map(repr, left.join(right, ["run_id", "attempt"], how).select(*got.columns).collect()))
    plan = join_within(left.hint("merge"), right, "run_id", "attempt")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and ", attempt#" not in "".join(part.split(")")[0] for part in plan.split("hashpartitioning(")[1:])
