"""Helpers that keep hot keys from landing in one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from qaloom.session import written

ROWS_PER_PART = 1_000_000
MOST_SLICES = 1024
STRETCH = 8


def hot_keys(df: DataFrame, on: list[str], rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """The keys with more than `rows_per_part` rows and the number of parts each is split into.

    Counting is partial-aggregated before the shuffle. At most rows / rows_per_part keys come back; Spark joins them
    by their measured size.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_part)
    return counts.select(*on, F.ceil(F.col("_n") / rows_per_part).cast("int").alias("_parts"))


def widen(scan: DataFrame, row_id: str, parts: int | None) -> DataFrame:
    """Spread a scan over `parts` tasks in front of work that is heavy per row; None leaves it as it was read.

    For tables in fewer splits than there are cores, as local test files are. Rows go by a hash of their unique id, so a
    repeated task places them alike.
    """
    return scan.repartition(parts, row_id) if parts else scan


def widen_by_rows(scan: DataFrame, row_id: str, rows_per_task: int) -> DataFrame:
    """Spread a scan so that no task gets many more than `rows_per_task` rows, where it was read in fewer splits than that needs.

    Splits are cut by bytes, so a small file of many rows, whose work is made from them, is one task else. Counting reads no columns.
    """
    need = -(-scan.count() // rows_per_task)
    return scan.repartition(need, row_id) if need > scan.rdd.getNumPartitions() else scan


def deal_by_key(scan: DataFrame, key: str, rows_per_task: int) -> DataFrame:
    """Deal a large scan by a key, in tasks of about `rows_per_task` rows, for the steps that group by that key afterwards.

    Shuffle partitions of a fixed number, or joined up to a size in compressed bytes, hold more and more rows, and a sort holds those of its
    partition. A scan that gives the cores less than that each is left alone, and Spark chooses.

    Up to `bypassMergeThreshold` tasks Spark writes rows straight to a file for each; beyond that a task of the scan, millions of rows, holds all
    it read. So there are no more, until they would get `STRETCH` times the rows.
    """
    spark = scan.sparkSession
    rows = scan.count()
    need = -(-rows // rows_per_task)
    if need <= spark.sparkContext.defaultParallelism:
        return scan
    straight = int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    parts = max(need, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return scan.repartition(max(min(parts, straight), -(-rows // (STRETCH * rows_per_task))), key)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    row_id: list[str],
    how: str = "left",
    rows_per_part: int = ROWS_PER_PART,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join a fact table to a table that is unique on `on`, splitting the hot keys of the fact side.

    Rows of a hot key spread over its parts by a hash of `row_id` (a unique id, so that exact copies spread too and
    a retried task repeats the same choice); the matching right row is repeated once per part. Null keys never
    match and are spread as well. `how` is left, inner, left_anti or left_semi.
    """
    # `counted` has the keys of the fact rows, where those are costly to make a second time. The list is written then, so that its size is
    # known before the facts are planned to move for it
    hot = hot_keys(left, on, rows_per_part) if counted is None else written(hot_keys(counted, on, rows_per_part), "hot")
    null_key = F.lit(False)
    for c in on:
        null_key = null_key | F.col(c).isNull()
    spread = F.xxhash64(*row_id)
    salted = (
        left.join(hot, on, "left")
        .withColumn(
            "_part",
            F.when(null_key, F.pmod(spread, F.lit(1024)))
            .otherwise(F.pmod(spread, F.coalesce("_parts", F.lit(1))))
            .cast("int"),
        )
        .drop("_parts")
    )
    repeated = (
        right.join(hot, on, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        .drop("_parts")
    )
    return salted.join(repeated, [*on, "_part"], how).drop("_part")


def join_within(left: DataFrame, right: DataFrame, key: str, within: str, how: str = "left") -> DataFrame:
    """Join on `key` and `within` with both sides dealt by `key` alone, for a left side that is dealt so already.

    Spark deals both sides by all columns that a join compares for equality, so `within` is compared by order. A key should have few rows
    of `right`, as a run has of attempts: each row of `left` goes through them.
    """
    rest = [c for c in right.columns if c not in (key, within)]
    right = right.select(F.col(key).alias("_key"), F.col(within).alias("_within"), *rest)
    same = (F.col(key) == F.col("_key")) & (F.col(within) <= F.col("_within")) & (F.col(within) >= F.col("_within"))
    return left.join(right, same, how).drop("_key", "_within")


def slices(df: DataFrame, keys: list[str], seq: str, rows_per_part: int = ROWS_PER_PART, at_hand: bool = False) -> tuple[DataFrame, bool]:
    """`df` with `_slice`: the rows of a key with more than `rows_per_part` rows are cut into ranges of `seq` of about that size (at most
    `MOST_SLICES` ranges), those of other keys are slice 0. The second value says whether any key is cut.

    The ranges are quantiles of the key's own values, so it does not matter how far apart they lie. One number, the largest count of a
    key, reaches the driver; null keys are a key like others. Rows with the same `seq` stay together.

    The lists of hot keys and of their cuts are written, so that Spark knows how short they are and does not shuffle the rows to meet them.
    Where a key is cut, the rows are read several times: they are written before, unless they are `at_hand` in files.
    """
    most = hot_keys(df, keys, rows_per_part).agg(F.max("_parts")).first()[0]
    if most is None:
        return df.withColumn("_slice", F.lit(0)), False
    n = min(most, MOST_SLICES)
    df = df if at_hand else written(df, "sliced")
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    hot = written(hot_keys(df, keys, rows_per_part).select(*named), "hot")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    cuts = df.join(hot, same, "left_semi").groupBy(*named).agg(F.percentile_approx(seq, [i / n for i in range(1, n)], 20 * n).alias("_cuts"))
    cuts = written(cuts, "cuts")
    at = F.size(F.filter("_cuts", lambda c: c < F.col(seq)))
    cut = df.join(cuts, same, "left").withColumn("_slice", F.when(F.col("_cuts").isNull(), 0).otherwise(at))
    return cut.drop("_cuts", *[f"_k{i}" for i in range(len(keys))]), True


def _carried(df: DataFrame, small: DataFrame, keys: list[str], value: str) -> DataFrame:
    """`df` with `value` of the rows of `small`, which has some slices of the hot keys."""
    on = [*keys, "_slice"]
    small = small.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(on)], value)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(on)])
    return df.join(small, same, "left").drop(*[f"_k{i}" for i in range(len(on))])


def ordinal(df: DataFrame, keys: list[str], seq: str, name: str = "seq", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Number the rows of each key from 1 in the order of `seq`, a unique integer within the key, however far its values lie apart.

    Rows of a hot key are numbered inside ranges of `seq`; a range starts behind the counts of the ranges before it.
    """
    cut, any_hot = slices(df, keys, seq, rows_per_part)
    inside = W.partitionBy(*keys, "_slice").orderBy(seq)
    number = F.row_number().over(inside).cast("bigint")
    if not any_hot:
        return cut.withColumn(name, number).drop("_slice")
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    counts = cut.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_before", F.sum("_n").over(before)).filter("_slice > 0")
    numbered = cut.withColumn(name, number)
    return _carried(numbered, offsets, keys, "_before").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_slice", "_before")


def joined_text(
    df: DataFrame, keys: list[str], seq: str, text: Column, sep: str, name: str = "text", rows_per_part: int = ROWS_PER_PART
) -> DataFrame:
    """Ordered string join per key; for hot keys in two levels, ranges of `seq` first and then the few range texts."""
    by_seq = lambda col: F.transform(F.array_sort(F.collect_list(F.struct(col, "_t"))), lambda x: x["_t"])
    cut, any_hot = slices(df.select(*keys, seq, text.alias("_t")).filter(F.col("_t").isNotNull()), keys, seq, rows_per_part)
    if not any_hot:
        return cut.groupBy(*keys).agg(F.array_join(by_seq(F.col(seq)), sep).alias(name))
    first = cut.groupBy(*keys, "_slice").agg(F.array_join(by_seq(F.col(seq)), sep).alias("_t"))
    return first.groupBy(*keys).agg(F.array_join(by_seq(F.col("_slice")), sep).alias(name))


def asof(
    facts: DataFrame, marks: DataFrame, on: list[str], at: str, since: str, values: list[str], row_id: list[str],
    rows_per_part: int = ROWS_PER_PART, at_hand: bool = False,
) -> DataFrame:
    """`facts` with `values` of the last mark of the same key whose `since` is not after the fact's `at`; null where there is none.

    Both sides are one sorted sequence per key, swept once for the last mark seen. The sequence of a hot key is cut into ranges of
    time, each starts with the last mark of the ranges before it; a range that is still too large, because its times are equal, is
    dealt over parts by `row_id` (a unique id of a fact), with its marks in every part. Marks of one moment: the largest values
    win. Facts with a null key or time find nothing. `at_hand` says that both sides are read from files, see `slices`.
    """
    # named apart, so that columns of the two sides can't clash
    mark = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(values)])
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    keys = [f"_on{i}" for i in range(len(on))]
    key_of = [F.col(c).alias(k) for c, k in zip(on, keys, strict=True)]
    good = reduce(and_, [F.col(c).isNotNull() for c in [*on, since]])
    right = marks.filter(good).select(*key_of, micros(since).alias("_t"), mark.alias("_mark"), F.lit(False).alias("_fact"))
    # the columns of a fact stand beside each other, so that those nobody reads afterwards don't move
    own = {c: f"_f{i}" for i, c in enumerate(facts.columns)}
    left = facts.select(*key_of, micros(at).alias("_t"), F.lit(True).alias("_fact"), F.xxhash64(*row_id).alias("_salt"), *[F.col(c).alias(f) for c, f in own.items()])
    none = right.select("_mark").schema["_mark"].dataType
    both = left.withColumn("_mark", F.lit(None).cast(none)).unionByName(
        right.withColumns({f: F.lit(None).cast(left.schema[f].dataType) for f in ["_salt", *own.values()]}))
    cut, any_hot = slices(both, keys, "_t", rows_per_part, at_hand)
    sweep_keys = [*keys, "_slice"]
    if any_hot:
        parts = written(hot_keys(cut, sweep_keys, 2 * rows_per_part), "parts")
        cut = _carried(cut, parts, keys, "_parts").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        place = F.when(~F.col("_fact"), F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array(F.pmod("_salt", F.col("_parts")).cast("int")))
        cut = cut.withColumn("_part", F.explode(place)).drop("_parts")
        sweep_keys.append("_part")
    sweep = W.partitionBy(*sweep_keys).orderBy("_t", "_fact", "_mark").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = cut.withColumn("_last", F.last("_mark", ignorenulls=True).over(sweep)).filter("_fact")
    if any_hot:
        ends = cut.filter("NOT _fact").groupBy(*keys, "_slice").agg(F.max(F.struct("_t", "_mark")).alias("_end"))
        # the last mark before each range, also for ranges that hold no mark themselves
        ranges = cut.groupBy(*keys, "_slice").agg(F.lit(1).alias("_any")).join(ends, [*keys, "_slice"], "left")
        before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
        starts = ranges.withColumn("_start", F.last("_end", ignorenulls=True).over(before)["_mark"]).filter("_slice > 0")
        swept = _carried(swept, written(starts.select(*keys, "_slice", "_start"), "starts"), keys, "_start").withColumn("_last", F.coalesce("_last", "_start"))
    found = F.when(reduce(and_, [F.col(k).isNotNull() for k in keys]), F.col("_last"))
    swept = swept.withColumn("_last", found)
    return swept.select(*[F.col(f).alias(c) for c, f in own.items()], *[F.col("_last")[f"v{i}"].alias(c) for i, c in enumerate(values)])


def first_n(df: DataFrame, key: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows per key. Spark applies the rank limit on both sides of the shuffle, so a hot key is cut to n
    rows per input partition before it moves."""
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
