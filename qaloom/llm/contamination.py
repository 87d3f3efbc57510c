"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by the size of their shingle set (powers of two). In a partition every item is represented by its
bottom-k MinHash sketch, the k smallest hashes of its set, with k = floor(u * (1 - threshold)) + 1 for the partition's
largest size u. A document that holds `threshold` of an item misses at most floor(n * (1 - threshold)) < k of its
shingles, so it holds one of the sketch at least: the search loses nothing, however long the document is. Documents are
probed with all their shingles, only the sketches of the items are joined to them; what is found is verified on the
shingles themselves.

Words are runs of bytes between ASCII white space, A-Z lower-cased; a shingle is five words, or the whole text where it
has fewer. Everything is DataFrame operations.

Defined results: null, empty or blank texts hold nothing and match nothing; rows that repeat an id count as one document
or item with the union of their shingles; a null id is an id like any other; items with equal texts are all reported;
other columns are neither read nor clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from qaloom.llm.common import stored

SHINGLE = 5
THRESHOLD = 80  # per cent
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r"
_LOWER = "abcdefghijklmnopqrstuvwxyz     "


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), " "), "")


def _windows(w: Column, k: int, make) -> Column:
    """make(index of the first word) for every shingle of the words `w`; all words as one shingle where there are fewer."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), make))


def shingle_texts(w: Column, k: int = SHINGLE) -> Column:
    whole = F.when(F.size(w) > 0, F.array(F.array_join(w, " ")))
    return F.coalesce(_windows(w, k, lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)])), whole, F.array().cast("array<string>"))


def shingle_keys(w: Column, k: int = SHINGLE) -> Column:
    whole = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))
    return F.coalesce(_windows(w, k, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])), whole, F.array().cast("array<bigint>"))


def item_sets(items: DataFrame, item_id: str, text: str, k: int = SHINGLE) -> DataFrame:
    """(item_id, key, shingle): the distinct shingles of each item."""
    w = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w"))
    pairs = w.select("item_id", F.explode(F.arrays_zip(shingle_keys(F.col("w"), k).alias("key"), shingle_texts(F.col("w"), k).alias("shingle"))).alias("s"))
    return pairs.select("item_id", "s.key", "s.shingle").distinct()


def sketches(sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(item_id, partition, key): the bottom-k MinHash sketch of each item, k by the item's size partition."""
    from pyspark.sql import Window as W

    sized = (
        sets.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("item_id")))
        .withColumn("partition", F.floor(F.log2("n") + F.lit(1e-9)).cast("int"))
        .withColumn("k", F.floor((F.pow(F.lit(2.0), F.col("partition") + 1) - 1) * (100 - threshold) / 100).cast("int") + 1)
    )
    rank = F.row_number().over(W.partitionBy("item_id").orderBy("key", "shingle"))
    return sized.withColumn("r", rank).filter("r <= k").select("item_id", "partition", "key")


def contained(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    k: int = SHINGLE, threshold: int = THRESHOLD,
) -> DataFrame:
    """(doc_id, item_id, n_shingles, shared): documents that hold at least `threshold` per cent of an item's shingles.

    The sketches are written first, so that Spark knows their size when it chooses how to join them: small ones are
    broadcast, large ones sorted and merged, with skewed keys split.
    """
    sets = stored(item_sets(items, item_id, item_text, k), "item-shingles")
    probes = stored(sketches(sets, threshold), "item-sketches")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    split = lambda t: t.select("doc_id", words(F.col("text")).alias("w"))  # noqa: E731  a column of its own: split once per text
    held = split(texts).select("doc_id", F.explode(shingle_keys(F.col("w"), k)).alias("key"))
    found = stored(held.join(probes.select("item_id", "key"), "key").select("doc_id", "item_id").distinct(), "candidates")
    wanted = texts.join(found.select("doc_id").distinct().withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    pieces = split(wanted).select("doc_id", F.explode(F.array_distinct(shingle_texts(F.col("w"), k))).alias("shingle"))
    shared = (
        found.withColumnRenamed("doc_id", "d").withColumnRenamed("item_id", "i")
        .join(sets, F.col("i").eqNullSafe(F.col("item_id")))
        .select("d", "item_id", "shingle").withColumnRenamed("shingle", "s")
        .join(pieces.distinct(), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("s") == F.col("shingle")))
        .groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))
    )
    sizes = sets.groupBy(F.col("item_id").alias("i")).agg(F.count(F.lit(1)).alias("n_shingles"))
    return (
        shared.join(sizes, F.col("i").eqNullSafe(F.col("item_id")))
        .filter(F.col("shared") * 100 >= F.col("n_shingles") * threshold)
        .select("doc_id", "item_id", "n_shingles", "shared")
    )


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no item."""
    bad = contained(docs, items, doc_id, **options).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col("__bad")), "left_anti")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """Which benchmark items each document holds."""
    from qaloom.session import table

    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SHINGLES = """
    SELECT DISTINCT {id}, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM (SELECT {id}, [x FOR x IN string_split(translate(text, {upper}, '{lower}'), ' ') IF x <> ''] AS w FROM {table} WHERE text IS NOT NULL)
"""
_SQL_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def shingle_sql(table: str, key: str) -> str:
    return _SHINGLES.format(id=key, table=table, upper=_SQL_UPPER, lower=_LOWER)


CONTAINED_SQL = f"""
WITH d AS ({shingle_sql("documents", "doc_id")}), b AS ({shingle_sql("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, shared FROM c JOIN n USING (item_id) WHERE shared * 100 >= n_shingles * 80
"""

QUERIES = {"op8_decontamination": op8_decontamination}
CHECKS = {"op8_decontamination": CONTAINED_SQL}
