"""Reproducible shuffle into shards: a keyed permutation of global row numbers.

1. Rows get global numbers 0 .. n-1 in an order of their own values (`common.numbered`), so the same rows have the same numbers
   however the files are cut.
2. A Feistel network over two digits of base ceil(sqrt(n)) permutes a square that just holds all numbers; a number that leaves
   0 .. n-1 is sent through again until it is back inside (cycle walking). Place, shard and slot are arithmetic on the row number:
   shard = place mod shards, slot = place div shards. `row_of` goes back from a shard and slot to the row number.
3. `write_shards` writes whole rows, every shard in the order of its slots.

The law is `rows`: row counts of any two shards differ by one at most, slots of a shard have no gaps. Nothing is kept per row but
its number, so a job that was interrupted, or that wants one slot only, computes where it stands.

Defined results: a null text has no bytes (size 1) and the checksum 0; null and repeated ids are rows like others; rows equal in all
that is returned may change places with each other; an empty table gives no rows; other columns are neither read nor clash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from qaloom.llm.common import mix, numbered, stored
from qaloom.session import table

SHARDS = 8
SEED = 20_240_229
ROUNDS = 6


def _keys(seed: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % 2**64))


def _base(n: int) -> np.uint64:
    return np.uint64(math.isqrt(max(n - 1, 0)) + 1)


def _forward(x: np.ndarray, a: np.uint64, keys: np.ndarray) -> np.ndarray:
    left, right = x // a, x % a
    for k in keys:
        left, right = right, (left + mix(right + k) % a) % a
    return left * a + right


def _backward(x: np.ndarray, a: np.uint64, keys: np.ndarray) -> np.ndarray:
    left, right = x // a, x % a
    for k in keys[::-1]:
        left, right = (right + a - mix(left + k) % a) % a, left
    return left * a + right


def _walk(step, x, n: int, seed: int) -> np.ndarray:
    a, keys = _base(n), _keys(seed)
    y = step(np.asarray(x).astype(np.uint64), a, keys)
    while (out := y >= np.uint64(n)).any():
        y[out] = step(y[out], a, keys)
    return y.astype(np.int64)


def place_of(row: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The places of row numbers (all in 0 .. n-1) in the shuffled order."""
    return _walk(_forward, row, n, seed)


def row_of(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """The row numbers that stand at slots of shards; the other direction of `place_of`."""
    place = np.asarray(slot, dtype=np.int64) * shards + np.asarray(shard, dtype=np.int64)
    if place.size and (place.min() < 0 or place.max() >= n):
        raise ValueError("no such slot")
    return _walk(_backward, place, n, seed)


def place_column(row: Column, n: int, seed: int = SEED) -> Column:
    @F.pandas_udf("long")
    def place(x):
        import pandas as pd

        return pd.Series(place_of(x.to_numpy(), n, seed))

    return place(row)


def assign(df: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """`df` with row_number, place, shard and slot, which replace columns of these names. `order` says what the row numbers follow;
    columns beside it should be few and narrow, as all of them move with the sort."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    own = ("row_number", "place", "shard", "slot")
    rows, n = numbered(df.drop(*[c for c in own if c not in order]), order, "_row")
    return (
        rows.withColumn("_place", place_column(F.col("_row"), n, seed))
        .withColumns({"row_number": F.col("_row"), "place": F.col("_place")})
        .withColumns({"shard": (F.col("_place") % shards).cast("int"), "slot": F.expr(f"_place div {shards}")})
        .drop("_row", "_place")
    )


def write_shards(df: DataFrame, path: str, order: list[str], shards: int = SHARDS, seed: int = SEED) -> None:
    """Write whole rows as Parquet under `path`/shard=K, sorted by slot in files that follow one another.

    Only the columns of `order` are sorted for the row numbers; the rest joins once, by the place where a row was read.
    """
    held = stored(df.withColumn("_read", F.monotonically_increasing_id()), "unsharded")
    keys = held.select("_read", *[F.col(f"`{c}`") for c in order])
    found = assign(keys, [*order, "_read"], shards, seed).select("_read", "shard", "slot")
    held = held.drop("shard", "slot")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        held.join(found, "_read").drop("_read")
        .repartitionByRange(max(n, shards), "shard", "slot").sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").parquet(path)
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number of every document; texts don't move."""
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
    )
    return assign(narrow, ["doc_id", "text_crc32", "size"], shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in eight shards whose row counts differ by one at most."""
    return shard_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op13_sharding": op13_sharding}
