"""Helpers shared by the operators: words and hashes over whole Arrow batches, folds, run folders, links to components."""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator
from functools import cached_property, wraps

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from qaloom.session import ensure_checkpoint_dir

CHUNK_BYTES = 2_000_000
_SEED = 20_240_229


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id written as text, modulo `folds`; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(folds)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet into the shared checkpoint folder and read it back.

    Later steps read the files, so a lost executor costs a re-read and never a recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: list[str], name: str) -> tuple[DataFrame, int]:
    """`df` with the place of every row, from 0, in the order of `by`, and the number of rows.

    A range partitioning on `by` sorts the rows; a row's number is its place inside its partition plus the rows of the
    partitions before. The place where a row was read comes last in the order, so any number of equal rows is cut like others.
    Both tables are written, so that numbers stay the same when tasks run again. Offsets are as many as partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(columns))])
    flat = stored(plain.withColumn("_read", F.monotonically_increasing_id()), "unnumbered")
    keys = [*[f"c{columns.index(c)}" for c in by], "_read"]
    ranged = flat.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_read")
    ranged = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    numbers = (place + F.col("_before")).alias(name)
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns) if c != name], numbers), flat.count()


def giving_back(over_batches):
    """A function over batches that gives freed memory back to the system when its task ends. A worker is used again by later stages, and
    its allocator would hold the pages of large arrays meanwhile, beside the memory of the executor's own process."""

    @wraps(over_batches)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from over_batches(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


class Shipped:
    """A value that every task reads, as a broadcast of its bytes: its class travels with it, so tasks need no copy of the package."""

    def __init__(self, spark: SparkSession, value):
        self.held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @cached_property
    def value(self):
        return pickle.loads(self.held.value)


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive items that together hold about `limit` bytes (at least one item each)."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if sizes:
        yield lo, len(sizes)


def as_bytes(column) -> list[bytes]:
    """The values of an Arrow string or binary column; null is empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [v or b"" for v in column.cast(kind).to_pylist()]


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 (or their differences, modulo 2^64) as bytes: equal bytes of all numbers side by side, compressed."""
    x = np.asarray(x).astype(np.uint64)
    width = 4 if x.max(initial=0) < 2**32 else 8
    planes = np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zlib.compress(planes.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


# ---- hashes of byte strings: polynomials modulo 2^64 over random byte values, so that any substring costs one subtraction

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(_SEED).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2^64; kept, and grown when a longer run is asked for."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        size = max(n, 1 << 16)
        got = np.full(size, base, dtype=np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        _POWERS[base] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads its input over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which `span_hash` reads the hash of any span of `data` (uint8)."""
    s = np.empty(len(data) + 1, dtype=np.uint64)
    s[0] = 0
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=s[1:])
    return s


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = powers(_INVERSE, len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Words:
    """The words of some texts: bytes between ASCII white space, in text order.

    `first[i]` and `first[i + 1]` bound the words of text i; `start`, `end` are byte positions in `data`.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b" ".join([*texts, b""])
        if lower:
            joined = joined.translate(_LOWER)
        self.raw = joined
        self.data = np.frombuffer(joined, dtype=np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offset = np.concatenate([[0], np.cumsum(sizes)])
        word = np.zeros(len(joined) + 1, dtype=np.int8)
        word[1:] = ~_SPACE[self.data]
        step = np.diff(word)
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)  # every text is followed by a blank, so every word ends
        self.first = np.searchsorted(self.start, self.offset)

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_sums(self.data), self.start, self.end)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles that stay in one text, in order, and the bounds of each text's shingles.

    A text of fewer than k words (one at least) has one shingle: the whole sequence.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    if bounds[-1] == 0:
        return np.zeros(0, dtype=np.uint64), bounds
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], count)
    last = np.repeat(first[1:], count)
    h = np.full(len(at), 0xA0761D6478BD642F, dtype=np.uint64)
    padded = np.concatenate([words, np.zeros(k, dtype=np.uint64)])
    for j in range(k):
        inside = at + j < last
        h = np.where(inside, mix(h * np.uint64(0xE7037ED1A0B428DB | 1) + padded[at + j] + np.uint64(j)), h)
    return h, bounds


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node that each node of `links` (a, b) is linked with, directly or through others.

    Alternates large-star and small-star steps until nothing changes; each step is one aggregation over the links, and
    its result is written to the shared folder. Only a count of changes reaches the driver.
    """
    edges = stored(
        links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u goes to the smallest of u's neighbourhood
        big = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        tops = low.filter(F.col("m") < F.col("u")).select("u", F.col("m").alias("v"))
        large = big.unionByName(tops).filter("u != v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        after = (
            small.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .filter("u != v").distinct()
        )
        after = stored(after, "links")
        roots = after.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        unsettled = roots.filter("n > 1").select("u").unionByName(
            after.select("v").distinct().join(after.select(F.col("u").alias("v")), "v", "left_semi").select(F.col("v").alias("u"))
        ).limit(1).count()
        edges = after
        if not unsettled:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
    raise RuntimeError("links did not settle; raise rounds")


