"""What the two operators on repeated passages share: finding the windows of W units (bytes or words) that occur twice.

Shipping every suffix with its window would be W times the corpus. Windows are therefore shipped in runs: the key of a
window is the smallest hash of the k-unit strings in it, consecutive windows with one key are a run, and equal windows
have equal keys wherever they are. One row for each run (about every (W - k) / 2 units) tells

- keys that occur once: their windows occur once, and nothing more is done with them (but for text that repeats itself
  within one run, which goes on);
- keys whose runs all have one content: every window of them is repeated;
- the other keys. Here one run of each content is cut out of its text and goes with its key to a bucket, where an operator's
  own sort or tree says which windows are repeated. Contents that occur twice are repeated anyway.

A key with more than `hot` windows is split by the fingerprints of its windows, which Spark counts as a plain aggregation.
A row is known by a hash of its id and text: rows that repeat both are two occurrences of all their windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from qaloom.llm.common import Words, as_bytes, chunks, mix, powers, prefix_sums, span_hash, stored

HOT_WINDOWS = 500_000
BUCKET_BYTES = 2_000_000
SLICE_UNITS = 1_000_000


@dataclass(frozen=True)
class Unit:
    """Windows of `window` bytes or words, with keys from strings of `k` of them."""

    words: bool
    window: int
    k: int


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each full window."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Texts:
    """Some texts as units: where each unit starts and ends, and hashes of any run of units."""

    def __init__(self, texts: list[bytes], unit: Unit):
        self.unit = unit
        if unit.words:
            w = Words(texts)
            self.raw, self.start, self.end, self.first = w.raw, w.start, w.end, w.first
            self.symbols = w.hashes()
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.symbols) * powers(_STEP, len(self.symbols)))])
        else:
            self.raw = b"".join(texts)
            self.first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            self.sums = prefix_sums(np.frombuffer(self.raw, dtype=np.uint8))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not self.unit.words:
            return span_hash(self.sums, start, end)
        return mix((self.sums[end] - self.sums[start]) * powers(_STEP_INVERSE, len(self.sums))[start] + (end - start).astype(np.uint64))

    def cut(self, start: int, end: int) -> bytes:
        return self.raw[self.start[start] : self.end[end - 1]] if self.unit.words else self.raw[start:end]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first window, windows, key, loop) of all runs; the first window is a global unit position. A run loops
        if its key is in it more than once: only then can it hold equal windows itself."""
        unit, total = self.unit, int(self.first[-1])
        none = np.zeros(0, dtype=np.int64)
        nothing = (none, none, none, none.view(np.uint64), none.astype(bool))
        if total < unit.window:
            return nothing
        at = np.arange(total - unit.k + 1)
        strings, width = self.hashes(at, at + unit.k), unit.window - unit.k + 1
        keys = sliding_min(strings, width)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))[: len(keys)]
        at = np.flatnonzero(np.arange(len(keys)) + unit.window <= self.first[text + 1])  # windows inside one text
        if not len(at):
            return nothing
        key, whose = keys[at], text[at]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (key[1:] != key[:-1]) | (whose[1:] != whose[:-1])]))
        start, n, key = at[new], np.diff(np.append(new, len(at))), key[new]
        small = np.uint64(2**64 // width * min(4, width) - 1)  # nearly all keys are below; of these, those that are rare can't loop
        table = np.bincount((strings[strings <= small] & np.uint64(_MASK)).astype(np.int64), minlength=_MASK + 1)
        loop = (key > small) | (table[(key & np.uint64(_MASK)).astype(np.int64)] > 1)
        for i in np.flatnonzero(loop).tolist():
            loop[i] = np.count_nonzero(strings[start[i] : start[i] + n[i] - 1 + width] == key[i]) > 1
        return whose[new], start, n, key, loop


_MASK = 2**20 - 1
_STEP = 0xD6E8FEB86659FD93 | 1
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)


def slices(text: bytes, unit: Unit) -> Iterator[tuple[int, bytes]]:
    """(first unit, bytes) of overlapping parts of a text, so that a very long one is worked on in bounded memory."""
    if len(text) <= SLICE_UNITS:
        yield 0, text
    elif not unit.words:
        for lo in range(0, max(1, len(text) - unit.window + 1), SLICE_UNITS):
            yield lo, text[lo : lo + SLICE_UNITS + unit.window - 1]
    else:
        w = Words([text])
        for lo in range(0, max(1, len(w.start) - unit.window + 1), SLICE_UNITS // 8):
            hi = min(len(w.start), lo + SLICE_UNITS // 8 + unit.window - 1)
            yield lo, w.raw[w.start[lo] : w.end[hi - 1]]


def with_key(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("doc"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def _record(columns: list, names: list[str]):
    import pyarrow as pa

    return pa.record_batch([pa.array(c) for c in columns], names=names)


def all_runs(keyed: DataFrame, unit: Unit) -> DataFrame:
    """(doc, start, n, key, content, loop): every run of every text; start counts units, n windows."""

    def find(batches: Iterator) -> Iterator:
        for b in batches:
            docs, texts = np.asarray(b.column(0)), as_bytes(b.column(1))
            parts = [(i, lo, piece) for i, t in enumerate(texts) for lo, piece in slices(t, unit)]
            for lo, hi in chunks([len(p[2]) for p in parts]):
                some = parts[lo:hi]
                t = Texts([p[2] for p in some], unit)
                which, at, n, key, loop = t.runs()
                if not len(which):
                    continue
                content = t.hashes(at, at + n - 1 + unit.window)
                doc = docs[np.array([p[0] for p in some])][which]
                start = at - t.first[which] + np.array([p[1] for p in some])[which]
                yield _record([doc, start, n, key.view(np.int64), content.view(np.int64), loop], ["doc", "start", "n", "key", "content", "loop"])

    return keyed.select("doc", "text").mapInArrow(find, "doc long, start long, n long, key long, content long, loop boolean")


def cut_runs(keyed: DataFrame, wanted: DataFrame, unit: Unit, windows: bool) -> DataFrame:
    """The wanted runs (doc, start, n, key, twice) with their piece of text, or window by window with its fingerprint."""
    per_text = wanted.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "key", "twice")).alias("runs"))
    once = keyed.select("doc", "text").join(per_text, "doc")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            docs, texts, asked = b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2)
            for doc, text, runs in zip(docs, texts, asked.to_pylist(), strict=True):
                if windows:
                    t = Texts([text], unit)
                    for r in runs:
                        at = np.arange(r["start"], r["start"] + r["n"])
                        yield _record([np.full(len(at), doc), at, t.hashes(at, at + unit.window).view(np.int64), np.full(len(at), r["twice"])], ["doc", "start", "print", "twice"])
                    continue
                w = Words([text]) if unit.words else None
                pieces = [
                    w.raw[w.start[r["start"]] : w.end[r["start"] + r["n"] + unit.window - 2]] if w else text[r["start"] : r["start"] + r["n"] + unit.window - 1]
                    for r in runs
                ]
                yield pa.record_batch(
                    [pa.array([doc] * len(runs), pa.int64()), *[pa.array([r[c] for r in runs]) for c in ("start", "n", "key", "twice")], pa.array(pieces, pa.binary())],
                    names=["doc", "start", "n", "key", "twice", "piece"],
                )

    schema = "doc long, start long, print long, twice boolean" if windows else "doc long, start long, n long, key long, twice boolean, piece binary"
    return once.mapInArrow(cut, schema)


def repeated_windows(
    keyed: DataFrame, unit: Unit, in_bucket: Callable[[list[bytes], np.ndarray], list[np.ndarray]], hot: int = HOT_WINDOWS, bucket: int = BUCKET_BYTES
) -> DataFrame:
    """(doc, start, n): all windows of `keyed` (see `with_key`) that occur more than once, as runs of consecutive windows.

    `in_bucket(pieces, n)` gets the pieces of a bucket and the number of windows in each; it returns for each piece
    which of its windows are in the bucket a second time.
    """
    runs = stored(all_runs(keyed, unit), "runs")
    keys = (
        runs.groupBy("key")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("content").alias("lo"), F.max("content").alias("hi"), F.sum("n").alias("windows"), F.max("loop").alias("loop"))
        .filter("rows > 1 or loop").select("key", ((F.col("lo") != F.col("hi")) | (F.col("rows") == 1)).alias("mixed"), "windows")
    )
    shared = stored(runs.join(keys, "key"), "shared-runs")
    mixed = shared.filter("mixed")
    contents = mixed.groupBy("key", "content").agg(
        F.min(F.struct("doc", "start", "n")).alias("r"), F.count(F.lit(1)).alias("rows"), F.first("windows").alias("windows")
    )
    contents = stored(contents.select("key", "content", "r.doc", "r.start", "r.n", (F.col("rows") > 1).alias("twice"), (F.col("windows") > hot).alias("hot")), "contents")
    whole = shared.filter("not mixed").select("doc", "start", "n").unionByName(
        mixed.join(contents.filter("twice").select("key", "content"), ["key", "content"]).select("doc", "start", "n")
    )
    size = contents.filter("not hot").agg(F.sum(F.col("n") + unit.window) * (8 if unit.words else 1)).first()[0] or 0
    tasks = int(size // bucket) + 1

    def judge(batches: Iterator) -> Iterator:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        import pyarrow as pa

        t = pa.Table.from_batches(rows)
        doc, start, n, twice = (np.asarray(t.column(c)) for c in ("doc", "start", "n", "twice"))
        for i, found in enumerate(in_bucket(as_bytes(t.column("piece").combine_chunks()), n)):
            if twice[i] or not found.any():
                continue
            edges = np.flatnonzero(np.diff(found.astype(np.int8), prepend=0, append=0))
            yield _record([np.full(len(edges) // 2, doc[i]), start[i] + edges[::2], edges[1::2] - edges[::2]], ["doc", "start", "n"])

    cold = cut_runs(keyed, contents.filter("not hot"), unit, windows=False)
    judged = cold.repartition(tasks, "key").mapInArrow(judge, "doc long, start long, n long")
    windows = stored(cut_runs(keyed, contents.filter("hot"), unit, windows=True), "hot-windows")
    often = windows.groupBy("print").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("print")
    hot_found = windows.filter("not twice").join(often, "print").select("doc", "start", F.lit(1).cast("long").alias("n"))
    return whole.unionByName(judged).unionByName(hot_found)


def spans_of(found: DataFrame) -> DataFrame:
    """(doc, spans): the found runs of windows of each text, at most one for each of its units."""
    return found.distinct().groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def per_text(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text, spans) for every row of `keyed`."""
    return keyed.join(spans_of(found), "doc", "left").select("doc_id", "text", "spans")


def covered(length: int, spans: list[dict] | None, window: int) -> np.ndarray:
    """Which of `length` units lie in one of the windows."""
    step = np.zeros(length + 1, dtype=np.int64)
    for s in spans or ():
        step[s["start"]] += 1
        step[s["start"] + s["n"] + window - 1] -= 1
    return np.cumsum(step[:length]) > 0
