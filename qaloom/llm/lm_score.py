"""Language-model scores from a log-frequency Bloom filter.

The model is a bigram model over words (runs of bytes between ASCII white space, A-Z lower-cased) and an end, which is also what
comes before the first word. Its counts are held by one Bloom filter: an n-gram that occurs c times is entered at the
levels 0 .. q, q = floor(log(c) / log(BASE)). A count is read by probing level after level until one is missing; what is
read is the lower edge of the level. All bits of an n-gram lie in one segment, so that tasks build segments apart.

    P(w | h) = max(0, c(h w) - DISCOUNT) / C(h) + DISCOUNT T(h) / C(h) P(w)      where h occurs in training; else P(w)
    P(w)     = c(w) / (N + 1/2), or 1/2 / (N + 1/2) where w does not occur

T(h), the number of different words after h, is a count in the filter like the others. Counts are lower edges and C(h) is exact, so
probabilities add up to one at most (but for false positives, about one probe in a thousand).

Every word and bigram of the training rows is in the filter, however rare. The filter is a table of segments whose number grows
with the n-grams; it is never held whole. Texts are cut into blocks, a block's different probes travel to the pieces (groups of `PIECE`
segments) that answer them, and the answers return to the block. A piece that is asked too often is repeated.
The query scores the rows it learns from, and more: there (`learn_and_score`) a block's pairs travel once, to parts that count them, build
the segments of their words and answer by them, so neither bigrams nor segments are written. Words of more than `HOT` of all tokens are
counted exactly there.

Exact counts: words with at least `HEAD` of all tokens (at most 1 / HEAD words) are broadcast, the
others are joined; no such word is a hot key. Words are compared by 64-bit hashes.

Defined results: a null or empty text is the end alone; without training rows N and V are 0 and the model's only word is
unknown; repeated rows are scored one by one and count as often as they occur; a null id is not held out and not learned
from; an empty table gives no rows; other columns are neither read nor clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from qaloom.llm.common import Shipped, Words, as_bytes, chunks, fold, giving_back, mix, packed, stored, unpacked

HEAD = 1e-6
BASE = 1.2
BITS = 14  # bits of the filter for each entry
PROBES = 10
SEGMENT = 1 << 16
PIECE = 16  # segments that are probed together
BLOCK = 4_000_000  # bytes of text that are scored together
ASKED = 2_000_000  # probes that one copy of a piece answers
PART = 2_000_000  # tokens of the rows for each part that counts and answers
HOT = 1e-3  # share of all tokens from which a word's pairs are dealt by their second words
DISCOUNT = 0.75
_END = np.uint64(0x5851F42D4C957F2D)
_PAIR = np.uint64(0x2545F4914F6CDD1D)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text's words and its end, and the bounds of the texts."""
    w = Words(texts, lower=True)
    n = np.diff(w.first)
    bounds = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(bounds[-1], _END, dtype=np.uint64)
    inside = np.ones(len(out), dtype=bool)
    inside[bounds[1:] - 1] = False
    out[inside] = w.hashes()
    return out, bounds


def before(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The token before each token; the end for the first of a text."""
    out = np.empty_like(words)
    out[1:] = words[:-1]
    out[bounds[:-1]] = _END
    return out


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(h * _PAIR + np.uint64(1)) + w)


def rest_key(h: np.ndarray) -> np.ndarray:
    return mix(h * _PAIR + np.uint64(1 << 63))


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (mix(keys ^ _PAIR) % np.uint64(segments)).astype(np.int64)


def probe(bits: np.ndarray, start: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Number of levels found for each key, whose segment starts at bit `start` of `bits`: probes go on until one is missing."""
    found = np.zeros(len(keys), dtype=np.int64)
    at, level = np.arange(len(keys)), 0
    while len(at):
        place = Filter.places(keys[at], level) + start[at].astype(np.uint64)
        there = np.ones(len(at), dtype=bool)
        for row in place:
            there &= (bits[(row >> np.uint64(3)).astype(np.int64)] >> (row & np.uint64(7)).astype(np.uint8)) & 1 == 1
        at = at[there]
        found[at] += 1
        level += 1
    return found


def probe_rows(segment: np.ndarray, bits: list[bytes], asked: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Levels of keys in the segments `asked`, of which those with an entry are given."""
    order = np.argsort(segment)
    joined = np.frombuffer(b"".join([bits[i] for i in order] + [bytes(SEGMENT // 8)]), dtype=np.uint8)  # the last is empty
    names = segment[order]
    at = np.searchsorted(names, asked)
    there = np.append(names, -1)[at] == asked
    return probe(joined, np.where(there, at, len(names)) * SEGMENT, keys)


class Filter:
    """A log-frequency Bloom filter as a table (segment, bits); counts are in units of `floor`. Segments without entries have no row."""

    def __init__(self, table: DataFrame | None, segments: int, floor: float):
        self.table, self.segments, self.floor = table, segments, floor

    @staticmethod
    def places(keys: np.ndarray, level: np.ndarray | int) -> np.ndarray:
        """Places in their segment, one row for each probe, of keys at a level."""
        h = mix(keys + np.atleast_1d(np.asarray(level, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
        step = (h >> np.uint64(32)) | np.uint64(1)
        return (h[None, :] + np.arange(PROBES, dtype=np.uint64)[:, None] * step[None, :]) % np.uint64(SEGMENT)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Number of levels found for each of a few keys, by the driver; `score` asks for many."""
        found = np.zeros(len(keys), dtype=np.int64)
        if not self.segments:
            return found
        asked = segment_of(keys, self.segments)
        names = np.unique(asked)
        for lo in range(0, len(names), 64):
            some = names[lo : lo + 64]
            rows = self.table.filter(F.col("segment").isin(some.tolist())).collect()
            at = np.flatnonzero(np.isin(asked, some))
            found[at] = probe_rows(np.array([r["segment"] for r in rows], dtype=np.int64), [r["bits"] for r in rows], asked[at], keys[at])
        return found

    def count(self, levels: np.ndarray) -> np.ndarray:
        """Lower edge of the counts with so many levels, 0 where there is none."""
        return edges(levels, self.floor)


def edges(levels: np.ndarray, floor: float = 1.0) -> np.ndarray:
    return np.where(levels > 0, floor * BASE ** (levels - 1.0), 0.0)


def log_probability(n: int, joint: np.ndarray, rest: np.ndarray, total: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """log10 P(w | h) from the levels of h w, T(h) and w, and the exact count of h."""
    p = np.where(alone > 0, edges(alone), 0.5) / (n + 0.5)
    seen = np.maximum(edges(joint) - DISCOUNT, 0.0) + DISCOUNT * edges(rest) * p
    return np.log10(np.where((total > 0) & (rest > 0), seen / np.maximum(total, 1), p))


@dataclass
class Head:
    n: int  # training tokens
    v: int  # distinct ones
    words: np.ndarray  # hashes of the most frequent words, sorted
    counts: np.ndarray

    def exact(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Is the word in the head, and its training count if so."""
        if not len(self.words):
            return np.zeros(len(words), dtype=bool), np.zeros(len(words), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        there = self.words[at] == words
        return there, np.where(there, self.counts[at], 0)


@dataclass
class Model:
    head: Head
    counts: DataFrame
    filter: Filter

    @property
    def n(self) -> int:
        return self.head.n

    @property
    def v(self) -> int:
        return self.head.v

    def log_probability(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 P(w | h) of a few pairs, by the driver; `score` asks for many."""
        there, total = self.head.exact(h)
        others = {r["key"]: r["c"] for r in self.counts.filter(F.col("key").isin(np.unique(h[~there]).view(np.int64).tolist())).collect()}
        total[~there] = [others.get(k, 0) for k in h[~there].view(np.int64).tolist()]
        ask = self.filter.levels
        return log_probability(self.n, ask(pair_key(h, w)), ask(rest_key(h)), total, ask(w))


def _counted(texts: DataFrame, keys_of, heads: bool = False) -> DataFrame:
    """(key, c): how often each of the keys that keys_of(words, bounds) finds in the texts occurs; counted in tasks first.

    With `heads` keys_of also returns what a key begins with, and so do the rows: (key, h, c)."""

    def count(batches: Iterator) -> Iterator:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def merged() -> tuple[np.ndarray, ...]:
            keys, first, at = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
            c = np.bincount(at, np.concatenate([x[1] for x in held]).astype(np.float64)).astype(np.int64)
            return (keys, c, np.concatenate([x[2] for x in held])[first]) if heads else (keys, c)

        for b in batches:
            some = as_bytes(b.column(0))
            for lo, hi in chunks([len(t) for t in some]):
                found = keys_of(*tokens(some[lo:hi]))
                keys, first, c = np.unique(found[0] if heads else found, return_index=True, return_counts=True)
                held.append((keys, c, found[1][first]) if heads else (keys, c))
                size += len(keys)
                if size > 4_000_000:
                    whole = merged()
                    if len(whole[0]) > 2_000_000:
                        yield from out(*whole)
                        held, size = [], 0
                    else:
                        held, size = [whole], len(whole[0])
        if held:
            yield from out(*merged())

    def out(*columns: np.ndarray) -> Iterator:
        import pyarrow as pa

        for lo in range(0, len(columns[0]), 100_000):
            yield pa.record_batch([pa.array(x[lo : lo + 100_000].view(np.int64)) for x in columns], names=["key", "c", "h"][: len(columns)])

    rows = texts.mapInArrow(count, "key long, c long" + (", h long" if heads else ""))
    return rows.groupBy("key").agg(*([F.first("h").alias("h")] if heads else []), F.sum("c").alias("c"))


def _filter_of(counts: DataFrame, floor: float) -> Filter:
    """The filter of all (key, c) of `counts`; every task builds some of its segments."""
    levels = F.floor(F.log(F.col("c") / F.lit(floor)) / math.log(BASE) + 1e-9).cast("long") + 1
    rows = counts.select("key", F.greatest(levels, F.lit(1)).alias("levels"))
    entries = rows.agg(F.sum("levels")).first()[0] or 0
    segments = math.ceil(entries * BITS / SEGMENT)
    if not segments:
        return Filter(None, 0, floor)

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([*b.columns, pa.array(segment_of(np.asarray(b.column(0)).view(np.uint64), segments))], names=["key", "levels", "segment"])

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bits: dict[int, np.ndarray] = {}
        for b in batches:
            keys, levels, segment = (np.asarray(c) for c in b.columns)
            each = np.repeat(np.arange(len(keys)), levels)
            level = np.arange(len(each)) - np.repeat(np.cumsum(levels) - levels, levels)
            places = Filter.places(keys.view(np.uint64)[each], level)
            order = np.argsort(segment[each], kind="stable")
            names, first = np.unique(segment[each][order], return_index=True)
            for name, lo, hi in zip(names.tolist(), first, np.append(first[1:], len(order)), strict=True):
                bits.setdefault(name, np.zeros(SEGMENT, dtype=bool))[places[:, order[lo:hi]].ravel().astype(np.int64)] = True
        names = sorted(bits)
        yield pa.record_batch([pa.array(names, pa.int64()), pa.array([np.packbits(bits[n], bitorder="little").tobytes() for n in names], pa.binary())], names=["segment", "bits"])

    tasks = max(1, segments // 256)
    built = rows.mapInArrow(assign, "key long, levels long, segment long").repartition(tasks, "segment").mapInArrow(build, "segment long, bits binary")
    return Filter(stored(built, "segments"), segments, floor)


def train(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model of a table with one column of texts, and the exact counts (key, c) of all its words."""
    counts = stored(_counted(texts, lambda words, bounds: words), "word-counts")
    n, v = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n = n or 0
    head = counts.filter(F.col("c") >= max(1.0, HEAD * n)).toArrow()
    keys = np.asarray(head.column("key").combine_chunks()).view(np.uint64)
    order = np.argsort(keys)

    def pairs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = before(words, bounds)
        return pair_key(h, words), h

    def keyed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([pa.array(rest_key(np.asarray(b.column(0)).view(np.uint64)).view(np.int64)), b.column(1)], names=["key", "c"])

    bigrams = stored(_counted(texts, pairs, heads=True), "bigrams")
    rest = bigrams.groupBy("h").agg(F.count(F.lit(1)).alias("c")).mapInArrow(keyed, "key long, c long")
    ngrams = counts.unionByName(bigrams.select("key", "c")).unionByName(rest)
    return Model(Head(n, v, keys[order], np.asarray(head.column("c").combine_chunks())[order]), counts, _filter_of(ngrams, 1.0)), counts


def _answered(blocks: DataFrame, table: Filter) -> DataFrame:
    """(block, at, levels): levels of the probes of all blocks; a block's probes are its pairs, its words and what follows each."""
    segments = table.segments
    sizes = blocks.agg(F.sum((2 * F.length("words") / 8 + F.length("h") / 4).cast("long"))).first()[0] or 0
    copies = max(1, math.ceil(sizes / math.ceil(segments / PIECE) / ASKED))

    def ask(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for block, words, h, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words, h, w = np.frombuffer(words, np.uint64), np.frombuffer(h, np.int32), np.frombuffer(w, np.int32)
                keys = np.concatenate([pair_key(words[h], words[w]), words, rest_key(words)])
                piece = segment_of(keys, segments) // PIECE
                order = np.argsort(piece, kind="stable").astype(np.int32)
                names, first = np.unique(piece[order], return_index=True)
                ends = np.append(first[1:], len(order))
                yield pa.record_batch(
                    [
                        pa.array(names), pa.array(np.full(len(names), block % copies)), pa.array(np.full(len(names), block)),
                        pa.array([order[a:z].tobytes() for a, z in zip(first, ends, strict=True)], pa.binary()),
                        pa.array([keys[order[a:z]].tobytes() for a, z in zip(first, ends, strict=True)], pa.binary()),
                    ],
                    names=["piece", "copy", "block", "at", "keys"],
                )

    def answer(asked, held):
        import pyarrow as pa

        parts = asked.column("keys").to_pylist()
        keys = np.frombuffer(b"".join(parts), np.uint64)
        found = probe_rows(held.column("segment").to_numpy(), held.column("bits").to_pylist(), segment_of(keys, segments), keys).astype(np.uint8)
        ends = np.cumsum([len(p) // 8 for p in parts], dtype=np.int64)
        levels = [found[a:z].tobytes() for a, z in zip(np.append(0, ends[:-1]), ends, strict=True)] if parts else []
        return pa.table([asked.column("block"), asked.column("at"), pa.array(levels, pa.binary())], names=["block", "at", "levels"])

    asked = blocks.select("block", "words", "h", "w").mapInArrow(ask, "piece long, copy long, block long, at binary, keys binary")
    held = table.table.select(F.floor(F.col("segment") / PIECE).alias("piece"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy"), "segment", "bits")
    return asked.groupBy("piece", "copy").cogroup(held.groupBy("piece", "copy")).applyInArrow(answer, "block long, at binary, levels binary")


def score(docs: DataFrame, model: Model, counts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs`."""
    held = Shipped(docs.sparkSession, model.head)
    n, below = model.n, math.log10(model.n + 0.5 * (model.v + 1))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part, made, names, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def block():
            nonlocal made
            words, bounds = tokens(texts)
            different, at = np.unique(np.concatenate([before(words, bounds), words]), return_inverse=True)
            pairs, which = np.unique((at[: len(words)].astype(np.int64) << 32) | at[len(words) :], return_inverse=True)
            made += 1
            arrays = [bounds.astype(np.int64), which.astype(np.int32), different, (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)]
            return pa.record_batch(
                [pa.array([(part << 33) + made]), pa.array([names], pa.list_(pa.int64())), *[pa.array([x.tobytes()], pa.binary()) for x in arrays]],
                names=["block", "ids", "bounds", "which", "words", "h", "w"],
            )

        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                if texts and size + len(t) > BLOCK:
                    yield block()
                    names, texts, size = [], [], 0
                names.append(name)
                texts.append(t)
                size += len(t) + 1
        if texts:
            yield block()

    def rare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for block, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = np.frombuffer(words, np.uint64)
                at = np.flatnonzero(~held.value.exact(words)[0])
                yield pa.record_batch([pa.array(np.full(len(at), block)), pa.array(at), pa.array(words[at].view(np.int64))], names=["block", "j", "key"])

    def rate(block, answers):
        import pyarrow as pa

        out = []
        for i in range(block.num_rows):
            row = {c: block.column(c)[i].as_py() for c in ("ids", "bounds", "which", "words", "h", "w")}
            bounds, which = np.frombuffer(row["bounds"], np.int64), np.frombuffer(row["which"], np.int32)
            words, h, w = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["h"], np.int32), np.frombuffer(row["w"], np.int32)
            levels = np.zeros(len(h) + 2 * len(words), dtype=np.int64)
            exact = held.value.exact(words)[1].astype(np.float64)
            for at, found in zip(answers.column("at").to_pylist(), answers.column("levels").to_pylist(), strict=True):
                if at is not None:
                    levels[np.frombuffer(at, np.int32)] = np.frombuffer(found, np.uint8)
            j = answers.column("j").drop_null().to_numpy()
            exact[j] = answers.column("c").drop_null().to_numpy()
            joint, alone, rest = np.split(levels, [len(h), len(h) + len(words)])
            log_p = log_probability(n, joint, rest[h], exact[h], alone[w])
            base = np.log10(exact + 0.5) - below
            starts, word = bounds[:-1], w[which]
            out.append(
                pa.table(
                    [
                        pa.array(row["ids"], pa.int64()), pa.array(np.diff(bounds)), pa.array(np.add.reduceat((exact > 0)[word].astype(np.int64), starts)),
                        pa.array(np.full(len(starts), n, dtype=np.int64)), pa.array(np.add.reduceat(base[word], starts)), pa.array(np.add.reduceat(log_p[which], starts)),
                    ],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
            )
        return pa.concat_tables(out)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = stored(rows.mapInArrow(cut, "block long, ids array<long>, bounds binary, which binary, words binary, h binary, w binary"), "blocks")
    joined = blocks.select("block", "words").mapInArrow(rare, "block long, j long, key long").join(counts, "key")
    answers = joined.select("block", F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("levels"), "j", "c")
    if model.filter.segments:
        answers = answers.unionByName(_answered(blocks, model.filter), allowMissingColumns=True)
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(answers.select("block", "at", "levels", "j", "c").groupBy("block")).applyInArrow(rate, schema)


# ---- rows that are scored and learned from at once: what a block asks is also what it adds, so its pairs travel once


@dataclass
class Hot:
    """Words that are so frequent that their pairs are dealt by the second word, and what all parts have counted of them."""

    words: np.ndarray  # hashes, sorted
    counts: np.ndarray | None = None
    follow: np.ndarray | None = None  # different words after each

    def within(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hot words in `words` (sorted), and their places in the list."""
        found, at, which = np.intersect1d(words, self.words, assume_unique=True, return_indices=True)
        return at, which


def levels_of(c: np.ndarray) -> np.ndarray:
    """Levels at which an n-gram of count c is entered."""
    c = np.asarray(c, dtype=np.float64)
    return np.where(c > 0, np.floor(np.log(np.maximum(c, 1)) / math.log(BASE) + 1e-9) + 1, 0).astype(np.int64)


def filled(keys: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, int]:
    """Bits of a filter of its own of all keys, an empty segment behind them, and the number of its segments."""
    segments = math.ceil(int(levels.sum()) * BITS / SEGMENT)
    bits = np.zeros((segments + 1) * SEGMENT, dtype=bool)
    start = segment_of(keys, max(1, segments)).astype(np.uint64) * np.uint64(SEGMENT)
    for level in range(int(levels.max(initial=0))):
        at = np.flatnonzero(levels > level)
        for lo in range(0, len(at), 200_000):
            some = at[lo : lo + 200_000]
            bits[(Filter.places(keys[some], level) + start[some]).ravel().astype(np.int64)] = True
    return np.packbits(bits, bitorder="little"), segments


def pairs_of(seq: np.ndarray, bounds: np.ndarray, end: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, w, which): the different pairs of a block as places of their words, in order, and the pair of each token."""
    first = np.empty_like(seq)
    first[1:] = seq[:-1]
    first[bounds[:-1]] = end
    codes, which = np.unique(first * words + seq, return_inverse=True)
    return codes // words, codes % words, which


def dealt_pairs(h: np.ndarray, w: np.ndarray, cuts: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of a block's pairs by part, and the bounds of the parts in it. Part i has the pairs of words from cuts[i] to cuts[i + 1], and
    behind them those pairs of hot words whose second word stands there."""
    is_hot = hot[h]
    part = np.searchsorted(cuts, np.where(is_hot, w, h), side="right") - 1
    order = np.argsort(2 * part + is_hot, kind="stable")
    return order, np.searchsorted(part[order], np.arange(len(cuts)))


def cuts_of(words: np.ndarray, parts: int) -> np.ndarray:
    """Where the ranges of hashes of the parts begin in sorted `words`, and their end."""
    step = (1 << 64) // parts
    return np.concatenate([[0], np.searchsorted(words, np.array([i * step for i in range(1, parts)], dtype=np.uint64)), [len(words)]]).astype(np.int64)


def _text_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of the texts of docs (doc_id, text, learn): sizes, marks, sorted word hashes, their counts, and the words in text order by rank."""

    @giving_back
    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part, made, names, texts, marks, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def block():
            nonlocal made
            hashes, bounds = tokens(texts)
            words, at, count = np.unique(hashes, return_inverse=True, return_counts=True)
            rank = np.empty(len(words), dtype=np.int64)
            rank[np.argsort(-count, kind="stable")] = np.arange(len(words))
            made += 1
            arrays = [packed(np.diff(bounds)), packed(np.array(marks)), packed(np.diff(words, prepend=np.uint64(0))), packed(count), packed(rank[at])]
            codes = [pa.array([x], pa.binary()) for x in arrays]
            columns = [pa.array([(part << 33) + made]), pa.array([names], pa.list_(pa.int64())), *codes, pa.array([len(hashes)])]
            return pa.record_batch(columns, names=["block", "ids", "sizes", "marks", "words", "count", "seq", "n"])

        for b in batches:
            for name, t, learn in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                if texts and size + len(t) > BLOCK:
                    yield block()
                    names, texts, marks, size = [], [], [], 0
                names.append(name)
                texts.append(t)
                marks.append(bool(learn))
                size += len(t) + 1
        if texts:
            yield block()

    return stored(docs.mapInArrow(cut, "block long, ids array<long>, sizes binary, marks binary, words binary, count binary, seq binary, n long"), "blocks")


def opened(sizes: bytes, count: bytes, seq: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of a block's texts and the places of their words among its sorted words."""
    return np.append(0, np.cumsum(unpacked(sizes))), np.argsort(-unpacked(count), kind="stable")[unpacked(seq)]


def hashes_of(words: bytes) -> np.ndarray:
    return np.cumsum(unpacked(words).view(np.uint64), dtype=np.uint64)


def learn_and_score(docs: DataFrame, learn, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What `score` gives for every row of `docs` by the model of those rows where the column `learn` is true.

    A block sends each part (a range of word hashes) its words there, their different pairs and how often rows that are learned from have them.
    A part counts its pairs, which gives C(h) and T(h) too, enters all in a filter of its own, and answers what was asked by probing it.
    Second words travel as the first 40 bits of their hashes; two that are equal there are one after the same word.
    """
    spark = docs.sparkSession
    mark = F.coalesce(learn, F.lit(False))
    blocks = _text_blocks(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), mark.alias("learn")))
    total = blocks.agg(F.sum("n")).first()[0] or 0
    parts = max(1, math.ceil(total / PART))

    def frequent(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for words, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words, count = hashes_of(words), unpacked(count)
                often = count >= HOT * count.sum() / 2
                yield pa.record_batch([pa.array(words[often].view(np.int64)), pa.array(count[often])], names=["key", "c"])

    heavy = blocks.select("words", "count").mapInArrow(frequent, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).filter(F.col("c") >= HOT * total)
    hot = Shipped(spark, Hot(np.sort(heavy.toArrow().column("key").to_numpy().view(np.uint64))))  # at most 1 / HOT words

    @giving_back
    def ask(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for block, sizes, marks, words, count, seq in zip(*(c.to_pylist() for c in b.columns), strict=True):
                (bounds, at), words = opened(sizes, count, seq), hashes_of(words)
                h, w, which = pairs_of(at, bounds, int(np.searchsorted(words, _END)), len(words))
                learned = np.repeat(unpacked(marks), np.diff(bounds)) > 0
                c = np.bincount(which[learned], minlength=len(h))
                cuts, is_hot = cuts_of(words, parts), np.zeros(len(words), dtype=bool)
                is_hot[hot.value.within(words)[0]] = True
                order, ends = dealt_pairs(h, w, cuts, is_hot)
                h, w, c = h[order], (words[w[order]] >> np.uint64(24)), c[order]
                rows = []
                for i, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    if hi > lo:
                        new = np.append(True, h[lo + 1 : hi] != h[lo : hi - 1])
                        first = words[h[lo:hi][new]]
                        runs = np.diff(np.append(np.flatnonzero(new), hi - lo))
                        second = w[lo:hi]
                        step = np.diff(second, prepend=np.uint64(0))
                        step[new] = second[new]  # a run begins anew
                        rows.append((i, block, packed(np.diff(first, prepend=np.uint64(0))), packed(runs), packed(step), packed(c[lo:hi])))
                columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), [pa.int64()] * 2 + [pa.binary()] * 4, strict=True)]
                yield pa.record_batch(columns, names=["part", "block", "first", "runs", "second", "c"])

    def count(asked):
        import pyarrow as pa

        firsts = [hashes_of(x) for x in asked.column("first").to_pylist()]
        runs = [unpacked(x) for x in asked.column("runs").to_pylist()]
        keys, first = np.unique(np.concatenate(firsts), return_inverse=True)
        ends = np.cumsum([len(x) for x in firsts])
        pairs = []
        for step, run, hi in zip(asked.column("second").to_pylist(), runs, ends, strict=True):
            whole = np.cumsum(unpacked(step))
            before_run = np.cumsum(run) - run
            second = whole - np.repeat(np.where(before_run > 0, whole[before_run - 1], 0), run)
            pairs.append(np.repeat(first[hi - len(run) : hi].astype(np.int64) << 40, run) | second)
        sizes = [len(x) for x in pairs]
        pairs, which = np.unique(np.concatenate(pairs), return_inverse=True)
        c = np.bincount(which, np.concatenate([unpacked(x) for x in asked.column("c").to_pylist()])).astype(np.int64)
        h = pairs >> 40
        named = mix(mix(keys[h] * _PAIR + np.uint64(1)) + (pairs & ((1 << 40) - 1)).view(np.uint64))
        n, follow = np.bincount(h, c, len(keys)).astype(np.int64), np.bincount(h[c > 0], minlength=len(keys))
        is_hot = np.isin(keys, hot.value.words)
        some = np.flatnonzero((n > 0) & ~is_hot)
        entered = np.concatenate([named[c > 0], keys[some], rest_key(keys[some])])
        bits, segments = filled(entered, np.concatenate([levels_of(c[c > 0]), levels_of(n[some]), levels_of(follow[some])]))

        def found(x: np.ndarray) -> np.ndarray:
            out = [probe(bits, segment_of(y, max(1, segments)) * SEGMENT, y) for y in np.array_split(x, len(x) // 500_000 + 1)]
            return np.concatenate(out)

        joint, alone, rest = found(named), found(keys), found(rest_key(keys))
        rows, at = [], 0
        for block, hi, group, size in zip(asked.column("block").to_pylist(), ends, firsts, sizes, strict=True):
            mine = first[hi - len(group) : hi]
            mine = mine[~is_hot[mine]]
            rows.append((block, packed(joint[which[at : at + size]]), packed(n[mine]), packed(alone[mine]), packed(rest[mine])))
            at += size
        rows = list(zip(*rows, strict=True))
        part = asked.column("part")[0].as_py()
        answers = pa.table([pa.array(rows[0], pa.int64()), pa.array([part] * len(rows[0]), pa.int64()), *[pa.array(x, pa.binary()) for x in rows[1:]]], names=["block", "part", "joint", "n", "alone", "rest"])
        heavy = np.flatnonzero(is_hot)
        sums = pa.table([pa.array([None, *keys[heavy].view(np.int64).tolist()], pa.int64()), pa.array(np.append(n.sum(), n[heavy])), pa.array(np.append(len(some), follow[heavy]))], names=["key", "c", "t"])
        return pa.concat_tables([answers, sums], promote_options="default").select(["block", "part", "joint", "n", "alone", "rest", "key", "c", "t"])

    asked = blocks.select("block", "sizes", "marks", "words", "count", "seq").mapInArrow(ask, "part long, block long, first binary, runs binary, second binary, c binary")
    answered = asked.groupBy("part").applyInArrow(count, "block long, part long, joint binary, n binary, alone binary, rest binary, key long, c long, t long")
    answered = stored(answered, "answers")
    sums = answered.filter("block is null").groupBy("key").agg(F.sum("c"), F.sum("t")).collect()  # a row for each hot word
    counted = {r[0]: (r[1], r[2]) for r in sums}
    n, v = counted.pop(None, (0, 0))
    each = np.array([counted.get(k, (0, 0)) for k in hot.value.words.view(np.int64).tolist()], dtype=np.int64).reshape(-1, 2)
    v += int((each[:, 0] > 0).sum())
    known = Shipped(spark, Hot(hot.value.words, each[:, 0], each[:, 1]))
    below = math.log10(n + 0.5 * (v + 1))

    def slim(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            words = [hashes_of(x) for x in b.column("words").to_pylist()]
            more = [[cuts_of(x, parts), *known.value.within(x), np.searchsorted(x, np.array([_END]))] for x in words]
            codes = [pa.array([packed(x[i]) for x in more], pa.binary()) for i in range(4)]
            yield pa.record_batch([*(b.column(c) for c in ("block", "ids", "sizes", "count", "seq")), *codes], names=["block", "ids", "sizes", "count", "seq", "cuts", "hot", "which", "end"])

    def rate(blocks, answers):
        import pyarrow as pa

        out = []
        answers = answers.sort_by("part")
        levels, exact, one, after = ([unpacked(x) for x in answers.column(c).to_pylist()] for c in ("joint", "n", "alone", "rest"))
        for row in blocks.to_pylist():
            bounds, at = opened(row["sizes"], row["count"], row["seq"])
            cuts, places, hots = unpacked(row["cuts"]), unpacked(row["hot"]), unpacked(row["which"])
            is_hot = np.zeros(cuts[-1], dtype=bool)
            is_hot[places] = True
            h, w, which = pairs_of(at, bounds, int(unpacked(row["end"])[0]), len(is_hot))
            joint = np.empty(len(h), dtype=np.int64)
            joint[dealt_pairs(h, w, cuts, is_hot)[0]] = np.concatenate(levels)
            c, alone, rest = (np.empty(len(is_hot), dtype=np.int64) for _ in range(3))
            for x, others, own in ((c, exact, known.value.counts), (alone, one, levels_of(known.value.counts)), (rest, after, levels_of(known.value.follow))):
                x[~is_hot] = np.concatenate(others)
                x[places] = own[hots]
            log_p = log_probability(n, joint, rest[h], c[h].astype(np.float64), alone[w])
            base, starts = np.log10(c + 0.5) - below, bounds[:-1]
            out.append(
                pa.table(
                    [
                        pa.array(row["ids"], pa.int64()), pa.array(np.diff(bounds)), pa.array(np.add.reduceat((c > 0)[at].astype(np.int64), starts)),
                        pa.array(np.full(len(starts), n, dtype=np.int64)), pa.array(np.add.reduceat(base[at], starts)), pa.array(np.add.reduceat(log_p[which], starts)),
                    ],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
            )
        return pa.concat_tables(out)

    slimmed = blocks.mapInArrow(slim, "block long, ids array<long>, sizes binary, count binary, seq binary, cuts binary, hot binary, which binary, end binary")
    answers = answered.filter("block is not null").drop("key", "c", "t")
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return slimmed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(rate, schema)


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those outside fold 1 of 5."""
    from qaloom.session import table

    docs = table(spark, sf_dir, "documents")
    out = learn_and_score(docs, fold("doc_id", 5) != 1)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 1, F.lit(False)).alias("held_out"), *out.columns[1:])


QUERIES = {"op1_lm_score": op1_lm_score}
