"""Phrase collocations: words that stand together more often than their parts would.

1. Documents of one language are gathered into shards of bounded text (`SHARD_BYTES`, one document at least). A shard is one row: its words as
   numbers of its own vocabulary, with a 0 where a piece ends.
2. Word counts of the shards are summed. Words below `min_count` can't be part of a candidate, so only the others get ids of the whole
   table (`common.numbered`, in the order of language and word); every shard gets the ids of its own words back.
3. Every shard builds an FM-index over word ids, forwards and backwards: suffixes in the order of their first `longest` words, the
   Burrows-Wheeler column before them and its LF mapping. Intervals of all phrases of one length are extended together, by turns one word
   to the left in the forward index and one word to the right in the backward index; the interval of the other index follows
   from the count of smaller neighbours. Every extension is a longer phrase with its count in the shard.
4. Lengths are counted one after the other. A shard sends its phrases of one length once, in packed lists by hash of the phrase; a list's
   counts are summed over the shards and cut at `min_count`, and every shard gets the ones left of its own phrases back: a longer
   phrase can only reach `min_count` where its first and its last words do, so others are not extended.
5. Cuts, containment in longer phrases and ranks are joins over what is left.

A shard sends every phrase once with its count, so frequent words and copies weigh no more than others. Ids are exact: hashes only deal
phrases to lists, whose number grows with the words (`PER_LIST`).

Defined results: a null text is empty, a null language is `und` (one with a language of that name); ids, other columns and repeated
rows: every row counts, no other column is read; phrases never cross pieces or documents; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from qaloom.llm.common import as_bytes, mix, numbered, packed, stored, unpacked
from qaloom.session import table

SHARD_BYTES = 4_000_000
PER_LIST = 1_000_000
LONGEST = 3
MIN_COUNT = 10
TOP = 2000
COVERED = 50

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PIECE = np.zeros(256, dtype=bool)
_PIECE[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_GAP = _PIECE.copy()
_GAP[[32, 9]] = True


def words_of(texts: list[bytes]):
    """(ids, words, counts) of some texts: `ids` has the place of each word in `words` plus 1 and a 0 after every piece."""
    import pyarrow as pa

    data = np.frombuffer(b"\n".join([*texts, b""]).translate(_LOWER), dtype=np.uint8)
    gap = _GAP[data]
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~gap
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        return np.zeros(0, dtype=np.uint32), pa.array([], pa.string()), np.zeros(0, dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    coded = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[~gap])]
    ).dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.uint32) + np.uint32(1)
    piece = np.searchsorted(np.flatnonzero(_PIECE[data]), start)
    ends = np.flatnonzero(np.diff(piece, append=piece[-1] + 1))
    counts = np.bincount(ids)[1:]
    common = np.argsort(-counts, kind="stable")  # frequent words get small numbers, which pack well
    number = np.empty(len(common) + 1, dtype=np.uint32)
    number[common + 1] = np.arange(1, len(common) + 1)
    words = coded.dictionary.take(pa.array(common)).cast(pa.large_string()).cast(pa.string())
    return np.insert(number[ids], ends + 1, 0), words, counts[common]


def shards_of(docs: DataFrame, text: str, lang: str, shard_bytes: int) -> DataFrame:
    """(shard, lang, ids, words, counts): documents of one language gathered in the task that reads them."""

    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        made = TaskContext.get().partitionId() << 32

        def shard(name):
            nonlocal made
            ids, words, counts = words_of(held.pop(name))
            size.pop(name)
            made += 1
            return pa.record_batch(
                [pa.array([made - 1], pa.int64()), pa.array([name], pa.string()), pa.array([packed(ids)], pa.binary()),
                 pa.ListArray.from_arrays([0, len(words)], words), pa.ListArray.from_arrays([0, len(counts)], pa.array(counts, pa.int64()))],
                names=["shard", "lang", "ids", "words", "counts"],
            )

        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                held.setdefault(name, []).append(t)
                size[name] = size.get(name, 0) + len(t) + 1
                if size[name] >= shard_bytes:
                    yield shard(name)
        for name in list(held):
            yield shard(name)

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(gather, "shard long, lang string, ids binary, words array<string>, counts array<long>")


class Index:
    """FM-index of a sequence of symbols below `kinds`, for patterns of up to `depth` symbols. 0 ends a piece and matches nothing."""

    def __init__(self, s: np.ndarray, kinds: int, depth: int):
        key, top = s.astype(np.int64), kinds
        for j in range(1, depth):
            if top * kinds >= 2**62:
                key = np.unique(key, return_inverse=True)[1]
                top = len(s)
            key *= kinds
            key[:-j] += s[j:]
            top *= kinds
        suffixes = np.argsort(key, kind="stable")
        self.before = s[suffixes - 1]
        self.lf = np.empty(len(s), dtype=np.int64)
        self.lf[np.argsort(self.before, kind="stable")] = np.arange(len(s))

    def extend(self, lo: np.ndarray, count: np.ndarray, kinds: int):
        """All one-symbol extensions of the patterns at intervals [lo, lo + count): (pattern, symbol, count, new lo, symbols before it
        in the pattern's interval that are smaller). The last places the interval in the other index."""
        first = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(lo)), count)
        at = np.arange(len(owner)) + np.repeat(lo - first, count)
        key = owner * kinds + self.before[at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        n = np.diff(new, append=len(key))
        owner, symbol = np.divmod(key[new], kinds)
        keep = symbol > 0
        owner, new = owner[keep], new[keep]
        return owner, symbol[keep], n[keep], self.lf[at[order[new]]], new - first[owner]


def coded(words: np.ndarray, kinds: int) -> np.ndarray:
    """One number per row of words below `kinds`: equal for equal rows, in the order of the rows."""
    code, top = words[:, 0].astype(np.int64), kinds
    for j in range(1, words.shape[1]):
        if top * kinds >= 2**62:
            code = np.unique(code, return_inverse=True)[1]
            top = len(code)
        code = code * kinds + words[:, j]
        top *= kinds
    return code


def phrases(s: np.ndarray, kinds: int, longest: int, known: dict[int, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, counts) of the phrases of 2, 3 .. `longest` symbols in `s`, which ends with 0; words has a row per phrase.

    `known` has, for a length, the rows that are extended; a longer phrase is left out if its first or last words are not among them.
    """
    known = known or {}
    forward, backward = Index(s, kinds, longest), Index(s[::-1], kinds, longest)
    count = np.bincount(s, minlength=kinds)
    start = np.cumsum(count) - count
    symbols = np.flatnonzero(count[1:]) + 1
    words, n, lo, back = symbols[:, None], count[symbols], start[symbols], start[symbols]

    def among(some: np.ndarray) -> np.ndarray:
        rows = known.get(some.shape[1])
        if rows is None:
            return np.ones(len(some), dtype=bool)
        code = coded(np.concatenate([some, rows]), kinds)
        return np.isin(code[: len(some)], code[len(some) :])

    for length in range(2, longest + 1):
        if length % 2 == 0:
            owner, symbol, n, lo, smaller = forward.extend(lo, n, kinds)
            back = back[owner] + smaller
            words = np.column_stack([symbol, words[owner]])
            keep = among(words[:, :-1])
        else:
            owner, symbol, n, back, smaller = backward.extend(back, n, kinds)
            lo = lo[owner] + smaller
            words = np.column_stack([words[owner], symbol])
            keep = among(words[:, 1:])
        yield words[keep], n[keep]
        keep &= among(words)
        words, n, lo, back = words[keep], n[keep], lo[keep], back[keep]


def _list(words: np.ndarray) -> bytes:
    """Rows of words, in their order, as bytes."""
    columns = words.T.astype(np.int64)
    columns[0] = np.diff(columns[0], prepend=0)
    return packed(columns.ravel())


def _rows(data: bytes, length: int) -> np.ndarray:
    columns = unpacked(data).reshape(length, -1)
    columns[0] = np.cumsum(columns[0])
    return columns.T


def shard_phrases(shards: DataFrame, length: int, lists: int) -> DataFrame:
    """(part, shard, words, n): a shard's phrases of `length` words in `lists` lists. shards: shard, ids, known (places and ids of the
    words that count) and `of2` .. , the lists of its phrases of each smaller length that count."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for r in range(b.num_rows):
                name, s, pairs = b.column(0)[r].as_py(), unpacked(b.column(1)[r].as_py()), b.column(2)[r].values
                places, ids = (pairs.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                known = np.sort(ids)
                local = np.zeros(int(s.max(initial=0)) + 1, dtype=np.int64)
                local[places + 1] = np.searchsorted(known, ids) + 1
                s = local[s]
                s = np.append(s[(s > 0) | (np.append(0, s[:-1]) > 0)], 0)
                shorter = {
                    m: np.searchsorted(known, np.concatenate([np.zeros((0, m), np.int64), *(_rows(x, m) for x in b.column(m + 1)[r].as_py() or ())])) + 1
                    for m in range(2, length)
                }
                for words, n in phrases(s, len(known) + 1, length, shorter):
                    pass
                if not len(n):
                    continue
                order = np.argsort(coded(words, len(known) + 1))
                words, n = known[words[order] - 1], n[order]
                h = np.zeros(len(n), dtype=np.uint64)
                for j in range(length):
                    h = mix(h + words[:, j].astype(np.uint64))
                part = (h % np.uint64(lists)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part, words, n = part[order], words[order], n[order]
                first = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
                spans = list(zip(first, [*first[1:], len(part)], strict=True))
                columns = [part[first], [name] * len(first), [_list(words[lo:hi]) for lo, hi in spans], [packed(n[lo:hi]) for lo, hi in spans]]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "shard", "words", "n"])

    return shards.mapInArrow(count, "part long, shard long, words binary, n binary")


def summed(lists: DataFrame, length: int, kinds: int, min_count: int) -> DataFrame:
    """(shard, words, n): per part the phrases that reach `min_count` with their sums (shard is null), and for each shard the ones it has."""

    def add(part):
        import pandas as pd

        sizes = []
        words, n = [], []
        for x, c in zip(part["words"], part["n"], strict=True):
            words.append(_rows(x, length))
            n.append(unpacked(c))
            sizes.append(len(n[-1]))
        words, n = np.concatenate(words), np.concatenate(n)
        _, first, at = np.unique(coded(words, kinds), return_index=True, return_inverse=True)
        total = np.bincount(at, n).astype(np.int64)
        good = total >= min_count
        out = [(None, _list(words[first[good]]), packed(total[good]))] if good.any() else []
        lo = 0
        for shard, size in zip(part["shard"], sizes, strict=True):
            mine = words[lo : lo + size][good[at[lo : lo + size]]]
            if len(mine):
                out.append((shard, _list(mine), None))
            lo += size
        return pd.DataFrame(out, columns=["shard", "words", "n"]).astype({"shard": "Int64"})

    return lists.groupBy("part").applyInPandas(add, "shard long, words binary, n binary")


def _as_rows(sums: DataFrame, length: int) -> DataFrame:
    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for r in range(b.num_rows):
                words, n = _rows(b.column(0)[r].as_py(), length), unpacked(b.column(1)[r].as_py())
                g = pa.ListArray.from_arrays(np.arange(0, words.size + 1, length, dtype=np.int32), pa.array(np.ascontiguousarray(words).ravel()))
                yield from pa.Table.from_arrays([g, pa.array(n)], names=["g", "a"]).to_batches(max_chunksize=50_000)

    return sums.filter("shard IS NULL").select("words", "n").mapInArrow(rows, "g array<long>, a long")


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, min_count: int = MIN_COUNT, shard_bytes: int = SHARD_BYTES):
    """(phrases, words, totals): phrases (g: word ids, a) of 1 to `longest` words with at least `min_count` occurrences; words (id,
    lang, word, f); totals (lang, n), the word occurrences of each language."""
    shards = stored(shards_of(docs, text, lang, shard_bytes), "shards")
    vocabulary = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "x")).select(
        "shard", "lang", "place", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    totals = shards.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n")).filter("n > 0")
    frequent = vocabulary.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)
    words, kinds = numbered(frequent, ["lang", "word"], "id")
    words = stored(words, "words")
    known = vocabulary.join(words, ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("place", "id")).alias("known"))
    rows = shards.select("shard", "ids").join(known, "shard")
    lists = 1 + (words.agg(F.sum("f")).first()[0] or 0) // PER_LIST
    found = words.select(F.array("id").alias("g"), F.col("f").alias("a"))
    for length in range(2, longest + 1):
        sums = stored(summed(shard_phrases(rows, length, lists), length, kinds, min_count), "sums")
        found = found.unionByName(_as_rows(sums, length))
        if length < longest:
            back = sums.filter("shard IS NOT NULL").groupBy("shard").agg(F.collect_list("words").alias(f"of{length}"))
            rows = rows.join(back, "shard")
    return stored(found, "phrases"), words, totals


def mine(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, min_count: int = MIN_COUNT,
    top: int | None = TOP, covered: int = COVERED, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """The `top` phrases of each language (None: all): lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to `longest` words is cut where floor(1000000 a a / (l r)) is least. It is dropped where a longer candidate
    holds its words and has `covered` percent of its occurrences or more. Exact for counts up to 3 * 10**15.
    """
    if not 2 <= longest or min_count < 1:
        raise ValueError("longest must be 2 or more and min_count 1 or more")
    counts, words, totals = phrase_counts(docs, text, lang, longest, min_count, shard_bytes)
    candidates = counts.filter(F.size("g") > 1)
    size = F.size("g")
    cuts = candidates.select("g", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "g", "a", "k", F.slice("g", F.lit(1), F.col("k")).alias("left"), F.slice("g", F.col("k") + 1, size - F.col("k")).alias("right"))
    parts = lambda name, n: counts.select(F.col("g").alias(name), F.col("a").alias(n))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    scored = (
        cuts.join(parts("left", "l"), "left").join(parts("right", "r"), "right")
        .withColumn("score", F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * wide("a") * wide("a"), wide("l") * wide("r")))
        .groupBy("g", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    spans = F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1),
        lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("g", i, m)),
    ))
    longer = candidates.filter(size > 2).select("a", F.explode(spans).alias("g")).groupBy("g").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, "g", "left").filter(F.coalesce(F.col("longer") * 100 < F.col("a") * covered, F.lit(True)))
    texts = (
        kept.select("g", F.posexplode("g").alias("i", "id")).join(words.select("id", "lang", "word"), "id")
        .groupBy("g").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w"))
    )
    rows = kept.join(texts, "g").join(totals, "lang").select(
        "lang", F.array_join(F.col("w.word"), " ").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").cast("long").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
    if top is not None:  # Spark cuts every partition at this rank before the shuffle
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two and three words in each language of the documents."""
    return mine(table(spark, sf_dir, "documents"))


_CHECK = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\\x20\\x09]+') IF x <> ''] AS w FROM p),
o AS (SELECT lang, unnest([w[i:i + k - 1] FOR i IN range(1, len(w) - k + 2)]) AS g FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k),
f AS (SELECT lang, g, count(*) AS a FROM o GROUP BY ALL),
c AS (SELECT * FROM f WHERE len(g) > 1 AND a >= {MIN_COUNT}),
s AS (SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM c) c
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
t AS (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, a FROM c WHERE len(g) = 3),
d AS (SELECT lang, g, max(a) AS longer FROM t GROUP BY ALL),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, array_to_string(b.g, ' ')) AS rank,
  array_to_string(b.g, ' ') AS phrase, b.a, l, r, n, score::BIGINT AS score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN d ON d.lang = b.lang AND d.g = b.g WHERE longer IS NULL OR 100 * longer < {COVERED} * b.a
QUALIFY rank <= {TOP}
"""

QUERIES = {"op11_collocations": op11_collocations}
CHECKS = {"op11_collocations": _CHECK}
