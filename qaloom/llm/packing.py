"""Packing documents into token windows by lexical retrieval (BM25) without padding.

1. Texts become token ids, each document with an end id. Whole windows of a document are sequences of their own; what is left of
   it (its tail) is packed with the tails of other documents.
2. Tails are dealt over tasks by ranges of the three tokens that weigh most in their document (`signature`), so that lexically close
   documents share a task and are near each other in it; a hash comes last, so that a large group of equal ones is many ranges.
   Every `SHARD` tails in that order are one shard. An inverted index from token to BM25 weights covers a shard and the
   next one, over the whole documents and not only their tails; document frequencies and the mean length are those of all rows.
3. A seed, the first unused tail, asks the index with all tokens of its document, that is its own shard and the one after
   it (tails of earlier ones are used up by then). Its unused neighbours, best first, fill the window greedily: those that fit
   whole are taken, at last the best one is cut to fill what is left, and its rest is the next seed. What does not fill a
   window moves on to the next shard; at the end of a task it is cut in lengths that are powers of two, which need no padding.

Every task has whole documents' token counts and the tails of two shards in memory, and the frequencies of the vocabulary.

Defined results: a null or empty text is the end id alone; rows that repeat an id are packed one by one; a null id stays
null; an empty table gives no rows; ties of scores go to the earlier tail; other columns are neither read nor clash.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from qaloom.llm.common import Shipped, chunks, giving_back, stored

WINDOW = 1024
SHARD = 1024
END = 0
K1, B = 1.2, 0.75
# how a byte-level tokenizer splits text before its merges
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# units that white space ends, or that hold any but one blank in front
_ODD = r"^ $|[\t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class Encoder:
    """Token ids of texts; the units of many texts are encoded once each.

    In a byte-level BPE a token starts at every blank before a character that isn't white space, and before and after a single line
    feed between two such characters. So what lies between is encoded alone: the different units of all texts at once, as lines of one
    text. Texts with other white space are encoded whole, and so is everything with a vocabulary of another kind.
    """

    def __init__(self, tokenizer_json: str):
        self.spec = tokenizer_json
        spec = json.loads(tokenizer_json)
        size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens") or [])], default=0) + 1 if isinstance(spec["model"].get("vocab"), dict) else None
        self.fast = self._ranked(spec)
        self.kind = np.dtype("<u2") if (size or self.model.get_vocab_size()) <= 65_536 else np.dtype("<u4")
        self.feed = self.ids("\n")

    @cached_property
    def model(self):
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(self.spec)
        model.encode_special_tokens = True
        return model

    @staticmethod
    def _ranked(spec: dict):
        """The same merges for tiktoken, which is several times as fast, where the vocabulary allows it: a plain byte-level BPE
        whose ids are in the order of its merges. None otherwise."""
        import tiktoken
        from tokenizers import pre_tokenizers

        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        same = model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if not same or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            return None
        visible = [c for c in map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)])]
        letters = dict(zip(visible, map(ord, visible), strict=True))
        letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in letters)}
        if set(letters) != set(pre_tokenizers.ByteLevel.alphabet()):
            return None
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        first = [model["vocab"][m] for m in merged]
        if first != sorted(first) or len(ranks) != len(set(ranks.values())) or (first and first[0] < 256):
            return None
        return tiktoken.Encoding("ranked", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.kind)
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype=self.kind)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.fast is None or len(self.feed) != 1 or not texts:
            return [self.ids(t) for t in texts]
        plain = ["" if "\0" in t else t.replace(" ", "\0 ").replace("\n", "\0\n\0") for t in texts]
        parts = pc.split_pattern(pa.array(plain, pa.large_string()), "\0")
        bounds, coded = parts.offsets.to_numpy(), parts.flatten().dictionary_encode()
        unit, names = coded.indices.to_numpy(), coded.dictionary
        feed, nothing = pc.equal(names, "\n").to_numpy(zero_copy_only=False), pc.binary_length(names).to_numpy() == 0
        odd = pc.match_substring_regex(names, _ODD).to_numpy(zero_copy_only=False) & ~feed
        lines = np.flatnonzero(~(feed | nothing | odd))
        ids, sizes = np.zeros(0, dtype=self.kind), np.zeros(len(names), dtype=np.int64)
        if len(lines):
            some = names.take(pa.array(lines)).cast(pa.string())
            one = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), "\n")[0].as_py()
            ids = self.ids(one)
            ends = np.append(np.flatnonzero(ids == self.feed[0]), len(ids))
            if len(ends) != len(lines):  # a vocabulary that joins line feeds with their neighbours
                return [self.ids(t) for t in texts]
            sizes[lines] = np.diff(ends, prepend=-1) - 1
            ids = np.delete(ids, ends[:-1])
        at_feed = np.flatnonzero(feed)
        if len(at_feed):
            ids = np.insert(ids, sizes[: at_feed[0]].sum(), self.feed[0])
            sizes[at_feed] = 1
        width = self.kind.itemsize
        at = np.append(0, np.cumsum(sizes))
        known = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(names), [None, pa.py_buffer(at * width), pa.py_buffer(np.ascontiguousarray(ids))])
        taken = known.take(coded.indices)
        total = np.frombuffer(taken.buffers()[1], np.int64)[: len(unit) + 1] // width
        flat = np.frombuffer(taken.buffers()[2] or b"", self.kind)
        # other white space: a unit that can't be cut so, or nothing between two units (but at the ends of a text)
        wrong, empty = odd[unit], nothing[unit]
        empty[bounds[:-1]] = empty[bounds[1:] - 1] = False
        wrong = np.add.reduceat((wrong | empty).astype(np.int64), bounds[:-1]) > 0
        return [
            self.ids(t) if wrong[i] or (t and not plain[i]) else flat[total[bounds[i]] : total[bounds[i + 1]]]
            for i, t in enumerate(texts)
        ]


class Tail:
    """What is left to pack of a document: ids[at:], `start` ids of the document come before ids[0]."""

    __slots__ = ("at", "doc_id", "ids", "start", "terms", "tf", "tokens")

    def __init__(self, doc_id, start, tokens, ids, terms, tf):
        self.doc_id, self.start, self.tokens, self.ids, self.terms, self.tf, self.at = doc_id, start, tokens, ids, terms, tf, 0

    def left(self) -> int:
        return len(self.ids) - self.at


class Statistics:
    """Number of documents, their mean length and the document frequency of every token (by id)."""

    def __init__(self, n: int, mean: float, df: np.ndarray):
        self.n, self.mean, self.df = n, mean, df

    @cached_property
    def weights(self) -> np.ndarray:
        return np.log1p((self.n - self.df + 0.5) / (self.df + 0.5))

    def idf(self, terms: np.ndarray) -> np.ndarray:
        return self.weights[terms]


class Index:
    """Inverted index of some tails: token -> (tail, BM25 weight); without `statistics` the tails are all there is."""

    def __init__(self, tails: list[Tail], k1: float = K1, b: float = B, statistics: Statistics | None = None):
        n = len(tails)
        size = np.array([len(t.terms) for t in tails])
        terms, tf = np.concatenate([t.terms for t in tails]).astype(np.int64), np.concatenate([t.tf for t in tails]).astype(np.float64)
        who = np.repeat(np.arange(n), size)
        length = np.array([t.tokens for t in tails], dtype=np.float64)
        order = np.argsort(terms, kind="stable")
        self.terms, start, df = np.unique(terms[order], return_index=True, return_counts=True)
        self.bounds, self.who, self.n = np.append(start, len(terms)), who[order], n
        s = statistics or Statistics(n, length.mean(), np.bincount(self.terms, df))
        self.stop = s.df[self.terms] > max(8, s.n // 2)  # tokens of most documents tell them apart little and have the longest lists
        idf = np.repeat(s.idf(self.terms), df)
        norm = k1 * (1 - b + b * length / s.mean)
        self.weight = idf * tf[order] * (k1 + 1) / (tf[order] + norm[self.who])

    def scores(self, terms: np.ndarray) -> np.ndarray:
        t = np.searchsorted(self.terms, terms)
        t = t[~self.stop[t]]
        lo, size = self.bounds[t], self.bounds[t + 1] - self.bounds[t]
        at = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
        return np.bincount(self.who[at], self.weight[at], minlength=self.n)


def fill(tails: list[Tail], window: int, statistics: Statistics | None = None, seeds: int | None = None) -> Iterator[list[tuple[Tail, int, int]]]:
    """Full windows of (tail, from, to) for the first `seeds` tails (all if None), filled from all; afterwards the tails hold what is
    left of them: of the seeds nothing, or all together less than a window."""
    if not tails:
        return
    index = Index(tails, statistics=statistics)
    left = np.array([t.left() for t in tails])
    total, seed = int(left.sum()), 0
    while total >= window:
        while left[seed] == 0:
            seed += 1
        if seeds is not None and seed >= seeds:
            return
        gap, taken, current = window, [], seed

        def take(i: int, n: int) -> None:
            t = tails[i]
            taken.append((t, t.at, t.at + n))
            t.at += n
            left[i] -= n

        first = min(gap, int(left[current]))
        take(current, first)
        gap -= first
        if gap:
            scores = index.scores(tails[current].terms)
            scores[left == 0] = -1.0
            some = np.argpartition(-scores, min(64, len(scores) - 1))[:64] if len(scores) > 64 else np.arange(len(scores))
            ranked = some[np.lexsort((some, -scores[some]))]
            tried_all = len(ranked) == len(scores)
            while gap:
                best = -1
                for i in ranked.tolist():
                    if 0 < left[i] <= gap:
                        n = int(left[i])
                        take(i, n)
                        gap -= n
                    elif left[i] and best < 0:
                        best = i
                    if not gap:
                        break
                if gap and best >= 0:
                    take(best, gap)
                    gap, seed = 0, min(seed, best)
                elif gap and not tried_all:
                    ranked, tried_all = np.lexsort((np.arange(len(scores)), -scores)), True
        total -= window
        yield taken


def powers_of_two(n: int) -> list[int]:
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def counted(ids: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct ids of each text, sorted, and how often each occurs; of all texts in one sort."""
    if not ids:
        return []
    whose = np.repeat(np.arange(len(ids), dtype=np.uint64) << np.uint64(32), [len(x) for x in ids])
    whose |= np.concatenate(ids).astype(np.uint64)
    whose.sort()
    last = np.flatnonzero(np.append(whose[1:] != whose[:-1], True)[: len(whose)])
    tf, terms = np.diff(last, prepend=-1).astype("<u4"), whose[last].astype(np.uint32).astype(ids[0].dtype)
    bounds = np.searchsorted(whose[last], np.arange(len(ids) + 1, dtype=np.uint64) << np.uint64(32)).tolist()
    return [(terms[lo:hi], tf[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]


def signature(terms: np.ndarray, tf: np.ndarray, statistics: Statistics) -> list[int]:
    """The three tokens that weigh most in a document, the heaviest first; -1 where there are fewer."""
    weight = tf / (tf + K1) * statistics.idf(terms)
    out = [-1, -1, -1]
    for i in range(min(3, len(terms))):
        at = int(weight.argmax())  # of equal weights the first, that is the smallest token
        out[i], weight[at] = int(terms[at]), -np.inf
    return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def _pieces(rows: list[tuple]):
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _COLUMNS]
    return [*[pa.array(c, pa.int64()) for c in columns[:7]], pa.array(columns[7], pa.binary())]


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, shard: int = SHARD, end: int = END, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `with_ids` the
    ids (little-endian unsigned 32-bit numbers). `tokenizer` is the path of a tokenizer file of the tokenizers library."""
    with open(tokenizer, encoding="utf-8") as f:
        model = f.read()

    def show(ids: np.ndarray) -> bytes | None:
        return ids.astype("<u4").tobytes() if with_ids else None

    @giving_back
    def tokenize(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder, part, made = Encoder(model), TaskContext.get().partitionId(), 0
        df, docs_seen, tokens_seen = np.zeros(1 << 16, dtype=np.int64), 0, 0
        last = np.array([end], dtype=encoder.kind)

        def none(n: int) -> list:
            return [pa.nulls(n, pa.int64())] * 3

        for b in batches:
            names, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in chunks([len(t) for t in texts], 8_000_000):
                rows, tails = [], []
                ended = [np.append(ids, last) for ids in encoder.encode(texts[lo:hi])]
                for name, ids, (terms, tf) in zip(names[lo:hi], ended, counted(ended), strict=True):
                    if terms[-1] >= len(df):
                        df = np.append(df, np.zeros(int(terms[-1]) + 1, dtype=np.int64))
                    df[terms] += 1
                    docs_seen += 1
                    tokens_seen += len(ids)
                    whole = len(ids) // window * window
                    for at in range(0, whole, window):
                        piece = ids[at : at + window]
                        rows.append((name, at, window, _crc(piece), len(ids), (part << 32 | made) << 1, 0, show(piece)))
                        tails.append((None, None, None))
                        made += 1
                    if whole < len(ids):
                        rows.append((name, whole, None, None, len(ids), None, None, ids[whole:].tobytes()))
                        tails.append((terms.tobytes(), tf.tobytes(), encoder.kind.str))
                columns = list(zip(*tails, strict=True)) if tails else [[], [], []]
                yield pa.record_batch(
                    [*_pieces(rows), *none(len(rows)), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.string())],
                    names=names_out,
                )
        seen = np.flatnonzero(df)
        yield pa.record_batch(  # the task's share of the statistics: token, documents; and -1, documents, tokens
            [
                *[pa.nulls(len(seen) + 1, pa.int64())] * 7, pa.nulls(len(seen) + 1, pa.binary()),
                pa.array(np.append(seen, -1)), pa.array(np.append(df[seen], docs_seen)), pa.array(np.append(seen * 0, tokens_seen)),
                pa.nulls(len(seen) + 1, pa.binary()), pa.nulls(len(seen) + 1, pa.binary()), pa.nulls(len(seen) + 1, pa.string()),
            ],
            names=names_out,
        )

    @giving_back
    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            near = [
                signature(np.frombuffer(t, k), np.frombuffer(f, "<u4"), held.value) if t is not None else [None] * 3
                for t, f, k in zip(*(b.column(c).to_pylist() for c in ("terms", "tf", "kind")), strict=True)
            ]
            columns = list(zip(*near, strict=True)) if near else [[], [], []]
            yield pa.record_batch([*b.columns, *[pa.array(c, pa.int64()) for c in columns]], names=[*b.schema.names, "near", "near2", "near3"])

    @giving_back
    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        part, made, waiting = TaskContext.get().partitionId(), 0, []

        def sequence(pieces: list[tuple[Tail, int, int]]) -> list[tuple]:
            nonlocal made
            rows, offset = [], 0
            for t, lo, hi in pieces:
                ids = t.ids[lo:hi]
                rows.append((t.doc_id, t.start + lo, hi - lo, _crc(ids), t.tokens, (part << 32 | made) << 1 | 1, offset, show(ids)))
                offset += hi - lo
            made += 1
            return rows

        def filled(seeds: int | None = None) -> list[tuple]:
            rows = [r for pieces in fill(waiting, window, held.value, seeds) for r in sequence(pieces)]
            waiting[:] = [t for t in waiting if t.left()]
            return rows

        for b in batches:
            ready = pa.Table.from_batches([b])
            done = ready.filter(pc.is_valid(ready.column("sequence_id"))).select(_COLUMNS)
            yield from done.to_batches()
            rows = []
            tails = ready.filter(pc.is_null(ready.column("sequence_id")))
            for r in tails.to_pylist():
                waiting.append(Tail(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], r["kind"]), np.frombuffer(r["terms"], r["kind"]), np.frombuffer(r["tf"], "<u4")))
                if len(waiting) >= 2 * shard:
                    rows += filled(shard)
            if rows:
                yield pa.record_batch(_pieces(rows), names=_COLUMNS)
        rows = filled()
        size, rest = sum(t.left() for t in waiting), iter(waiting)
        current = next(rest, None)
        for n in powers_of_two(size):
            pieces = []
            while n:
                while not current.left():
                    current = next(rest)
                step = min(n, current.left())
                pieces.append((current, current.at, current.at + step))
                current.at += step
                n -= step
            rows += sequence(pieces)
        if rows:
            yield pa.record_batch(_pieces(rows), names=_COLUMNS)

    names_out = [*_COLUMNS, "token", "documents", "tokens", "terms", "tf", "kind"]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = stored(rows.mapInArrow(tokenize, _PIECE + ", token long, documents long, tokens long, terms binary, tf binary, kind string"), "tokenized")
    sums = found.filter("token is not null").groupBy("token").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).toArrow()  # a vocabulary at most
    token, documents = sums.column("token").to_numpy(), sums.column("documents").to_numpy()
    df = np.zeros(int(token.max(initial=0)) + 1, dtype=np.int64)
    df[token[token >= 0]] = documents[token >= 0]
    n = int(documents[token < 0].sum())
    held = Shipped(docs.sparkSession, Statistics(n, sums.column("tokens").to_numpy().sum() / max(n, 1), df))
    found = found.filter("token is null").drop("token", "documents", "tokens")
    signed = found.mapInArrow(sign, found.withColumns({c: F.lit(None).cast("long") for c in ("near", "near2", "near3")}).schema)
    order = ["near", "near2", "near3", "salt", "doc_id", "start"]
    dealt = signed.withColumn("salt", F.xxhash64("doc_id", "start", "doc_tokens", "ids_crc32")).repartitionByRange(*order).sortWithinPartitions(*order, "ids")
    out = dealt.mapInArrow(place, _PIECE)
    return out if with_ids else out.drop("ids")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in windows of 1024 tokens."""
    import public_tokenizers

    from qaloom.session import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


QUERIES = {"op5_packing": op5_packing}
