"""Alignment of the tokens that two tokenizers make of the same texts.

1. Both tokenizers cut a text into tokens that are spans of the same bytes; a text for which that does not hold has no tokens.
2. In batches, `pandas.merge_asof` keyed by document finds for every start of one side the other side's token that covers it. The
   union of both directions is all overlapping pairs; pairs that end at the same byte close a group, the smallest stretch that both cut out.
3. Inside a group every token of one side is linked with every token of the other. Links are counted as distinct id pairs per
   document with their number, in slices of bounded size. Blocks of documents (`BLOCK_BYTES`) are written once with the
   pairs as numbers of the block's own list.
4. Pair counts, in how many documents a pair is linked, are summed over the lists of the blocks, which hold every pair once, and
   only these lists meet the sums again; the counts of a block's list come back to the block as one array.

No text and no link moves. A task holds the tokens of `CHUNK_BYTES` of text or of one document, and the distinct pairs of one block.

Defined results: a null or empty text, and one whose tokens don't give back its bytes, has no tokens: zeros and ''. Rows that repeat
an id are documents of their own, null ids stay null; an empty table gives no rows; other columns are neither read nor clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from qaloom.llm.common import chunks, stored
from qaloom.llm.packing import Encoder
from qaloom.session import table

CHUNK_BYTES = 1_000_000
BLOCK_BYTES = 8_000_000
SLICE = 4_000_000


class Tokenizers:
    """Both tokenizers and the bytes of each of their tokens. `files` are a byte-level BPE as JSON and a sentencepiece model."""

    def __init__(self, files: tuple[bytes, bytes]):
        import sentencepiece

        encoder = Encoder(files[0].decode())
        self.first = encoder.ids
        seen = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        seen |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in seen)}
        vocabulary = encoder.model.get_vocab()
        self.a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a[i] = bytes(seen[c] for c in token) if all(c in seen for c in token) else token.encode()
        pieces = sentencepiece.SentencePieceProcessor(model_proto=files[1])
        self.second = lambda texts: pieces.encode(texts, num_threads=1)
        self.b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(pieces.id_to_piece, range(pieces.get_piece_size())))]
        fast = encoder.fast
        self.whole = (lambda ids: b"".join(map(self.a.__getitem__, ids.tolist()))) if fast is None else lambda ids: fast.decode_bytes(ids)
        self.size = tuple(np.array([len(t) for t in side], dtype=np.int64) for side in (self.a, self.b))
        # what a token adds to the description of its document: its id and what follows it
        self.said = [f"{i}{after}".encode() for side, ends in ((self.a, ",|"), (self.b, ",;")) for i in range(len(side)) for after in ends]


def _numbers(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids, sorted, and the place of each id among them."""
    found = np.flatnonzero(np.bincount(ids))
    place = np.zeros(int(ids.max(initial=0)) + 1, dtype=np.int64)
    place[found] = np.arange(len(found))
    return found, place[ids]


class Aligned:
    """Tokens of some texts: ids `a` and `b`, the text each belongs to, overlaps (i, j) and the group of each token."""

    def __init__(self, t: Tokenizers, texts: list[str | None]):
        import pandas as pd

        n = len(texts)
        some = [i for i, x in enumerate(texts) if x]
        sides: tuple[list, list] = ([np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n)
        for i, second in zip(some, t.second([texts[i] for i in some]) if some else []):
            whole = " " + texts[i]
            first, raw = t.first(whole).astype(np.int64), whole.encode()
            if b"".join(map(t.b.__getitem__, second)) == raw == t.whole(first):
                sides[0][i], sides[1][i] = first, np.array(second, np.int64)
        (self.a, self.b), counts = map(np.concatenate, sides), [np.fromiter(map(len, s), np.int64, n) for s in sides]
        self.counts = counts
        self.text_a, self.text_b = (np.repeat(np.arange(n), c) for c in counts)
        end_a, end_b = np.cumsum(t.size[0][self.a]), np.cumsum(t.size[1][self.b])
        left = pd.DataFrame({"at": end_a - t.size[0][self.a], "text": self.text_a, "i": np.arange(len(self.a))})
        right = pd.DataFrame({"at": end_b - t.size[1][self.b], "text": self.text_b, "j": np.arange(len(self.b))})
        both = pd.concat([
            pd.merge_asof(left, right, on="at", by="text")[["i", "j"]], pd.merge_asof(right, left, on="at", by="text")[["i", "j"]]
        ]).to_numpy()
        both = np.sort(both[:, 0] * max(len(self.b), 1) + both[:, 1])
        both = both[np.diff(both, prepend=-1) > 0]
        self.i, self.j = np.divmod(both, max(len(self.b), 1))
        closes = end_a[self.i] == end_b[self.j]
        self.last_a, self.last_b = self.i[closes], self.j[closes]
        self.group_a, self.group_b = (
            np.cumsum(np.bincount(last + 1, minlength=len(side) + 1))[: len(side)] for last, side in ((self.last_a, self.a), (self.last_b, self.b)))
        self.in_a, self.in_b = np.diff(self.last_a, prepend=-1), np.diff(self.last_b, prepend=-1)
        self.text_of_group = self.text_a[self.last_a]

    def pairs(self, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, a * kinds + b, links), distinct and sorted. Links are made `SLICE` at a time."""
        each = self.in_b[self.group_a]
        first = (self.last_b - self.in_b + 1)[self.group_a]
        total = np.concatenate([[0], np.cumsum(each)])
        # a text's part of the key comes first, so that the distinct keys are sorted by text
        (ids_a, code_a), (ids_b, code_b) = _numbers(self.a), _numbers(self.b)
        key, n, lo = [], [], 0
        while lo < len(each):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + SLICE, "right")) - 1)
            j = np.arange(total[hi] - total[lo]) + np.repeat(first[lo:hi] - total[lo:hi] + total[lo], each[lo:hi])
            head = (self.text_a[lo:hi] * len(ids_a) + code_a[lo:hi]) * len(ids_b)
            k = np.sort(np.repeat(head, each[lo:hi]) + code_b[j])
            new = np.flatnonzero(np.diff(k, prepend=-1))
            key.append(k[new])
            n.append(np.diff(new, append=len(k)))
            lo = hi
        if not key:
            return (np.zeros(0, np.int64),) * 3
        k, n = np.concatenate(key), np.concatenate(n)
        if len(key) > 1:
            k, at = np.unique(k, return_inverse=True)
            n = np.bincount(at, n).astype(np.int64)
        head, b = np.divmod(k, len(ids_b))
        text, a = np.divmod(head, len(ids_a))
        return text, ids_a[a] * kinds + ids_b[b], n

    def described(self, t: Tokenizers) -> list[str]:
        """SHA-256 of each text's groups, written as `a1,a2|b1;a3|b2,b3`; '' without tokens."""
        before_a, before_b = self.last_a - self.in_a + 1, self.last_b - self.in_b + 1
        words = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        i, j = np.arange(len(self.a)), np.arange(len(self.b))
        words[i + before_b[self.group_a]] = self.a * 2 + (self.last_a[self.group_a] == i)
        words[j + (before_a + self.in_a)[self.group_b]] = 2 * len(t.a) + self.b * 2 + (self.last_b[self.group_b] == j)
        ends = np.cumsum(self.counts[0] + self.counts[1]).tolist()
        out, lo = [], 0
        for hi in ends:
            out.append(hashlib.sha256(b"".join(map(t.said.__getitem__, words[lo:hi].tolist()))[:-1]).hexdigest() if hi > lo else "")
            lo = hi
        return out


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _files(docs: DataFrame, bpe: str, pieces: str):
    """Both vocabulary files, read by the driver; files of a megabyte or two."""
    return docs.sparkSession.sparkContext.broadcast((Path(bpe).read_bytes(), Path(pieces).read_bytes()))


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


_PER_TEXT = ("n_a", "n_b", "n_groups", "n_links")


def blocks_of(docs: DataFrame, bpe: str, pieces: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per block of documents: its distinct pairs (`pair`, and `n` documents that link it) and, per document, id, numbers of tokens,
    groups and links, description, and the distinct pairs as places in `pair` with their links."""
    files = _files(docs, bpe, pieces)

    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa

        t = Tokenizers(files.value)
        made, size, held = TaskContext.get().partitionId() << 32, 0, []

        def block():
            nonlocal made, size, held
            ids, texts, found, links, shas, numbers = zip(*held, strict=True)
            known, place = np.unique(np.concatenate(found), return_inverse=True)
            each = np.concatenate(texts)
            starts = np.concatenate([[0], np.cumsum(each)])
            step = np.diff(place, prepend=0)
            first = starts[:-1][each > 0]
            step[first] = place[first]  # places start anew with every document
            made, size, held = made + 1, 0, []
            one = lambda x, kind: pa.ListArray.from_arrays([0, len(x)], pa.array(x, kind))
            columns = {
                "block": pa.array([made - 1], pa.int64()), "pair": one(known, pa.int64()), "n": one(np.bincount(place, minlength=len(known)), pa.int64()),
                "doc_id": one([i for some in ids for i in some], pa.int64()), "sha": one([x for some in shas for x in some], pa.string()),
                **{c: one(np.concatenate([x[k] for x in numbers]), pa.int64()) for k, c in enumerate(_PER_TEXT)},
                "each": one(each, pa.int64()), "places": pa.array([_packed(step)], pa.binary()), "links": pa.array([_packed(np.concatenate(links))], pa.binary()),
            }
            return pa.record_batch(list(columns.values()), names=list(columns))

        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            sizes = [len(x or "") for x in texts]
            for lo, hi in chunks(sizes, CHUNK_BYTES):
                x = Aligned(t, texts[lo:hi])
                of, found, links = x.pairs(len(t.b))
                count = lambda at, w=None, n=hi - lo: np.bincount(at, w, minlength=n).astype(np.int64)
                numbers = (*x.counts, count(x.text_of_group), count(of, links))
                held.append((names[lo:hi], count(of), found, links, x.described(t), numbers))
                size += sum(sizes[lo:hi])
                if size >= BLOCK_BYTES:
                    yield block()
        if held:
            yield block()

    lists = ", ".join(f"{c} array<long>" for c in _PER_TEXT)
    return _texts(docs, doc_id, text).mapInArrow(
        gather, f"block long, pair array<long>, n array<long>, doc_id array<long>, sha array<string>, {lists}, each array<long>, places binary, links binary")


def align(docs: DataFrame, bpe: str, pieces: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    import sentencepiece

    kinds = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    blocks = stored(blocks_of(docs, bpe, pieces, doc_id, text), "blocks")
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("pair", "n")).alias("place", "x")).select(
        "block", "place", F.col("x.pair").alias("pair"), F.col("x.n").alias("n"))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    # an id of the first side has at most as many partners as the second side has ids
    best = F.col("count") == F.max("count").over(W.partitionBy(F.expr(f"pair div {kinds}")))
    counts = counts.withColumn("best", best)
    answers = pairs.select("block", "place", "pair").join(counts, "pair").groupBy("block").agg(
        F.collect_list(F.struct("place", "count", "best")).alias("answers"))

    def finish(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(k)[r] for k, c in enumerate(b.schema.names)}
                ids, numbers = row["doc_id"].values, {c: row[c].values for c in _PER_TEXT}
                each = row["each"].values.to_numpy()
                best = count = np.zeros(len(each), np.int64)
                if row["answers"].is_valid:
                    got = row["answers"].values
                    at = got.field(0).to_numpy()
                    pair_count, pair_best = np.empty((2, len(at)), np.int64)
                    pair_count[at], pair_best[at] = got.field(1).to_numpy(), got.field(2).to_numpy(zero_copy_only=False)
                    step, links = _unpacked(row["places"].as_py()), _unpacked(row["links"].as_py())
                    starts = np.concatenate([[0], np.cumsum(each)])
                    run = np.concatenate([[0], np.cumsum(step)])
                    place = run[1:] - np.repeat(run[starts[:-1]], each)
                    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[starts])
                    count, best = sums(links * pair_count[place]), sums(links * pair_best[place])
                columns = {"doc_id": ids, **numbers, "n_best": pa.array(best), "count_sum": pa.array(count), "groups_sha256": row["sha"].values}
                yield pa.record_batch(list(columns.values()), names=list(columns))

    rows = blocks.drop("pair", "n").join(answers, "block", "left")
    longs = ", ".join(f"{c} long" for c in ("doc_id", *_PER_TEXT, "n_best", "count_sum"))
    return rows.mapInArrow(finish, longs + ", groups_sha256 string")


def overlaps(docs: DataFrame, bpe: str, pieces: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, i, j, a, b, group) for every overlapping pair of tokens: their places and ids, and their group in the document."""
    files = _files(docs, bpe, pieces)

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        t = Tokenizers(files.value)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in chunks([len(x or "") for x in texts], CHUNK_BYTES):
                x = Aligned(t, texts[lo:hi])
                of = x.text_a[x.i]
                starts = [np.concatenate([[0], np.cumsum(c)]) for c in (*x.counts, np.bincount(x.text_of_group, minlength=hi - lo))]
                columns = [
                    pa.array(names[lo:hi], pa.int64()).take(pa.array(of)), *map(pa.array, (x.i - starts[0][of], x.j - starts[1][of], x.a[x.i], x.b[x.j])),
                    pa.array(x.group_a[x.i] - starts[2][of]),
                ]
                yield from pa.Table.from_arrays(columns, names=["doc_id", "i", "j", "a", "b", "group"]).to_batches(max_chunksize=50_000)

    return _texts(docs, doc_id, text).mapInArrow(find, "doc_id long, i long, j long, a long, b long, group long")


def op12_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    """Tokens of a byte-level and a sentencepiece vocabulary aligned over all documents."""
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op12_tokenizer_alignment": op12_tokenizer_alignment}
