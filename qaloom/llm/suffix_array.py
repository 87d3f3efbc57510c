"""Exact removal of repeated 200-byte strings, by suffix arrays built block by block with a difference cover.

Suffixes are dealt to buckets (see `repeats`); each bucket is one block that a task sorts in bounded memory:

1. The positions whose residue modulo V is in the difference cover D are ranked first, by V bytes and then by doubling
   (rank of i, rank of i + V), until the ranks tell apart at least 200 bytes.
2. The block's suffixes are sorted by their first V bytes, eight at a time; only ties go on.
3. Long ties need no more text: for any residues p, q there is a shift d < V with p + d and q + d both in the cover, so
   two suffixes that share V bytes compare as the ranks at i + d and j + d. Ties are split by a three-way quicksort on
   these ranks, all tied groups at once.
4. Neighbours in the finished order are compared byte by byte over 200 bytes: a suffix repeats if one of its two neighbours agrees.

Defined results: null is an empty text; texts under 200 bytes keep everything unless rows repeat nothing of 200 bytes; rows that
repeat id and text are two occurrences; rows with one id and different texts are different documents; an empty table
gives no rows; other columns are neither read nor clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from qaloom.llm.common import as_bytes
from qaloom.llm.repeats import Unit, covered, per_text, repeated_windows, with_key

WINDOW = 200
ANCHOR = 32
V = 64


def cover(v: int) -> np.ndarray:
    """Residues of which every difference modulo v is a difference: 0..b-1 and the multiples of b, b = sqrt(v)."""
    b = int(np.ceil(np.sqrt(v)))
    return np.unique(np.concatenate([np.arange(b), np.arange(0, v, b)]))


def shifts(v: int, d: np.ndarray) -> np.ndarray:
    """shifts[p, q]: the least s for which p + s and q + s are both in the cover."""
    member = np.zeros(v, dtype=bool)
    member[d] = True
    moved = member[(np.arange(v)[:, None] + np.arange(v)[None, :]) % v]  # moved[p, s]
    return np.argmax(moved[:, None, :] & moved[None, :, :], axis=2)


def dense(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 0 of tuples (most significant key first)."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


class Block:
    """One block of suffixes over the bytes of `text`, compared to at least `depth` bytes."""

    def __init__(self, text: bytes, depth: int, v: int = V):
        self.depth, self.v = depth, v
        size = len(text)
        padded = np.concatenate([np.frombuffer(text, dtype=np.uint8), np.zeros(depth + 4 * v + 8, dtype=np.uint8)])
        self.eight = np.zeros(len(padded) - 7, dtype=np.uint64)  # eight bytes from each position, as a big-endian number
        for j in range(8):
            self.eight = (self.eight << np.uint64(8)) | padded[j : j + len(self.eight)]
        d = cover(v)
        self.shift = shifts(v, d)
        sample = np.add.outer(np.arange(0, size + v, v), d).ravel()
        rank = dense(self.eight[sample])
        for j in range(8, v, 8):
            rank = dense(rank, self.eight[sample + j])
        reach = v
        while reach < depth:
            far = len(d) * (reach // v)  # the sample is regular: `reach` bytes on is so many entries on
            rank = dense(rank, np.concatenate([rank[far:], np.full(min(far, len(rank)), -1)]) + 1)
            reach *= 2
        self.rank = np.full(size + 3 * v, -1, dtype=np.int64)
        self.rank[sample] = rank

    def sort(self, suffixes: np.ndarray) -> np.ndarray:
        """The suffixes in order (equal ones, to `depth` bytes at least, next to each other)."""
        order = suffixes.copy()
        group = np.zeros(len(order), dtype=np.int64)
        active = np.arange(len(order))
        for j in range(0, self.v, 8):
            active = self._split(order, group, active, self.eight[order[active] + j])
        while len(active):
            first = np.flatnonzero(np.diff(group[active], prepend=-1))
            size = np.diff(np.append(first, len(active)))
            pivot = np.repeat(order[active[first + size // 2]], size)
            here = order[active]
            s = self.shift[here % self.v, pivot % self.v]
            side = np.sign(self.rank[here + s] - self.rank[pivot + s])
            active = self._split(order, group, active, side, settled=0)
        return order

    @staticmethod
    def _split(order: np.ndarray, group: np.ndarray, active: np.ndarray, key: np.ndarray, settled: int | None = None) -> np.ndarray:
        """Sort each tied group by `key`; returns the positions that are still tied. Groups are named by their first position."""
        if not len(active):
            return active
        by = np.lexsort((key, group[active]))
        order[active], key = order[active][by], key[by]
        new = np.concatenate([[True], (np.diff(group[active]) != 0) | (key[1:] != key[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(active)))
        group[active] = np.repeat(active[first], size)
        tied = np.repeat(size > 1, size)
        if settled is not None:
            tied &= key != settled
        return active[tied]

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Do the suffixes agree on all `depth` bytes?"""
        equal = np.ones(len(a), dtype=bool)
        at = np.arange(len(a))
        steps = [*range(0, self.depth - 7, 8)]
        if self.depth % 8:
            steps.append(self.depth - 8)
        for j in steps:
            at = at[self.eight[a[at] + j] == self.eight[b[at] + j]]
        equal[:] = False
        equal[at] = True
        return equal


def repeated_in_block(pieces: list[bytes], n: np.ndarray, window: int = WINDOW, v: int = V) -> list[np.ndarray]:
    """For each piece, which of its first n windows occur a second time among all windows of the block."""
    offset = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    suffixes = np.arange(bounds[-1]) + np.repeat(offset[:-1] - bounds[:-1], n)
    block = Block(b"".join(pieces), window, v)
    order = block.sort(suffixes)
    same = block.same(order[:-1], order[1:])
    hit = np.zeros(int(offset[-1]) + 1, dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    found = hit[suffixes]
    return [found[bounds[i] : bounds[i + 1]] for i in range(len(pieces))]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for every row of `docs`."""
    unit = Unit(words=False, window=window, k=k)
    keyed = with_key(docs, doc_id, text)
    found = repeated_windows(keyed, unit, lambda pieces, n: repeated_in_block(pieces, n, window))

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            removed, spans, kept, texts = [], [], [], as_bytes(b.column(1))
            for t, s in zip(texts, b.column(2).to_pylist(), strict=True):
                gone = covered(len(t), s, window)
                removed.append(int(gone.sum()))
                spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                kept.append(np.frombuffer(t, dtype=np.uint8)[~gone].tobytes())
            yield pa.record_batch(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return per_text(keyed.select("doc", F.col("doc_id").cast("long").alias("doc_id"), "text"), found).mapInArrow(
        apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def op3_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings of all documents."""
    from qaloom.session import table

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op3_suffix_array_dedup": op3_suffix_array_dedup}
