"""Exact removal of repeated passages of 35 words, by prefix-partitioned suffix trees.

Suffixes start at words and are dealt to buckets (see `repeats`). In a bucket, prefixes of growing length split the
suffixes into groups of at most `GROUP` suffixes: a group that is too large is split by one word more, so frequent
prefixes get long and rare ones stay short. For each group the suffix tree below its prefix is built top-down, level by
level: an edge is read in steps of 1, 2, 4, ... words, suffixes that are alone are leaves and are read no further, and a
node that still holds two suffixes at depth 35 is a deep internal node. Its leaves are repeated windows; following the
windows of a passage gives the maximal repeat.

Defined results: null has no words; texts under 35 words keep all; rows that repeat id and text are two occurrences;
rows with one id and different texts are different documents; an empty table gives no rows; other columns are neither
read nor clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from qaloom.llm.common import Words, as_bytes
from qaloom.llm.repeats import Unit, covered, per_text, repeated_windows, spans_of, with_key

WINDOW = 35
ANCHOR = 10
GROUP = 200_000


class Bucket:
    """The words of a bucket's pieces as numbers, and the suffix trees over some of their suffixes."""

    def __init__(self, pieces: list[bytes], window: int = WINDOW, group: int = GROUP):
        w = Words(pieces)
        self.first, self.window, self.group = w.first, window, group
        _, self.word = np.unique(w.hashes(), return_inverse=True)
        self.word = np.concatenate([self.word, np.zeros(window, dtype=np.int64)])

    def by_word(self, suffixes: np.ndarray, parent: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Children of nodes by the word at `depth`: suffixes sorted by child, the child of each, and each child's size."""
        key = parent * (int(self.word.max()) + 1) + self.word[suffixes + depth]
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=-1) != 0
        node = np.cumsum(new) - 1
        return suffixes[order], node, np.bincount(node)

    def prefix_groups(self, suffixes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(prefix length, suffixes, node of each): groups of whole prefixes with at most `group` suffixes together, unless one
        prefix of full length has more. Prefixes of one suffix are left out, they are leaves."""
        todo = [(0, suffixes, np.zeros(len(suffixes), dtype=np.int64))]
        while todo:
            depth, some, parent = todo.pop()
            if depth == self.window:
                yield depth, some, parent
                continue
            some, node, size = self.by_word(some, parent, depth)
            keep = (size > 1)[node]
            some, node = some[keep], node[keep]
            large = (size > self.group)[node]
            if large.any():
                todo.append((depth + 1, some[large], node[large]))
            some, node = some[~large], node[~large]
            if len(some):
                cut = np.flatnonzero(np.diff(node)) + 1  # between prefixes; take them until a group is full
                batch = np.unique(np.append(cut[np.searchsorted(cut, np.arange(self.group, len(some), self.group), side="right") - 1], 0)) if len(cut) else np.zeros(1, dtype=np.int64)
                for lo, hi in zip(batch, np.append(batch[1:], len(some)), strict=True):
                    yield depth + 1, some[lo:hi], node[lo:hi]

    def deep_leaves(self, depth: int, suffixes: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Suffixes below internal nodes of the tree at depth `window` or more."""
        step = 1
        while depth < self.window and len(suffixes):
            for _ in range(min(step, self.window - depth)):
                suffixes, node, size = self.by_word(suffixes, node, depth)
                depth += 1
            keep = (size > 1)[node]
            suffixes, node = suffixes[keep], node[keep]
            step *= 2
        return suffixes


def repeated_in_bucket(pieces: list[bytes], n: np.ndarray, window: int = WINDOW, group: int = GROUP) -> list[np.ndarray]:
    """For each piece, which of its first n windows occur a second time among all windows of the bucket."""
    b = Bucket(pieces, window, group)
    bounds = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    suffixes = np.arange(bounds[-1]) + np.repeat(b.first[:-1] - bounds[:-1], n)
    hit = np.zeros(len(b.word), dtype=bool)
    for depth, some, node in b.prefix_groups(suffixes):
        hit[b.deep_leaves(depth, some, node)] = True
    found = hit[suffixes]
    return [found[bounds[i] : bounds[i + 1]] for i in range(len(pieces))]


def marked(docs: DataFrame, doc_id: str, text: str, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    unit = Unit(words=True, window=window, k=k)
    keyed = with_key(docs, doc_id, text)
    return per_text(keyed, repeated_windows(keyed, unit, lambda pieces, n: repeated_in_bucket(pieces, n, window)))


def kept_words(text: bytes, spans: list[dict] | None, window: int) -> tuple[int, list[bytes]]:
    """Number of words, and the words in none of the windows."""
    words = text.split()
    if not spans:
        return len(words), words
    gone = covered(len(words), spans, window)
    return len(words), [w for w, g in zip(words, gone, strict=True) if not g]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept string) for every row of `docs`; kept words are joined by one blank."""

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = [kept_words(t, s, window) for t, s in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True)]
            yield pa.record_batch(
                [b.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([n - len(k) for n, k in rows], pa.int64()), pa.array([b" ".join(k) for _, k in rows], pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    rows = marked(docs, doc_id, text, window, k)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans").mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept string")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """`docs` with repeated passages taken out of the text; a text that loses nothing is left exactly as it is."""
    unit = Unit(words=True, window=window, k=k)
    keyed = with_key(docs, doc_id, text)
    spans = spans_of(repeated_windows(keyed, unit, lambda pieces, n: repeated_in_bucket(pieces, n, window)))
    names, at = docs.columns, docs.columns.index(text)
    rows = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("doc"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])

    def strip(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            columns = b.columns
            kept = [
                b" ".join(kept_words(t, s, window)[1]) if s else t
                for t, s in zip(as_bytes(columns[at]), columns[-1].to_pylist(), strict=True)
            ]
            column = pa.array(kept, pa.binary()).cast(pa.string())
            columns[at] = pc.if_else(columns[at].is_null(), pa.scalar(None, pa.string()), column)
            yield pa.record_batch(columns[:-1], names=[f"c{i}" for i in range(len(names))])

    shaped = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).schema
    out = rows.join(spans, "doc", "left").drop("doc").mapInArrow(strip, shaped)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op6_suffix_tree_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of 35 words in all documents."""
    from qaloom.session import table

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op6_suffix_tree_dedup": op6_suffix_tree_dedup}
