"""Exact Jaccard self-join of word n-gram sets by prefix trees, and the classes that its links form.

A document's set is its distinct 5-word shingles (A-Z lower-cased, words are runs of bytes between ASCII white space);
with fewer words the whole sequence is one shingle. Shingles and sets are compared by 64-bit hashes; the hash is also the
global order of the shingles. Two sets link when 100 * |intersection| >= 80 * |union|.

1. Equal sets are one node.
2. Prefixes. With l = max(1, n / 20), the first n - ceil(0.8 n) + l shingles of two linked sets, in the global order, have
   at least min(l, l') in common. Shingles that only one node has in its prefix are dropped, and nodes that keep fewer
   than the least l a partner can have (lambda) link with nobody.
3. Groups. The leader of a shingle is the smallest node that has it in its prefix; all nodes that share the shingle meet in the
   leader's group. A node leaves the largest of its groups, as long as it shares less than lambda shingles with those it
   has left: the order of groups is the same for all nodes, so two linked sets, which share lambda at least, both stay in the
   smallest group they share. It also leaves groups in which no set has a length near its own.
4. In a group the globally ordered sets are stored as a trie. It is walked once: overlaps with every other set are counted
   along common paths, shared by all sets below, and a subtree is left when the remaining length can't lift any count
   to what a link needs, or when everything it could still link is linked already.
5. Groups of more than `BLOCK` nodes are split in blocks, and every pair of blocks is a group of its own, so that one hot
   group is many tasks of bounded memory. Tasks return the links that join something, fewer than they have nodes.

Defined results: null, empty and blank texts have no shingles and are a class of their own; exact copies share a class; a
null id has a null class unless its set has another id; repeated ids each get a row; an empty table gives no rows; other
columns are neither read nor clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from qaloom.llm.common import Words, as_bytes, chunks, components, giving_back, mix, shingle_hashes, stored
from qaloom.operators.skew import first_n

SHINGLE = 5
PERCENT = 80
PART = 20
BLOCK = 3000


def sets_of(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi in chunks([len(t) for t in texts], 1_000_000):
        w = Words(texts[lo:hi], lower=True)
        h, bounds = shingle_hashes(w.hashes(), w.first, k)
        for i in range(hi - lo):
            yield np.unique(h[bounds[i] : bounds[i + 1]])


def node_of(s: np.ndarray) -> int | None:
    return int((mix(s).sum(dtype=np.uint64) ^ mix(np.uint64([len(s)]))[0]).astype(np.int64)) if len(s) else None


def needed(n, percent: int):
    """Least overlap that a set of n has with any set that it links with."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - needed(n, percent) + max(1, n // PART))


def node_table(docs: DataFrame, doc_id: str, text: str, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n, node, body) for every row; the body is a hash of the text."""

    @giving_back
    def describe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            sets = [(len(s), node_of(s)) for s in sets_of(as_bytes(b.column(1)), k)]
            yield pa.record_batch([b.column(0), pa.array([s[0] for s in sets], pa.int64()), pa.array([s[1] for s in sets], pa.int64()), b.column(2)], names=["doc_id", "n", "node", "body"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("body"))
    return rows.mapInArrow(describe, "doc_id long, n long, node long, body long")


def prefixes(docs: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """(shingle, node) for the prefix of every row's set."""

    @giving_back
    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            parts, nodes = [], []
            for s in sets_of(as_bytes(b.column(0)), k):
                if len(s):
                    parts.append(s[: prefix_length(len(s), percent)].view(np.int64))
                    nodes.append(node_of(s))
            if parts:
                flat, node = np.concatenate(parts), np.repeat(np.array(nodes, dtype=np.int64), [len(p) for p in parts])
                for lo in range(0, len(flat), 100_000):
                    yield pa.record_batch([pa.array(flat[lo : lo + 100_000]), pa.array(node[lo : lo + 100_000])], names=["shingle", "node"])

    return docs.select(F.col(text).alias("text")).mapInArrow(cut, "shingle long, node long")


def memberships(docs: DataFrame, nodes: DataFrame, text: str, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(leader, node, m): the groups in which all linked nodes meet, of m nodes each, two at least."""
    # the rows move once: the nodes of a shingle are sorted together, and its leader is written beside each
    same = W.partitionBy("shingle")
    rows = prefixes(docs, text, k, percent).withColumn("leader", F.min("node").over(same)).withColumn("top", F.max("node").over(same))
    shared = rows.filter("leader <> top").groupBy("node", "leader").agg(F.countDistinct("shingle").alias("c"))
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / PART))
    by_node = W.partitionBy("node")
    shared = (
        shared.join(nodes.filter("node is not null").select("node", "n").distinct(), "node").withColumn("least", least)
        .withColumn("all", F.sum("c").over(by_node)).filter(F.col("all") >= F.col("least")).select("leader", "node", "n", "c", "least")
    )
    shared = stored(shared, "shared-shingles")
    sizes = shared.groupBy("leader").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    largest_first = by_node.orderBy(F.desc("m"), "leader").rowsBetween(W.unboundedPreceding, W.currentRow)
    kept = (
        shared.join(sizes, "leader").withColumn("sofar", F.sum("c").over(largest_first))
        .filter(F.col("sofar") >= F.col("least")).select("leader", "node", "n")
    )
    near_size = W.partitionBy("leader").orderBy("n", "node")
    kept = (
        kept.withColumn("below", F.lag("n").over(near_size)).withColumn("above", F.lead("n").over(near_size))
        .filter((F.col("below") * 100 >= F.col("n") * percent) | (F.col("n") * 100 >= F.col("above") * percent)).select("leader", "node")
    )
    kept = stored(kept, "memberships")
    return kept.join(kept.groupBy("leader").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "leader")


def trie_links(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs of indexes of linked sets, as many as join something new: the classes of these links are those of all links."""
    m = len(sets)
    order = sorted(range(m), key=lambda i: sets[i].astype(">u8").tobytes())
    sets = [sets[i] for i in order]
    n = np.array([len(s) for s in sets])
    bounds = np.concatenate([[0], np.cumsum(n)])
    flat = np.concatenate(sets)
    by_token = np.argsort(flat, kind="stable").astype(np.int32)
    flat = flat[by_token]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    df = np.diff(np.append(np.flatnonzero(new), len(flat)))
    inverse = np.empty(len(flat), dtype=np.int32)
    inverse[by_token] = np.cumsum(new, dtype=np.int32) - 1  # a number for each token, in the global order
    posting = np.repeat(np.arange(m, dtype=np.int32), n)[by_token]  # sets that hold each token, token after token
    del flat, by_token, new
    where = np.concatenate([[0], np.cumsum(df)])
    paths = [inverse[bounds[i] : bounds[i + 1]] for i in range(m)]
    lcp = np.zeros(m + 1, dtype=np.int64)
    for i in range(1, m):
        size = min(n[i - 1], n[i])
        apart = np.flatnonzero(sets[i - 1][:size] != sets[i][:size])
        lcp[i] = apart[0] if len(apart) else size
    group = np.arange(m)
    links: list[tuple[int, int]] = []

    def overlaps(path: np.ndarray) -> np.ndarray:
        t = path[df[path] > 1]
        size = df[t]
        at = np.arange(size.sum()) + np.repeat(where[t] - (np.cumsum(size) - size), size)
        return np.bincount(posting[at], minlength=m)

    def hopeful(counts: np.ndarray, lo: int, hi: int, depth: int) -> bool:
        """Can any set still link with one of lo..hi, whose first `depth` shingles are counted?"""
        small, large = n[lo:hi].min(), n[lo:hi].max()
        best = counts + np.minimum(large - depth, n - counts)
        able = best * (100 + percent) >= percent * (small + n)
        if (group[lo:hi] == group[lo]).all():
            able &= group != group[lo]
        return bool(able.any())

    stack = [(0, m, 0, np.zeros(m, dtype=np.int64))]
    while stack:
        lo, hi, depth, counts = stack.pop()
        if not hopeful(counts, lo, hi, depth):
            continue
        if hi - lo > 1:
            down = int(lcp[lo + 1 : hi].min())
            if down > depth:
                counts = counts + overlaps(paths[lo][depth:down])
                if not hopeful(counts, lo, hi, down):
                    continue
            cuts = [lo, *(lo + 1 + np.flatnonzero(lcp[lo + 1 : hi] == down)).tolist(), hi]
            stack += [(a, b, down, counts) for a, b in zip(cuts[:-1], cuts[1:], strict=True)][::-1]
            continue
        step, going = 32, True
        while depth < n[lo] and going:
            counts = counts + overlaps(paths[lo][depth : depth + step])
            depth, step = min(depth + step, int(n[lo])), step * 2
            going = hopeful(counts, lo, hi, depth)
        if not going:
            continue
        linked = (100 + percent) * counts >= percent * (n + n[lo])
        for other in np.flatnonzero(linked & (group != group[lo])).tolist():
            if group[other] != group[lo]:
                links.append((order[lo], order[other]))
                group[group == group[other]] = group[lo]
    return links


def linked_nodes(docs: DataFrame, nodes: DataFrame, text: str, doc_id: str, k: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(a, b): links between representatives (the smallest doc_id of a node) that yield all classes."""
    reps = nodes.filter("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"))
    member = stored(memberships(docs.filter(F.col(doc_id).isNotNull()), nodes, text, k, percent).join(reps, "node").select("leader", "rep", "node", "m"), "groups")
    parts = F.ceil(F.col("m") / block).cast("int")
    mine = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    dealt = (
        member.withColumn("parts", parts).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .groupBy("rep", "node").agg(F.collect_list(F.struct("leader", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))).alias("groups"))
    )  # at most one group for each of a node's shingles, and its blocks

    @giving_back
    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            reps, nodes, groups = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
            for rep, s, node, some in zip(reps, sets_of(as_bytes(b.column(1)), k), nodes, groups, strict=True):
                if node_of(s) == node:  # else another row with this id
                    rows = [[g["leader"] for g in some], [g["i"] for g in some], [g["j"] for g in some]]
                    ints = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32())]
                    yield pa.record_batch([*ints, pa.array([rep] * len(some), pa.int64()), pa.array([s.tobytes()] * len(some), pa.binary())], names=["leader", "i", "j", "rep", "items"])

    # both sides move at every size: a list of groups small enough to broadcast would leave the texts in place for small tables only
    rows = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text")).join(dealt.hint("merge"), "rep")
    sets = rows.select("rep", "text", "node", "groups").mapInArrow(build, "leader long, i int, j int, rep long, items binary")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        ids = pdf["rep"].to_numpy()
        found = trie_links([np.frombuffer(x, dtype=np.uint64) for x in pdf["items"]], percent)
        return pd.DataFrame({"a": ids[[x for x, _ in found]] if found else ids[:0], "b": ids[[y for _, y in found]] if found else ids[:0]})

    return sets.groupBy("leader", "i", "j").applyInPandas(join, "a long, b long")


def _classed(docs: DataFrame, doc_id: str, text: str, k: int, percent: int, block: int) -> DataFrame:
    """(doc_id, node, body, n_shingles, component_id) for every row of `docs`."""
    nodes = stored(node_table(docs, doc_id, text, k), "nodes")
    found = components(linked_nodes(docs, nodes, text, doc_id, k, percent, block))
    reps = nodes.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"))
    to = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("node"), F.coalesce("component", "rep").alias("component"))
    return nodes.join(to, "node", "left").select(
        "doc_id", "node", "body", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs`."""
    return _classed(docs, doc_id, text, k, percent, block).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row of `docs` for each class, the one with the smallest id; rows without an id stay.

    Rows that repeat an id are one document. Those of its rows that are copies of a smaller id are not it; of the others the one with
    words and the smallest set hash stays, and of rows equal in id and text the one with the smallest hash of all columns.
    """
    first = (
        _classed(docs, doc_id, text, k, percent, block).filter("doc_id = component_id")
        .groupBy(F.col("doc_id").alias("__first")).agg(F.min(F.struct(F.col("node").isNull(), "node", "body"))["body"].alias("__body"))
    )
    keyed = docs.withColumn("__own", F.xxhash64(text))
    kept = keyed.join(first, (F.col(doc_id).cast("long") == F.col("__first")) & (F.col("__own") == F.col("__body")), "left_semi")
    kept = first_n(kept, [doc_id], [F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])])
    return kept.drop("__own").unionByName(docs.filter(F.col(doc_id).isNull()))


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    from qaloom.session import table

    return classes(table(spark, sf_dir, "documents"))


QUERIES = {"op10_ngram_jaccard_join": op10_ngram_jaccard_join}
