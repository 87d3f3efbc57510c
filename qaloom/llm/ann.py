"""Approximate nearest neighbours (largest inner product) by learned partitions.

1. A sample of at most `SAMPLE` vectors (smallest hashes of their id) gets its exact neighbour graph.
2. The graph is cut into `PARTS` parts of nearly equal size: from a balanced start, vertices move to the part that most of their
   neighbours are in, as long as no part outgrows its share by `SLACK`.
3. A small network with one hidden layer learns, for a vector, how its neighbours are spread over the parts.
4. Every vector is stored in its most probable part. A query goes to its most probable parts, as many as find `TARGET`
   of the neighbours in the sample; there it is compared with all vectors, in double precision.

Parts are cut in blocks of about `BLOCK` vectors, so a part with many rows, copies of one vector included, is many tasks; each
returns at most k rows for a query (more only where they tie with the last).

Defined results: vectors that are null, zero, hold null or non-finite components, or have another length than most (ties: the
smaller length) take no part, nor do rows with a null id; rows that repeat an id are one vector, the smallest; equal
scores go by the smaller id; with fewer candidates than k all that are found are returned; an empty table gives no rows;
other columns are neither read nor clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from qaloom.llm.common import Shipped, stored

SAMPLE = 8192
PARTS = 32
NEIGHBOURS = 20
SLACK = 0.05
HIDDEN = 128
TARGET = 0.95
BLOCK = 16_384


def valid_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v array<double>), one row for each id."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(vec_id).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    good = rows.filter(fine).groupBy(F.col(vec_id).cast("long").alias("vec_id")).agg(F.min(v).alias("v"))
    good = stored(good, "vectors")
    size = good.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    return good.filter(F.size("v") == (size["n"] if size else 0))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row."""
    out = np.empty((len(x), min(k, len(x) - 1)), dtype=np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        out[lo : lo + 1024] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = SLACK, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """A part for each vertex, nearly equal in size, that cuts few edges of the graph."""
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(len(x) / parts * (1 + slack)))
    centres = x[rng.choice(len(x), parts, replace=False)]
    part = np.zeros(len(x), dtype=np.int64)

    def place(gain: np.ndarray) -> np.ndarray:
        """Each vertex to its best part that has room, those with most to lose first."""
        best = np.sort(gain, axis=1)
        order = np.argsort(best[:, -2] - best[:, -1] if gain.shape[1] > 1 else best[:, -1], kind="stable")
        wishes, room, out = np.argsort(-gain, axis=1, kind="stable"), np.full(parts, limit), np.empty(len(gain), dtype=np.int64)
        for i in order.tolist():
            for p in wishes[i]:
                if room[p]:
                    out[i] = p
                    room[p] -= 1
                    break
        return out

    for _ in range(4):
        part = place(x @ centres.T - 0.5 * (centres**2).sum(axis=1))
        centres = np.array([x[part == p].mean(axis=0) if (part == p).any() else centres[p] for p in range(parts)])
    a = np.concatenate([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()])
    b = np.concatenate([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])])
    for _ in range(rounds):
        gain = np.bincount(a * parts + part[b], minlength=len(x) * parts).reshape(len(x), parts).astype(np.float64)
        gain[np.arange(len(x)), part] += 0.5  # stay where nothing is won
        after = place(gain)
        moved = (after != part).mean()
        part = after
        if moved < 0.005:
            break
    return part


class Router:
    """softmax(relu(x A + a) B + b): how the neighbours of x are spread over the parts."""

    def __init__(self, size: int, parts: int, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, (2 / size) ** 0.5, (size, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
        self.scale = 1.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(x * self.scale @ self.w[0] + self.w[1], 0)
        z = h @ self.w[2] + self.w[3]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 2e-3, seed: int = 3) -> None:
        self.scale = 1.0 / (np.sqrt((x**2).sum(axis=1).mean() / x.shape[1]) + 1e-12)
        rng, m, v, t = np.random.default_rng(seed), [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                xb = x[at] * self.scale
                h = np.maximum(xb @ self.w[0] + self.w[1], 0)
                z = h @ self.w[2] + self.w[3]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                d = (z / z.sum(axis=1, keepdims=True) - target[at]) / len(at)
                dh = (d @ self.w[2].T) * (h > 0)
                t += 1
                for i, g in enumerate((xb.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                    g = g + 1e-4 * self.w[i] * (g.ndim > 1)
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


def learn_partitions(x: np.ndarray, parts: int = PARTS, neighbours: int = NEIGHBOURS, target: float = TARGET) -> tuple[Router, int]:
    """The router of a sample and the number of parts a query has to visit."""
    parts = max(1, min(parts, len(x) // 32))
    router = Router(x.shape[1] if len(x) else 1, parts)
    if parts == 1:
        return router, 1
    graph = neighbour_graph(x, neighbours)
    part = balanced_parts(x, graph, parts)
    spread = np.zeros((len(x), parts))
    np.add.at(spread, (np.arange(len(x))[:, None], part[graph]), 1.0)
    held = np.arange(len(x)) % 8 == 0  # the number of visits is measured on vectors that the router hasn't seen
    router.fit(x[~held], spread[~held] / spread[~held].sum(axis=1, keepdims=True))
    p = router.probabilities(x)
    home = p.argmax(axis=1)  # where vectors are stored
    order = np.argsort(-p[held], axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(order), axis=0), axis=1)
    found = np.take_along_axis(rank, home[graph[held]], axis=1)
    recall = np.array([(found < n).mean() for n in range(1, parts + 1)])
    return router, int(np.argmax(recall >= target)) + 1 if (recall >= target).any() else parts


def best_of(q: np.ndarray, ids: np.ndarray, x: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query index, ids, scores) of each query's k nearest, ties by id. A matrix product finds them, their scores are summed
    alike for every row, so that equal vectors get equal scores."""
    for lo in range(0, len(q), 512):
        s = q[lo : lo + 512] @ x.T
        s[own[lo : lo + 512, None] == ids[None, :]] = -np.inf
        for i, row in enumerate(s):
            if len(row) > k:
                edge = np.partition(row, len(row) - k)[len(row) - k]
                at = np.flatnonzero(row >= edge - 1e-9 * (1 + abs(edge)))
            else:
                at = np.arange(len(row))
            at = at[np.isfinite(row[at])]
            exact = (x[at] * q[lo + i]).sum(axis=1)
            best = np.lexsort((ids[at], -exact))[:k]
            yield lo + i, ids[at][best], exact[best]


def search(
    rows: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, sample: int = SAMPLE, parts: int = PARTS, target: float = TARGET,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row for which `is_query` (of the column vec_id) holds."""
    good = valid_vectors(rows, vec_id, vector)
    chosen = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()  # the bounded sample
    x = np.array(chosen.column("v").to_pylist(), dtype=np.float64) if len(chosen) else np.zeros((0, 1))
    router, visits = learn_partitions(x, parts, target=target)
    spark = rows.sparkSession
    held = Shipped(spark, router)  # its size depends on `parts` and the length of a vector

    def route(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            v = np.array(b.column(1).to_pylist(), dtype=np.float64)
            p = held.value.probabilities(v) if held.value.w[3].size > 1 else np.ones((len(v), 1))
            order = np.argsort(-p, axis=1, kind="stable")[:, :visits].astype(np.int32)
            yield pa.record_batch([*b.columns, pa.array(order.tolist(), pa.list_(pa.int32()))], names=["vec_id", "v", "parts"])

    routed = stored(good.mapInArrow(route, "vec_id long, v array<double>, parts array<int>"), "routed")
    stock = routed.select("vec_id", "v", F.col("parts")[0].alias("part"))
    sizes = stock.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))  # `parts` rows
    stock = stock.join(F.broadcast(sizes), "part").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    stock = stock.select("part", "block", "vec_id", "v").toDF("part", "block", "vec_id", "v")
    asked = (
        routed.filter(is_query(F.col("vec_id"))).select("vec_id", "v", F.explode("parts").alias("part"))
        .join(F.broadcast(sizes), "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("part", "block", "vec_id", "v").toDF("to_part", "to_block", "query_id", "q")
    )

    def compare(queries: pd.DataFrame, stored_rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(stored_rows):
            q, x = np.array(queries["q"].tolist(), dtype=np.float64), np.array(stored_rows["v"].tolist(), dtype=np.float64)
            own = queries["query_id"].to_numpy()
            for i, ids, score in best_of(q, stored_rows["vec_id"].to_numpy(), x, own, k):
                out.append(pd.DataFrame({"query_id": own[i], "vec_id": ids, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    found = asked.groupBy("to_part", "to_block").cogroup(stock.groupBy("part", "block")).applyInPandas(compare, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    from qaloom.session import table

    return search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


QUERIES = {"op2_ann": op2_ann}
