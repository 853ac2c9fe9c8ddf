"""Exact top-k inner products: a K-d tree per shard, best-first search.

The rows that a task reads are its shards, of ``SHARD`` rows at most; it builds a
tree of each by median splits along the widest dimension, every node with its tight bounding box. A query
goes through a tree best-first: the largest inner product that a box allows is
``sum(max(q*low, q*high))``, and a node whose bound is below the query's k-th score so far is left
out with all below it. That k-th score is propagated: it starts from an exact search in a bounded
set of rows, is handed to all tasks with the queries, rises within each tree and goes on to the task's next. Bounds are strict,
so ties are never lost; they go to the smaller id. A task returns the best ``k`` of its rows for each query.

Queries are taken in blocks of at most ``BLOCK`` rows, a job each, which searches all rows; that is
what is broadcast and what the driver holds at a time. Rows aren't shuffled.

Components may be as large as doubles are: products are exact, in 64-bit numbers where they fit and in Python's integers
where they might not. A score among the best that is no 64-bit integer is an error.

Vectors that are null or hold null or non-finite components take no part. Queries meet vectors of
their own length only. Rows with the query's own id are no candidates; of rows that share a
query's id one is the query (the least vector). Repeated candidates are candidates each. An
empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synblock import scratch

K = 20
SHARD = 16_384
LEAF = 256
BLOCK = 32_768
SEEDS = 2_048
_LOW = np.iinfo(np.int64).min


class Tree:
    """A K-d tree over integer vectors of one length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        self.ids, self.x, self.nodes, low, high = ids, x, [], [], []

        def grow(rows: np.ndarray) -> int:
            part = x[rows]
            at, a, b = len(self.nodes), part.min(axis=0), part.max(axis=0)
            self.nodes.append(None)
            low.append(a)
            high.append(b)
            if len(rows) <= leaf or (a == b).all():
                order = rows[np.argsort(ids[rows], kind="stable")]
                self.nodes[at] = (ids[order], x[order])
                return at
            d = int(np.argmax(b - a))
            order = np.argsort(part[:, d], kind="stable")
            half = len(rows) // 2
            self.nodes[at] = (grow(rows[order[:half]]), grow(rows[order[half:]]))
            return at

        grow(np.arange(len(ids)))
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest inner product with any point of each node's box, a row per query."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def search(self, own: int, q: np.ndarray, bound: np.ndarray, kth: float, k: int) -> list[tuple[int, int]]:
        """The best ``k`` of ``(score, -id)`` above or at ``kth``, rows with id ``own`` left out."""
        best: list[tuple[int, int]] = []
        queue = [(-int(bound[0]), 0)]
        while queue:
            b, at = heapq.heappop(queue)
            if -b < kth:
                break
            node = self.nodes[at]
            if isinstance(node[0], int):
                for child in node:
                    if (c := int(bound[child])) >= kth:
                        heapq.heappush(queue, (-c, child))
                continue
            ids, x = node
            score = x @ q
            hit = np.flatnonzero((score >= kth).astype(bool))
            if len(hit) > 4 * k:  # rows are in order of id, so a stable sort keeps the smaller ids
                hit = hit[np.argsort(-score[hit], kind="stable")[: k + int((ids[hit] == own).sum())]]
            best += [(int(s), -int(i)) for s, i in zip(score[hit], ids[hit], strict=True) if i != own]
            if len(best) >= k:
                best = heapq.nlargest(k, best)
                kth = max(kth, best[-1][0])
        return heapq.nlargest(k, best)


def integers(df: DataFrame, id_col: str, vec_col: str, scale: float = 64.0) -> DataFrame:
    """``(id, v)`` of the rows that take part, ``v`` being floor(scale * x) as doubles."""
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    sound = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    whole = lambda e: F.when(F.abs(e * scale) < 2.0**53, F.floor(e * scale).cast("double")).otherwise(e * scale)
    return df.where(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(x, whole).alias("v"))


def _by_length(ids: list[int], vectors: list[list[float]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    groups: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids, vectors, strict=True):
        g = groups.setdefault(len(v), ([], []))
        g[0].append(i)
        g[1].append(v)
    return {n: (np.array(i, np.int64), np.array(v, float).reshape(len(i), n)) for n, (i, v) in groups.items()}


def _cast(x: np.ndarray, kind: type) -> np.ndarray:
    """Whole doubles as ``kind``; of those beyond 64 bits Python's integers."""
    return x.astype(kind) if kind is not object else np.array([int(e) for e in x.ravel()], object).reshape(x.shape)


def _narrow(x: np.ndarray, q: np.ndarray) -> type:
    """A type in which their inner products are exact: float64 (BLAS) where they stay below 2**53, then int64, then Python's integers."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    return np.float64 if most < 2.0**53 else np.int64 if most < 2.0**62 else object


def first_bounds(seeds: dict, n: int, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """The k-th score of each query among the seeds, below which nothing needs to be looked at."""
    kth = np.full(len(ids), _LOW)
    if n not in seeds or len(seeds[n][0]) <= k or (kind := _narrow(seeds[n][1], q)) is object:
        return kth
    for at in range(0, len(ids), 1024):
        score = _cast(q[at : at + 1024], kind) @ _cast(seeds[n][1], kind).T
        score[ids[at : at + 1024, None] == seeds[n][0][None, :]] = _LOW if kind is np.int64 else -np.inf
        best = np.partition(score, -k, axis=1)[:, -k]
        kth[at : at + 1024] = np.where(np.isfinite(best), best, _LOW).astype(np.int64) if kind is np.float64 else best
    return kth


def top_k(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = K, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows for each row whose id is divisible by ``every``."""
    rows = scratch.materialize(integers(df, id_col, vec_col), "vectors")
    spark = df.sparkSession
    queries = rows.where(F.col("id") % every == 0)
    queries = scratch.materialize(queries.groupBy("id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-queries.count() // block))
    queries = queries.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    seeds = rows.orderBy(F.xxhash64("id")).limit(SEEDS).collect()  # bounded; only speeds the search up
    seeds = _by_length([r["id"] for r in seeds], [r["v"] for r in seeds])
    path = scratch.new_path(spark, "best")
    for b in range(blocks):
        some = queries.where(F.col("b") == b).collect()  # one block
        asked = _by_length([r["id"] for r in some], [r["v"] for r in some])
        sent = spark.sparkContext.broadcast({n: (ids, q, first_bounds(seeds, n, ids, q, k)) for n, (ids, q) in asked.items()})

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[list]] = {}
            kth: dict[int, list[float]] = {}

            def through(ids: list[int], vectors: list[list[float]]) -> None:
                for n, (own, x) in _by_length(ids, vectors).items():
                    if n not in sent.value:
                        continue
                    qid, q, least = sent.value[n]
                    mine, bounds = best.setdefault(n, [[] for _ in qid]), kth.setdefault(n, [float("-inf") if x == _LOW else x for x in least.tolist()])
                    kind = _narrow(x, q)
                    tree, q = Tree(own, _cast(x, kind)), _cast(q, kind)
                    for at in range(0, len(qid), 1024):
                        bound = tree.bounds(q[at : at + 1024])
                        for i in range(at, min(at + 1024, len(qid))):
                            if found := tree.search(int(qid[i]), q[i], bound[i - at], bounds[i], k):
                                mine[i] = heapq.nlargest(k, mine[i] + found)
                                if len(mine[i]) == k:
                                    bounds[i] = max(bounds[i], mine[i][-1][0])

            ids, vectors = [], []
            for b in batches:
                ids += b.column(0).to_pylist()
                vectors += b.column(1).to_pylist()
                while len(ids) >= shard:
                    through(ids[:shard], vectors[:shard])
                    del ids[:shard], vectors[:shard]
            through(ids, vectors)
            for n, mine in best.items():
                for at in range(0, len(mine), 1024):
                    out = [(int(i), s, -j) for i, some in zip(sent.value[n][0][at : at + 1024], mine[at : at + 1024], strict=True) for s, j in some]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query_id", "score", "vec_id"])

        rows.mapInArrow(search, "query_id long, score long, vec_id long").write.mode("append").parquet(path)
        sent.destroy()
    found = spark.read.schema("query_id long, score long, vec_id long").parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
