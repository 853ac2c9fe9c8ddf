"""Centroid clustering of integer vectors, exact, with bounds that geometry tightens.

Every vector keeps its cluster and a lower bound on its distance to any other centroid. When centroids have moved, a
vector of cluster i stays where it is without a scan if the exact distance to its own centroid is below that bound, or
below half the way from its centroid to the next. The bound has to be loosened by what any other centroid j may have come
closer. That is at most the way that j has gone, but the vectors of cluster i lie in a sphere about i's former centroid, of
the largest distance there as radius, and in the plane of that centre and j's way this sphere is seen from j under a cone:
a step of length p towards any vector of it gains at most ``p * cos(a - b)``, where a is the angle between the way and the centre and
b half the cone's width. Summed over ``STEPS`` pieces of the way, and negative where j goes away from the sphere
(after Rysavy and Hamerly, "Geometric methods to accelerate k-means algorithms", 2016). All other vectors are ambiguous and
scanned against all centroids.

Distances that decide are exact integers, ties go to the smaller number; bounds are floats, kept on the safe side by ``SLACK``.
Vectors are state in a table that each round writes anew; the driver holds a row a cluster.

Vectors that are null, of another length, or hold null or non-finite components take no part. Repeated vectors count each;
of equal ids the least vector is the first in the order of centroids, and a null id is hashed as an empty one. With fewer vectors than
clusters there are fewer clusters; an empty table gives an empty table. A component, a squared distance or
a cluster's sum of a component beyond 64 bits is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synblock import scratch

CLUSTERS = 40
ROUNDS = 5
LENGTH = 64
SCALE = 256
SEED = "2"
STEPS = 8
SLACK = 1e-9
#: Below this, sums of products of 64-bit floats are exact for up to 256 components.
_EXACT = 1 << 21
_STATE = "vec_id long, x array<long>, cluster int, distance long, lower double, scanned boolean"


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to those of ``c``."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < _EXACT and x.shape[1] <= 256:
        f, g = x.astype(np.float64), c.astype(np.float64)
        return ((f * f).sum(axis=1)[:, None] - 2 * (f @ g.T) + (g * g).sum(axis=1)[None, :]).astype(np.int64)
    big, far = x.astype(object), c.astype(object)
    return np.array([[((r - k) * (r - k)).sum() for k in far] for r in big], object).reshape(len(x), len(c))


def gains(before: np.ndarray, after: np.ndarray, radius: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """For clusters i and j: no vector in the sphere of i has come closer to centroid j by more than this."""
    old, new = before.astype(np.float64), after.astype(np.float64)
    way = np.linalg.norm(new - old, axis=1)
    unit = (new - old) / np.maximum(way, 1e-300)[:, None]
    to = old[:, None, :] - old[None, :, :]  # from j's start to i's centre
    along = np.einsum("ijd,jd->ij", to, unit)
    off = np.sqrt(np.maximum((to * to).sum(axis=2) - along * along, 0))
    out = np.zeros_like(along)
    for k in range(steps):
        start, end = way * k / steps, way * (k + 1) / steps
        ahead = along - start[None, :]
        past = np.clip(along, start[None, :], end[None, :])
        nearest = np.sqrt((along - past) ** 2 + off * off)  # of the piece, to i's centre
        inside = nearest <= radius[:, None] * (1 + SLACK)
        cone = np.arcsin(np.minimum(1, radius[:, None] * (1 + SLACK) / np.maximum(nearest, 1e-300)))
        angle = np.arctan2(off, ahead) - cone  # least at the piece's start
        out += np.where(inside, 1.0, np.cos(np.clip(angle, 0, np.pi))) * (end - start)[None, :]
    return np.minimum(out, way[None, :])


def loosened(before: np.ndarray, after: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster by how much the lower bound of its vectors sinks (or rises, if negative)."""
    most = gains(before, after, radius)
    if len(most) < 2:
        return np.zeros(len(most))
    np.fill_diagonal(most, -np.inf)
    return most.max(axis=1)


def half_gaps(c: np.ndarray) -> np.ndarray:
    """Half the distance of each centroid to the next."""
    between = np.sqrt(squared_distances(c, c).astype(np.float64))
    np.fill_diagonal(between, np.inf)
    return between.min(axis=1, initial=np.inf) / 2


def assign(x: np.ndarray, cluster: np.ndarray, lower: np.ndarray, c: np.ndarray, sinks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Clusters, squared distances, lower bounds, and which vectors were scanned; ``sinks`` is None at first, when all are."""
    distance, scan = np.zeros(len(x), object), np.ones(len(x), bool)
    if sinks is not None:
        lower = lower - sinks[cluster] - SLACK * (1 + np.abs(lower) + np.abs(sinks)[cluster])
        for k in np.unique(cluster):
            of = np.flatnonzero(cluster == k)
            distance[of] = squared_distances(x[of], c[k : k + 1])[:, 0]
        own = np.sqrt(distance.astype(np.float64))
        scan = own * (1 + SLACK) + SLACK >= np.maximum(lower, half_gaps(c)[cluster])
    at = np.flatnonzero(scan)
    if len(at):
        all_of = squared_distances(x[at], c)
        best = all_of.argmin(axis=1)  # the first of equal ones
        distance[at] = all_of[np.arange(len(at)), best]
        others = all_of.astype(np.float64)
        others[np.arange(len(at)), best] = np.inf
        cluster, lower = cluster.copy(), lower.copy()
        cluster[at], lower[at] = best, np.minimum(np.sqrt(others.min(axis=1)), 1e300)
    return cluster, distance, lower, scan


def _assigned(state: DataFrame, c: np.ndarray, sinks: np.ndarray | None, length: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
            cluster, lower = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 4))
            cluster, distance, lower, scanned = assign(x, cluster, lower, c, sinks)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(distance.tolist(), pa.int64()), pa.array(lower), pa.array(scanned)], [f.strip().split(" ")[0] for f in _STATE.split(",")])

    return state.mapInArrow(of, _STATE)


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", length: int = LENGTH, scale: int = SCALE) -> DataFrame:
    """``(vec_id, x)`` of the rows that take part: components ``floor(scale * component)``."""
    e = F.col(vector_col).cast("array<double>")
    good = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = rows.where(e.isNotNull() & (F.size(e) == length)).where(good)
    far = F.raise_error(F.lit("a component is beyond 64 bits")).cast("bigint")
    whole = lambda v: F.when(F.abs(v * F.lit(float(scale))) < F.lit(2.0**63), F.floor(v * F.lit(float(scale)))).otherwise(far)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(e, whole).alias("x"))


def _sums(state: DataFrame, length: int) -> dict[int, tuple[list[int], float]]:
    """For each cluster that isn't empty its new centroid and its sphere's radius: a row a cluster."""
    total = [F.try_sum(F.col("x")[i]).alias(f"s{i}") for i in range(length)]
    found = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"), *total).collect()
    if any(v is None for r in found for v in r):
        raise OverflowError("the sum of a component over a cluster is beyond 64 bits")
    return {r["cluster"]: ([r[f"s{i}"] // r["n"] for i in range(length)], float(r["far"]) ** 0.5) for r in found}


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, length: int = LENGTH, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, x, cluster, distance, lower, scanned)`` of every vector after ``rounds`` rounds and a last assignment, and the centroids.

    Centroids start as the ``k`` vectors with the smallest sha256 of ``<seed>:<id>``. ``scanned`` says whether the last assignment scanned the vector.
    """
    spark = rows.sparkSession
    x, path = scratch.written(vectors(rows, id_col, vector_col, length, scale), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = x.orderBy(order, "x").limit(k).collect()
    c = np.array([r["x"] for r in first], np.int64).reshape(-1, length)
    state = x.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0.0).alias("lower"), F.lit(True).alias("scanned"))
    sinks = None
    for r in range(rounds + 1):
        state, new = scratch.written(_assigned(state, c, sinks, length), "assigned")
        scratch.delete(spark, path)
        path = new
        if r == rounds or not len(c):
            break
        before, radius = c, np.zeros(len(c))
        c = c.copy()
        for at, (centre, far) in _sums(state, length).items():
            c[at], radius[at] = centre, far
        sinks = loosened(before, c, radius)
    return state, c


def clustered(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> DataFrame:
    """``(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every vector; parameters are those of ``cluster``."""
    state, c = cluster(rows, id_col, vector_col, **how)
    sums = state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # a row a cluster
    total = sum(r["s"] for r in sums)
    about = [(r["cluster"], r["s"], total, hashlib.sha256(",".join(map(str, c[r["cluster"]].tolist())).encode()).hexdigest()) for r in sums]
    fields = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    named = rows.sparkSession.createDataFrame(about, fields)
    return state.join(F.broadcast(named), "cluster").select(F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS, length: int = LENGTH, scale: int = SCALE, seed: str = SEED) -> str:
    """The same in DuckDB's SQL, every distance of every round."""
    whole = f"list_transform(embedding, lambda v: cast(floor(cast(v as double) * {scale}) as bigint))"
    good = f"len(embedding) = {length} and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0"
    parts = [
        f"kept as (select row_number() over () r, vec_id, {whole} x from embeddings where {good})",
        f"l as (select r, unnest(generate_series(1, {length})) d, unnest(x) v from kept)",
        f"f as (select r, row_number() over (order by sha256('{seed}:' || coalesce(cast(vec_id as varchar), '')), x) - 1 k from kept)",
        f"c0 as (select k, d, v from f join l using (r) where k < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"s{i} as (select r, k, cast(sum((l.v - c.v) * (l.v - c.v)) as bigint) s from l join c{i} c using (d) group by r, k)")
        parts.append(f"a{i} as (select r, k, s from s{i} qualify row_number() over (partition by r order by s, k) = 1)")
        if i < rounds:
            parts.append(f"m{i} as (select k, d, cast(floor(cast(sum(v) as double) / count(*)) as bigint) v from a{i} join l using (r) group by k, d)")
            parts.append(f"c{i + 1} as (select k, d, coalesce(m.v, c.v) v from c{i} c left join m{i} m using (k, d))")
    parts.append(f"h as (select k, sha256(string_agg(cast(v as varchar), ',' order by d)) h from c{rounds} group by k)")
    total = "cast(sum(s) over (partition by k) as bigint) cluster_inertia, cast(sum(s) over () as bigint) inertia"
    return f"with {', '.join(parts)} select vec_id, cast(k as integer) \"cluster\", s distance, {total}, h centroid_sha256 from a{rounds} join kept using (r) join h using (k)"
