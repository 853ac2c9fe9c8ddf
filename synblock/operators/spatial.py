"""Points in rank space: neighbours, nearest anchors, boxes, interpolation, density clusters.

Neighbours are found by an equi-join on grid cells of the radius, never by comparing all points of a chromosome pair.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synblock import scratch
from synblock.operators.graph import connected_components


def near_pairs(a: DataFrame, b: DataFrame, by: list[str], x: str, y: str, radius: float, a_cols: list[str], b_cols: list[str]) -> DataFrame:
    """Pairs of points at most ``radius`` apart with equal keys: columns ``a_*``, ``b_*`` and the squared distance ``d2``."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    left = a.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"), cell(x).alias("_cx"), cell(y).alias("_cy"), *(F.col(c).alias(f"a_{c}") for c in a_cols))
    steps = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    right = b.select(*by, F.col(x).alias("_x2"), F.col(y).alias("_y2"), cell(x).alias("_c"), cell(y).alias("_d"), *(F.col(c).alias(f"b_{c}") for c in b_cols))
    right = right.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).withColumns({"_cx": F.col("_c") + F.col("_i"), "_cy": F.col("_d") + F.col("_j")}).drop("_c", "_d", "_i", "_j")
    d2 = (F.col("_x") - F.col("_x2")) ** 2 + (F.col("_y") - F.col("_y2")) ** 2
    return left.join(right, [*by, "_cx", "_cy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).drop("_x", "_y", "_x2", "_y2", "_cx", "_cy")


def flag_in_radius(points: DataFrame, by: list[str], x: str, y: str, anchor: str, radius: float, key: list[str], out: str = "in_radius") -> DataFrame:
    """Whether an anchor is within ``radius`` (inclusive) of each point; anchors are in their own."""
    met = near_pairs(points, points.where(anchor), by, x, y, radius, key, []).select(*(F.col(f"a_{k}").alias(k) for k in key)).distinct().withColumn(out, F.lit(True))
    return points.join(met, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def nearest_in_radius(points: DataFrame, by: list[str], x: str, y: str, anchor: str, radius: float, key: list[str], carry: list[str]) -> DataFrame:
    """Each point with the columns ``carry`` of its nearest anchor, as ``near_*``; ties go to the least anchor key, none gives null."""
    pairs = near_pairs(points, points.where(anchor), by, x, y, radius, key, sorted({*key, *carry}))
    best = pairs.groupBy(*(f"a_{k}" for k in key)).agg(F.min_by(F.struct(*(F.col(f"b_{c}").alias(c) for c in carry)), F.struct("d2", *(F.col(f"b_{k}") for k in key))).alias("n"))
    return points.join(best.select(*(F.col(f"a_{k}").alias(k) for k in key), *(F.col(f"n.{c}").alias(f"near_{c}") for c in carry)), key, "left")


def points_in_boxes(points: DataFrame, boxes: DataFrame, by: list[str], x: str, y: str, key: list[str], box: str, width: float = 100.0) -> DataFrame:
    """Each point with the least ``box`` whose bounds ``(x1, x2, y1, y2)`` hold it, or null.

    Boxes are dealt over bins of the first axis, so the join has the bin in its key.
    """
    b = boxes.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("x1") / width), F.floor(F.col("x2") / width))))
    met = points.withColumn("_bin", F.floor(F.col(x) / width)).join(b.select(*by, "_bin", "x1", "x2", "y1", "y2", F.col(box).alias("_box")), [*by, "_bin"])
    met = met.where(F.col(x).between(F.col("x1"), F.col("x2")) & F.col(y).between(F.col("y1"), F.col("y2")))
    return points.join(met.groupBy(*key).agg(F.min("_box").alias(box)), key, "left")


def interpolate(df: DataFrame, by: list[str], x: str, y: str, out: str) -> DataFrame:
    """Linear interpolation of ``y`` over ``x`` within each group, at rows where it is null; null outside the known range.

    Known values at equal ``x`` are averaged first.
    """
    knots = F.avg(y).over(Window.partitionBy(*by, x))
    w = Window.partitionBy(*by).orderBy(x)
    point = F.when(F.col("_y").isNotNull(), F.struct(F.col(x).cast("double").alias("x"), F.col("_y").cast("double").alias("y")))
    df = df.withColumn("_y", knots).withColumns({"_a": F.last(point, True).over(w.rangeBetween(Window.unboundedPreceding, 0)), "_b": F.first(point, True).over(w.rangeBetween(0, Window.unboundedFollowing))})
    slope = F.when(F.col("_b.x") > F.col("_a.x"), (F.col("_b.y") - F.col("_a.y")) / (F.col("_b.x") - F.col("_a.x"))).otherwise(0.0)
    value = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.col("_a.y") + slope * (F.col(x) - F.col("_a.x")))
    return df.withColumn(out, F.coalesce(F.col("_y").cast("double"), value)).drop("_y", "_a", "_b")


def dbscan(points: DataFrame, by: list[str], x: str, y: str, eps: float, min_points: int, key: str, out: str = "cluster") -> DataFrame:
    """Density clusters within each group, named by their least core key; noise is null.

    A point counts among its own neighbours and ``eps`` is inclusive. A border point joins the cluster with
    the least name in range. ``key`` is a long that is unique over all points.
    """
    pairs = scratch.materialize(near_pairs(points, points, by, x, y, eps, [key], [key]).select(F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b")), "near")
    core = scratch.materialize(pairs.groupBy("a").count().where(F.col("count") >= min_points).select(F.col("a").alias("core")), "core")
    edges = pairs.join(core, pairs.a == core.core, "left_semi").join(core, pairs.b == core.core, "left_semi").where("a > b")
    comp = connected_components(edges, "a", "b")
    named = scratch.materialize(core.join(comp, core.core == comp.node, "left").select("core", F.coalesce("component", "core").alias("_c")), "clusters")
    best = pairs.join(named, pairs.b == named.core).groupBy("a").agg(F.min("_c").alias(out))
    return points.join(best.withColumnRenamed("a", key), key, "left")


# Kernels for groups that a grouped function holds in memory


def neighbour_lists(x: np.ndarray, y: np.ndarray, eps: float, ax: np.ndarray | None = None, ay: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (point, anchor) at most ``eps`` apart, by grid cells."""
    ax, ay = (x, y) if ax is None else (ax, ay)
    if not len(x) or not len(ax):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cell = max(float(eps), 1e-9)
    cx, cy = np.floor(x / cell).astype(np.int64), np.floor(y / cell).astype(np.int64)
    bx, by = np.floor(ax / cell).astype(np.int64), np.floor(ay / cell).astype(np.int64)
    low_y = min(cy.min(), by.min()) - 1
    span = max(cy.max(), by.max()) - low_y + 2
    code = bx * span + (by - low_y)
    order = np.argsort(code, kind="stable")
    code = code[order]
    left, right = [], []
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            want = (cx + i) * span + (cy + j - low_y)
            lo, hi = np.searchsorted(code, want, "left"), np.searchsorted(code, want, "right")
            n = hi - lo
            p = np.repeat(np.arange(len(x)), n)
            q = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            ok = (x[p] - ax[q]) ** 2 + (y[p] - ay[q]) ** 2 <= eps * eps
            left.append(p[ok])
            right.append(q[ok])
    return np.concatenate(left), np.concatenate(right)


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each index is connected to."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, root[b], root[a])
        while (low[low] != low).any():
            low = low[low]
        low = low[root]
        if (low == root).all():
            return root
        root = low


def dbscan_kernel(x: np.ndarray, y: np.ndarray, eps: float, min_points: int) -> np.ndarray:
    """Cluster numbers from 1 in order of their least core point, 0 for noise; as ``dbscan``.

    Not all pairs are listed: most core points are known by what is close by, and close core points are joined first; only where
    parts of several clusters are left within reach of each other are all pairs looked at.
    """
    n = len(x)
    core, left, close = np.zeros(n, bool), np.arange(n), min(float(eps), max(eps / 8, 3.0))
    for r in dict.fromkeys((close, float(eps))):
        core[left] = np.bincount(neighbour_lists(x[left], y[left], r, x, y)[0], minlength=len(left)) >= min_points
        left = left[~core[left]]
    at = np.flatnonzero(core)
    cx, cy = x[at], y[at]
    p, q = neighbour_lists(cx, cy, close)
    root = union_find(len(at), p[p > q], q[p > q])
    if close < eps:
        far = np.flatnonzero(_mixed(cx, cy, eps, root))
        p, q = neighbour_lists(cx[far], cy[far], eps, cx, cy)
        p = far[p]
        apart = root[p] != root[q]
        root = union_find(len(at), root[p[apart]], root[q[apart]])[root]
    label = np.full(n, n, np.int64)
    label[at] = at[root]
    p, q = neighbour_lists(x[left], y[left], eps, cx, cy)
    np.minimum.at(label, left[p], label[at[q]])
    names = np.unique(label[label < n])
    return np.where(label < n, np.searchsorted(names, label) + 1, 0)


def _mixed(x: np.ndarray, y: np.ndarray, eps: float, part: np.ndarray) -> np.ndarray:
    """Whether points of another part are in a point's grid cell or one beside it."""
    if not len(x):
        return np.zeros(0, bool)
    cx, cy = np.floor(x / eps).astype(np.int64), np.floor(y / eps).astype(np.int64)
    span = int(cy.max() - cy.min()) + 4
    code = cx * span + (cy - cy.min() + 1)
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])
    cells, low, high = code[order][first], np.minimum.reduceat(part[order], first), np.maximum.reduceat(part[order], first)
    least, most = low.copy(), high.copy()
    for step in (i * span + j for i in (-1, 0, 1) for j in (-1, 0, 1)):
        near = np.searchsorted(cells, cells + step).clip(max=len(cells) - 1)
        met = cells[near] == cells + step
        least[met], most[met] = np.minimum(least[met], low[near[met]]), np.maximum(most[met], high[near[met]])
    return (least < most)[np.searchsorted(cells, code)]
