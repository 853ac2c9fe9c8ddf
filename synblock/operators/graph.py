"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synblock import scratch


def _are_stars(e: DataFrame) -> bool:
    """Whether every node points to one root, and no root to another."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return not ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out > 1 or (out > 0 and into > 0)").limit(1).count()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """One row ``(node, component)`` per node that has an edge; ``component`` is the smallest node reachable.

    Large-star and small-star steps alternate until the edges form stars around the smallest
    node of each component. All steps are partial aggregations and equi-joins whose sides are
    plain exchanges, so a hub with many neighbours is pre-aggregated or split by AQE; no
    component is ever gathered in one task. Each round is written to the shared folder.
    Edges with a null end and loops are ignored; an empty table gives an empty table.
    """
    spark = edges.sparkSession
    a, b = F.col(src), F.col(dst)
    e = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, path = scratch.written(e, "edges")
    for _ in range(max_rounds):
        if _are_stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the least neighbours are written, so that either side of the joins has its exchange
        low, low_path = scratch.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_path = scratch.written(large, "large")
        low2, low2_path = scratch.written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low2, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        small, small_path = scratch.written(small, "edges")
        for p in (path, low_path, large_path, low2_path):
            scratch.delete(spark, p)
        e, path = small, small_path
    else:
        raise RuntimeError("connected components did not converge")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
