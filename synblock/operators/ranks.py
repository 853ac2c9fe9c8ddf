"""Ranks, runs and gap sessions over ordered groups.

Every ordering ends in a unique key, so results don't depend on partitioning. Nothing here ranks
over a whole table: callers name the groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synblock import scratch


def dense_rank(df: DataFrame, by: list[str], value: Column | str, out: str) -> DataFrame:
    return df.withColumn(out, F.dense_rank().over(Window.partitionBy(*by).orderBy(value)).cast("long"))


def dense_rank_by_ranges(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """``dense_rank`` for groups larger than a task should hold: distinct values are sorted by ranges and numbered within each. Keys and values aren't null."""
    ranged = df.select(*by, value).distinct().repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id())
    ranged = scratch.materialize(ranged, "values")
    sizes = ranged.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")  # a row a range
    rank = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(value))
    known = ranged.withColumn("_r", rank).join(F.broadcast(sizes.select(*by, "_part", before.alias("_before"))), [*by, "_part"])
    return df.join(known.select(*by, value, (F.col("_before") + F.col("_r")).cast("long").alias(out)), [*by, value])


def rank_average(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Ranks in which equal values share the mean of their places."""
    first = F.rank().over(Window.partitionBy(*by).orderBy(value))
    peers = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return df.withColumn(out, first + (peers - 1) / 2.0)


def keep_first(df: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key: the first in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def keep_top(df: DataFrame, by: list[str], order: list[Column | str], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def gap_sessions(df: DataFrame, by: list[str], at: str, gap: float, out: str, tie: list[str] | None = None) -> DataFrame:
    """Numbers, from 1, the runs of each group in which neighbours are at most ``gap`` apart."""
    w = Window.partitionBy(*by).orderBy(at, *(tie or []))
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn(out, (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("long")).drop("_new")


def run_lengths(df: DataFrame, by: list[str], order: list[str], value: str, out: str, length: str | None = None) -> DataFrame:
    """Numbers the runs of equal neighbours, and gives their lengths; nulls equal each other."""
    w = Window.partitionBy(*by).orderBy(*order)
    same = F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1)
    df = df.withColumn("_new", (~same).cast("int")).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")
    return df.withColumn(length, F.count(F.lit(1)).over(Window.partitionBy(*by, out))) if length else df


def code_by_appearance(df: DataFrame, by: list[str], label: str, order: str, out: str) -> DataFrame:
    """Numbers labels by where they first appear; labels that start together go by their name."""
    first = F.min(order).over(Window.partitionBy(*by, label))
    return df.withColumn("_f", first).withColumn(out, F.dense_rank().over(Window.partitionBy(*by).orderBy("_f", label)).cast("long")).drop("_f")


def exclusive_sum(value: str, by: list[str], order: list[str]) -> Column:
    """Sum of what precedes in the group, 0 at its start."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def n50(df: DataFrame, by: list[str], length: str, out: str = "n50") -> DataFrame:
    """The length at which the longest members reach half of a group's total."""
    w = Window.partitionBy(*by).orderBy(F.desc(length)).rangeBetween(Window.unboundedPreceding, 0)
    total = F.sum(length).over(Window.partitionBy(*by))
    return df.withColumn("_c", F.sum(length).over(w)).withColumn("_t", total).where("_c * 2 >= _t").groupBy(*by).agg(F.max(length).alias(out))
