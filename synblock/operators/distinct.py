"""Places of distinct values, and numbers that tell equal rows apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synblock import scratch


def places(df: DataFrame, column: str) -> DataFrame:
    """``(value, place)``: the distinct values of a column with their exact ranks from 0, null last.

    Values are sorted by ranges and numbered within each, so no task holds them all; the offsets of the ranges are a row each.
    """
    values = df.select(F.col(column).alias("value")).distinct()
    ranged = values.where("value is not null").repartitionByRange("value").withColumn("_part", F.spark_partition_id())
    ranged = scratch.materialize(ranged, "values")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offset = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))  # a row a range
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("value"))
    known = ranged.withColumn("_r", rank).join(F.broadcast(offset), "_part").select("value", (F.col("_offset") + F.col("_r") - 1).cast("long").alias("place"))
    none = values.where("value is null").select("value", F.lit(ranged.count()).cast("long").alias("place"))
    return known.unionByName(none)


def copies(rows: DataFrame, key: str, row: str) -> DataFrame:
    """``(row, copy)`` of the rows whose ``key`` occurs more than once: numbers from 0 among equal keys.

    ``rows`` has been written; ``row`` is its ``monotonically_increasing_id``. Rows are numbered within key and partition, and the
    partitions' offsets added, so that a key of any number of rows isn't gathered in one task. ``key`` isn't null.
    """
    again = scratch.materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key), "again")
    some = rows.select(key, row, F.shiftright(row, 33).alias("_part")).join(again, key, "left_semi")
    some = scratch.materialize(some, "copies")
    sizes = some.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n")
    start = scratch.materialize(sizes.select(key, "_part", before.alias("_start")), "starts")
    within = F.row_number().over(Window.partitionBy(key, "_part").orderBy(row)) - 1
    return some.withColumn("_w", within).join(start, [key, "_part"]).select(row, (F.col("_start") + F.col("_w")).cast("long").alias("copy"))
