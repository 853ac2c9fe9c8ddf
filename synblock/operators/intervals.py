"""Algebra of closed, 1-based intervals ``(chr, start, end)``."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], a_start: str, a_end: str, b_start: str, b_end: str, width: int = 10_000, how: str = "inner") -> DataFrame:
    """All pairs with equal keys whose intervals share a position.

    Both sides are dealt into bins of ``width``, so that the equi-join below has the bin in its key and a hot
    chromosome is spread over its bins; a pair is kept in the bin where its overlap starts, so none
    comes twice. Column names must differ but for the keys. ``left`` keeps rows of ``a`` without a partner.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    left = a.where(F.col(a_end) >= F.col(a_start)).withColumn("_bin", bins(a_start, a_end))
    right = b.where(F.col(b_end) >= F.col(b_start)).withColumn("_bin", bins(b_start, b_end))
    met = left.join(right, [*on, "_bin"]).where((F.col(a_start) <= F.col(b_end)) & (F.col(b_start) <= F.col(a_end)) & (F.col("_bin") == F.floor(F.greatest(a_start, b_start) / width))).drop("_bin")
    if how == "inner":
        return met
    alone = a.join(met.select(*a.columns).distinct(), a.columns, "left_anti")
    return met.unionByName(alone, allowMissingColumns=True)


BIN = 1_000_000


def _reduced(df: DataFrame, by: list[str], gap: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("_s", "_e")
    reach = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("_s") - reach - 1 >= gap).cast("int"), F.lit(0))
    marked = df.withColumn("_new", new).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_i").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.sum("_n").alias("_n")).drop("_i")


def reduce(df: DataFrame, by: list[str], gap: int = 1, start: str = "start", end: str = "end", width: int = BIN) -> DataFrame:
    """Merges intervals that overlap or are less than ``gap`` positions apart (1: adjacent ones too); counts members.

    What begins within ``width`` positions is merged first, so that one chromosome is many tasks; then what is left of each chromosome.
    """
    rows = df.select(*by, F.col(start).alias("_s"), F.col(end).alias("_e"), F.lit(1).cast("long").alias("_n"), F.floor(F.col(start) / width).alias("_bin"))
    parts = _reduced(_reduced(rows, [*by, "_bin"], gap).drop("_bin"), by, gap)
    return parts.withColumnsRenamed({"_s": start, "_e": end, "_n": "n"})


def merged(df: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    return reduce(df, by, 1, start, end).drop("n")


def gaps(df: DataFrame, lengths: DataFrame, by: list[str], length: str = "length", start: str = "start", end: str = "end") -> DataFrame:
    """What the intervals leave of each sequence in ``lengths``."""
    parts = merged(df, by, start, end).select(*by, F.col(start).alias("_s"), F.col(end).alias("_e"))
    ends = lengths.select(*by, F.lit(0).cast("long").alias("_s"), F.lit(0).cast("long").alias("_e")).unionByName(lengths.select(*by, (F.col(length) + 1).cast("long").alias("_s"), (F.col(length) + 1).cast("long").alias("_e")))
    known = parts.join(lengths.select(*by), by, "left_semi").unionByName(ends)
    w = Window.partitionBy(*by).orderBy("_s", "_e")
    after = F.lead("_s").over(w)
    return known.select(*by, (F.col("_e") + 1).alias(start), (after - 1).alias(end)).where(F.col(end) >= F.col(start))


def intersect(a: DataFrame, b: DataFrame, by: list[str], width: int = 10_000) -> DataFrame:
    """The positions in both sets, as merged intervals."""
    left = merged(a, by)
    right = merged(b, by).withColumnsRenamed({"start": "_s2", "end": "_e2"})
    met = overlap_join(left, right, by, "start", "end", "_s2", "_e2", width)
    return merged(met.select(*by, F.greatest("start", "_s2").alias("start"), F.least("end", "_e2").alias("end")), by)


def subtract(a: DataFrame, b: DataFrame, lengths: DataFrame, by: list[str], width: int = 10_000) -> DataFrame:
    """The positions of ``a`` that aren't in ``b``."""
    return intersect(a, gaps(b, lengths, by), by, width)


def whole(lengths: DataFrame, by: list[str], length: str = "length") -> DataFrame:
    return lengths.select(*by, F.lit(1).cast("long").alias("start"), F.col(length).cast("long").alias("end"))


def classify(classes: list[tuple[str, DataFrame]], lengths: DataFrame, by: list[str], rest: str = "unknown") -> DataFrame:
    """Each position's class: the first in the list that covers it, else ``rest``.

    One sweep for all classes: between two neighbouring ends the set of open classes is constant, and
    the running sums of opened and closed intervals tell the first open one.
    """
    n = len(classes)
    marks = lengths.select(*by, F.lit(1).cast("long").alias("at"), *(F.lit(0).alias(f"c{i}") for i in range(n))).unionByName(lengths.select(*by, (F.col("length") + 1).cast("long").alias("at"), *(F.lit(0).alias(f"c{i}") for i in range(n))))
    for i, (_, df) in enumerate(classes):
        clipped = merged(df, by).join(lengths, by).select(*by, F.greatest("start", F.lit(1)).alias("s"), F.least("end", "length").alias("e")).where("e >= s")
        for at, step in ((F.col("s"), 1), (F.col("e") + 1, -1)):
            marks = marks.unionByName(clipped.select(*by, at.cast("long").alias("at"), *(F.lit(step if k == i else 0).alias(f"c{k}") for k in range(n))))
    points = marks.groupBy(*by, "at").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(n)))
    w = Window.partitionBy(*by).orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    name = fold(lambda rest_, i: F.when(F.sum(f"c{i}").over(upto) > 0, classes[i][0]).otherwise(rest_), reversed(range(n)), F.lit(rest))
    parts = points.select(*by, F.col("at").alias("start"), (F.lead("at").over(w) - 1).alias("end"), name.alias("class")).where("end >= start")
    return merged(parts, [*by, "class"])


def windows(lengths: DataFrame, by: list[str], size: int, step: int, full: bool = False) -> DataFrame:
    """Windows from position 1 on; the last is cut at the sequence's end, or left out if ``full``."""
    at = lengths.where("length >= 1").select(*by, "length", F.explode(F.sequence(F.lit(1).cast("long"), F.col("length").cast("long"), F.lit(step).cast("long"))).alias("start"))
    at = at.withColumn("end", F.least(F.col("start") + size - 1, F.col("length"))).drop("length") if not full else at.withColumn("end", F.col("start") + size - 1).where("end <= length").drop("length")
    return at


def coverage(at: DataFrame, features: DataFrame, by: list[str], out: str = "bp", width: int = 10_000) -> DataFrame:
    """Positions of each window that the merged features cover; 0 where there are none."""
    parts = merged(features, by).withColumnsRenamed({"start": "_s2", "end": "_e2"})
    met = overlap_join(at.select(*by, "start", "end"), parts, by, "start", "end", "_s2", "_e2", width)
    sums = met.groupBy(*by, "start", "end").agg(F.sum(F.least("end", "_e2") - F.greatest("start", "_s2") + 1).alias(out))
    return at.join(sums, [*by, "start", "end"], "left").withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))


def slide(classes: list[tuple[str, DataFrame]], lengths: DataFrame, by: list[str], size: int, step: int) -> DataFrame:
    """Per window and class: covered positions, their share, and the shares stacked in the order of classes, at most 1."""
    at = windows(lengths, by, size, step)
    parts = [coverage(at, df, by, "n_bp").withColumns({"id": F.lit(name), "_o": F.lit(i)}) for i, (name, df) in enumerate(classes)]
    out = fold(DataFrame.unionByName, parts).withColumn("n_bp_window", F.col("end") - F.col("start") + 1)
    out = out.withColumn("prop", F.col("n_bp") / F.col("n_bp_window"))
    w = Window.partitionBy(*by, "start").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("cum_prop", F.least(F.sum("prop").over(w), F.lit(1.0))).drop("_o")


def inside(at: Column | str, start: str, end: str) -> Column:
    c = F.col(at) if isinstance(at, str) else at
    return (c >= F.col(start)) & (c <= F.col(end))
