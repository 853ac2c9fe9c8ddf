"""Tables that plots are drawn from: dot-plot bins, chromosome lay-out, braids."""

from __future__ import annotations

import colorsys

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synblock.functions.columns import round_to
from synblock.operators import ranks


def dotplot_bins(hits: DataFrame, size: int = 100, quantile: float = 0.95, low: int = 5, high: int = 20, min_genes: int = 1) -> DataFrame:
    """Counts of hits per cell of two rank axes, capped at a quantile of the cells that lies between ``low`` and ``high``."""
    by = ["genome1", "genome2", "chr1", "chr2"]
    big = hits.groupBy(*by).agg(F.least(F.count_distinct("ofID1"), F.count_distinct("ofID2")).alias("_n")).where(F.col("_n") >= min_genes).drop("_n")
    h = hits.join(big, by, "left_semi")
    cells = h.groupBy(*by, round_to(F.col("ord1").cast("double"), size).cast("long").alias("bin1"), round_to(F.col("ord2").cast("double"), size).cast("long").alias("bin2")).agg(F.count(F.lit(1)).alias("n"))
    cap = cells.groupBy("genome1", "genome2").agg(F.least(F.greatest(F.percentile("n", F.lit(quantile)), F.lit(float(low))), F.lit(float(high))).alias("cap"))
    return cells.join(cap, ["genome1", "genome2"]).withColumn("shown", F.least(F.col("n").cast("double"), "cap")).drop("cap")


KINDS = {"raw": "bitScore > {least}", "og": "sameOG", "syntenic": "isSyntenic"}


def dotplots(hits: DataFrame, kind: str = "raw", inches: float = 12, dots: int = 256, quantile: float = 0.5, min_score: float = 50, min_genes: int = 5, low: int = 5, high: int = 20) -> DataFrame:
    """``genome1, genome2, chr1, chr2, place1, place2, bin1, bin2, n, shown``: the cells of a dot-plot for every pair of genomes.

    Hits are those above a score, of one orthogroup, or syntenic. Cells are as wide as a dot: the genome with fewer genes among all hits gets ``inches``, the other
    as much more as it has more. A chromosome is drawn if it has more genes that may be anchors than a tenth of the mean number of a chromosome's hits within
    orthogroups, on the genome where that is less, and ``min_genes`` at least. Facets go by their least rank. Counts are capped at a quantile of a pair's cells
    between ``low`` and ``high``.
    """
    pair = ["genome1", "genome2"]
    sizes = hits.groupBy(*pair).agg(F.count_distinct("ofID1").alias("_u1"), F.count_distinct("ofID2").alias("_u2"), F.max("ord1").alias("_x"), F.max("ord2").alias("_y"))
    inch = lambda a, b: F.lit(float(inches)) * F.greatest(F.col(a) / F.col(b), F.lit(1.0))
    step = lambda most, a, b: F.floor(F.col(most) / (inch(a, b) * dots)) + 1
    sizes = sizes.select(*pair, step("_x", "_u1", "_u2").alias("_w1"), step("_y", "_u2", "_u1").alias("_w2"))
    mean = None
    for n in (1, 2):
        each = hits.where("chr1 is not null and chr2 is not null").groupBy(*pair, f"chr{n}").agg(F.count_if("sameOG").alias("_k")).where("_k > 0")
        part = each.groupBy(*pair).agg((F.avg("_k") / 10).alias(f"_m{n}"))
        mean = part if mean is None else mean.join(part, pair)
    least = sizes.join(mean, pair, "left").select(*pair, "_w1", "_w2", F.greatest(F.coalesce(F.least("_m1", "_m2"), F.lit(0.0)), F.lit(float(min_genes))).alias("_least"))
    some = hits.where(KINDS[kind].format(least=min_score)).where("chr1 is not null and chr2 is not null and ord1 is not null and ord2 is not null")
    drawn = some.join(F.broadcast(least), pair)  # a row a pair of genomes
    for n in (1, 2):
        able = ~F.col("noAnchor") & F.col(f"isArrayRep{n}")
        facet = some.groupBy(*pair, f"chr{n}").agg(F.count_distinct(F.when(able, F.col(f"ofID{n}"))).alias(f"_g{n}"), F.min(f"ord{n}").alias(f"_f{n}"))
        facet = facet.join(F.broadcast(least.select(*pair, "_least")), pair).where(F.col(f"_g{n}") > F.col("_least")).drop("_least")
        place = F.row_number().over(Window.partitionBy(*pair).orderBy(f"_f{n}", f"chr{n}")).cast("long")
        drawn = drawn.join(facet.select(*pair, f"chr{n}", place.alias(f"place{n}")), [*pair, f"chr{n}"])
    at = lambda n: (F.bround(F.col(f"ord{n}") / F.col(f"_w{n}"), 0) * F.col(f"_w{n}")).cast("long").alias(f"bin{n}")
    cells = drawn.groupBy(*pair, "chr1", "chr2", "place1", "place2", at(1), at(2)).agg(F.count(F.lit(1)).alias("n"))
    # counts of counts: a pair's quantile is sought among few distinct numbers
    tally = cells.groupBy(*pair, "n").agg(F.count(F.lit(1)).alias("_k"))
    cap = tally.groupBy(*pair).agg(F.least(F.greatest(F.percentile("n", F.lit(quantile), F.col("_k")), F.lit(float(low))), F.lit(float(high))).alias("cap"))
    return cells.join(F.broadcast(cap), pair).withColumn("shown", F.least(F.col("n").cast("double"), "cap")).drop("cap")


def chromosome_layout(genes: DataFrame, at: str = "ord", gap: float = 0.01) -> DataFrame:
    """``genome, chr, length, offset``: chromosomes side by side in order, with gaps, centred on 0."""
    length = genes.groupBy("genome", "chr").agg((F.max(at) - F.min(at) + 1).alias("length"), F.min(at).alias("_first"))
    w = Window.partitionBy("genome")
    n, total = F.count(F.lit(1)).over(w), F.sum("length").over(w)
    before = ranks.exclusive_sum("length", ["genome"], ["_first", "chr"])
    place = F.row_number().over(w.orderBy("_first", "chr")) - 1
    each = F.col("_total") * gap
    return length.withColumns({"_total": total, "_n": n, "_before": before, "_place": place}).select(
        "genome", "chr", "length", (F.col("_before") + F.col("_place") * each - (F.col("_total") + (F.col("_n") - 1) * each) / 2).alias("offset"))


def recentred(genes: DataFrame, at: str = "ord") -> DataFrame:
    """Positions that start from 1 on every chromosome."""
    return genes.withColumn(at, F.col(at) - F.min(at).over(Window.partitionBy("genome", "chr")) + 1)


def consecutive(blocks: DataFrame, genomes: list[str]) -> DataFrame:
    """Blocks between genomes that stand next to each other in the given order."""
    pairs = blocks.sparkSession.createDataFrame(list(zip(genomes, genomes[1:], strict=False)), "genome1 string, genome2 string")
    return blocks.join(F.broadcast(pairs), ["genome1", "genome2"], "left_semi")


def braids(blocks: DataFrame, layout: DataFrame, levels: DataFrame, points: int = 20) -> DataFrame:
    """Vertices ``(blkID, i, x, y)`` of a band that leads from each block's stretch on one genome to that on the other."""
    side = lambda n: layout.join(levels, "genome").select(F.col("genome").alias(f"genome{n}"), F.col("chr").alias(f"chr{n}"), F.col("offset").alias(f"_o{n}"), F.col("level").alias(f"_y{n}"))
    b = blocks.join(side(1), ["genome1", "chr1"]).join(side(2), ["genome2", "chr2"])
    b = b.select("blkID", (F.col("startOrd1") + F.col("_o1")).alias("a1"), (F.col("endOrd1") + F.col("_o1")).alias("b1"), (F.col("startOrd2") + F.col("_o2")).alias("a2"), (F.col("endOrd2") + F.col("_o2")).alias("b2"), F.col("_y1").alias("y1"), F.col("_y2").alias("y2"))
    return bands(b, points)


def bands(ends: DataFrame, points: int = 20) -> DataFrame:
    """Vertices ``(blkID, i, x, y)`` of bands from ``a1, b1`` at height ``y1`` to ``a2, b2`` at ``y2``, along half a cosine wave, there and back."""
    v = ends.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2 * points + 1))))
    back = F.col("i") > points
    t = F.when(back, 2 * points + 1 - F.col("i")).otherwise(F.col("i")) / float(points)
    s = (1 - F.cos(t * F.pi())) / 2
    at = lambda p, q: F.col(p) + (F.col(q) - F.col(p)) * s
    return v.select("blkID", "i", F.when(back, at("b1", "b2")).otherwise(at("a1", "a2")).alias("x"), (F.col("y1") + (F.col("y2") - F.col("y1")) * t).alias("y"))


def rounded_rectangles(boxes: DataFrame, points: int = 8) -> DataFrame:
    """Vertices ``(key, i, x, y)`` of rectangles ``(key, x1, x2, y1, y2)`` whose ends are quarter circles of half the height."""
    n = 4 * points
    r = (F.col("y2") - F.col("y1")) / 2
    r = F.least(r, (F.col("x2") - F.col("x1")) / 2)
    v = boxes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    corner, step = F.floor(F.col("i") / points), F.pmod("i", F.lit(points)) / float(points - 1)
    angle = (corner + step) * F.pi() / 2
    cx = F.when(corner.isin(0, 3), F.col("x2") - r).otherwise(F.col("x1") + r)
    cy = F.when(corner.isin(0, 1), F.col("y2") - r).otherwise(F.col("y1") + r)
    return v.select("key", "i", (cx + r * F.cos(angle)).alias("x"), (cy + r * F.sin(angle)).alias("y"))


def order_by_synteny(hits: DataFrame, reference: str) -> DataFrame:
    """Chromosomes of each genome in order of the median position of their hits on the reference."""
    return hits.where(F.col("genome1") == reference).groupBy("genome2", "chr2").agg(F.median("ord1").alias("at"), F.count(F.lit(1)).alias("n"))


def colours(n: int) -> list[str]:
    """``n`` colours of one strength, from red over green and blue to violet."""
    hues = np.linspace(0.0, 0.8, n) if n > 1 else np.zeros(max(n, 0))
    return ["#{:02X}{:02X}{:02X}".format(*(round(255 * c) for c in colorsys.hsv_to_rgb(h, 0.55, 0.9))) for h in hues]


def with_alpha(colour: str, alpha: float) -> str:
    return f"{colour[:7]}{round(255 * min(max(alpha, 0.0), 1.0)):02X}"


def are_colours(values: list[str]) -> list[bool]:
    import re

    return [bool(re.fullmatch(r"#[0-9A-Fa-f]{6}([0-9A-Fa-f]{2})?", v or "")) for v in values]
