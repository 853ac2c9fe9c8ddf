"""Blocks of collinear hits: coordinates, orientation, phasing, positions interpolated between anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synblock import scratch
from synblock.operators import hits as H
from synblock.operators import ranks, spatial


def coordinates(hits: DataFrame, mirror: bool = False) -> DataFrame:
    """A row per block: bounds on both genomes, first and last genes, orientation.

    The orientation is the sign of the covariance (and so of the correlation) of the two ranks, ``+`` where it is undefined; on blocks
    with ``-`` start and end of the second genome change places.
    """
    h = hits.where("blkID is not null").dropna(subset=["ofID1", "ofID2"])
    if mirror:
        h = ranks.keep_first(h.unionByName(H.swapped(h)), ["ofID1", "ofID2", "blkID"], ["genome1"])
    by = ["blkID", "genome1", "genome2", "chr1", "chr2"]
    # a gene counts where it first comes in its block: two distinct counts would deal out each hit three times
    for n in (1, 2):
        before = F.lag(f"ofID{n}").over(Window.partitionBy(*by).orderBy(f"ofID{n}"))
        h = h.withColumn(f"_new{n}", F.coalesce(before != F.col(f"ofID{n}"), F.lit(True)))
    out = h.groupBy(*by).agg(
        F.min("start1").alias("startBp1"), F.max("end1").alias("endBp1"), F.min("ord1").alias("startOrd1"), F.max("ord1").alias("endOrd1"),
        F.min_by("ofID1", F.struct("ord1", "ofID1")).alias("firstGene1"), F.max_by("ofID1", F.struct("ord1", "ofID1")).alias("lastGene1"), F.count_if("_new1").alias("nHits1"),
        F.min("start2").alias("minBp2"), F.max("end2").alias("maxBp2"), F.min("ord2").alias("minOrd2"), F.max("ord2").alias("maxOrd2"),
        F.min_by("ofID2", F.struct("ord2", "ofID2")).alias("minGene2"), F.max_by("ofID2", F.struct("ord2", "ofID2")).alias("maxGene2"), F.count_if("_new2").alias("nHits2"),
        F.covar_pop(F.col("ord1").cast("double"), F.col("ord2").cast("double")).alias("_r"),
    )
    minus = F.coalesce((F.col("_r") < 0) & ~F.isnan("_r"), F.lit(False))
    turn = lambda a, b: F.when(minus, F.col(b)).otherwise(F.col(a))
    return out.withColumns({
        "orient": F.when(minus, "-").otherwise("+"), "startBp2": turn("minBp2", "maxBp2"), "endBp2": turn("maxBp2", "minBp2"), "startOrd2": turn("minOrd2", "maxOrd2"),
        "endOrd2": turn("maxOrd2", "minOrd2"), "firstGene2": turn("minGene2", "maxGene2"), "lastGene2": turn("maxGene2", "minGene2"),
    }).drop("_r")


def unphased(hits: DataFrame, size: int, use_regions: bool = False) -> DataFrame:
    """Coordinates of the blocks (or regions) with ``size`` anchors or more."""
    h = hits.where("isAnchor")
    h = h.withColumn("blkID", F.col("regID")) if use_regions else h
    return coordinates(h.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("genome1", "genome2", "blkID"))).where(F.col("_n") >= size).drop("_n"))


_PLACED = ["blkID", *(f"{c}{n}" for n in (1, 2) for c in ("genome", "chr", "ofID", "start", "end", "ord"))]


def phased(hits: DataFrame, reference: str, size: int, radius: float, use_regions: bool = False, region: tuple[str, int, int] | None = None) -> DataFrame:
    """Coordinates of blocks split by the reference chromosome that both ends descend from, with ``refChr`` and ``refGenome``.

    A gene carries the reference chromosomes of its hits in blocks with the reference (all such hits, or those that overlap ``region``: a chromosome of the reference,
    start and end in base pairs). Anchors whose ends agree in one are counted by block and reference chromosome; of those with ``size`` or more, dense clusters
    on the ranks within their block are the new blocks, noise left out. With ``use_regions`` regions are taken for blocks. Without a hit on the reference there are none.
    """
    h = (hits.withColumn("blkID", F.col("regID")) if use_regions else hits).where("blkID is not null")
    view = H.reference_view(h, reference)
    if region is not None:
        chr_, low, high = region
        view = view.where((F.col("chr1") == chr_) & (F.col("end1") >= low) & (F.col("start1") <= high))
    to_ref = scratch.materialize(view.select(F.explode(F.array("ofID1", "ofID2")).alias("ofID"), F.col("chr1").alias("refChr")).where("ofID is not null and refChr is not null").distinct(), "references")
    a = h.where("isAnchor").dropna(subset=["ofID1", "ofID2", "chr1", "chr2", "ord1", "ord2"]).select(*_PLACED)
    enough = F.count(F.lit(1)).over(Window.partitionBy("genome1", "genome2", "blkID"))  # a smaller block has no part of that size
    a = a.withColumn("_n", enough).where(F.col("_n") >= size).drop("_n")
    a = a.join(to_ref.withColumnsRenamed({"ofID": "ofID1", "refChr": "_c1"}), "ofID1").join(to_ref.withColumnsRenamed({"ofID": "ofID2", "refChr": "_c2"}), "ofID2")
    a = a.where("_c1 = _c2").withColumn("refChr", F.col("_c1")).drop("_c1", "_c2")
    pair, by = ["genome1", "genome2"], ["genome1", "genome2", "chr1", "chr2", "blkID", "refChr"]
    dense = lambda n: F.dense_rank().over(Window.partitionBy(*pair, "blkID").orderBy(f"ord{n}")).cast("double")
    a = a.withColumns({"_x": dense(1), "_y": dense(2), "_n": F.count(F.lit(1)).over(Window.partitionBy(*by))}).where(F.col("_n") >= size).drop("_n")

    def cluster(pdf):
        pdf = pdf.sort_values(["ord1", "ord2", "ofID1", "ofID2"])
        pdf["_k"] = spatial.dbscan_kernel(pdf["_x"].to_numpy(), pdf["_y"].to_numpy(), radius, size)
        return pdf[pdf["_k"] > 0]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in a.schema) + ", _k long"
    found = a.groupBy(*by).applyInPandas(cluster, schema).drop("_x", "_y")  # a group is one block
    named = scratch.materialize(found.withColumn("blkID", F.concat_ws("_", "blkID", F.col("_k").cast("string"))).drop("_k"), "phased")
    parts = coordinates(named.withColumn("blkID", F.concat_ws("\u0001", "refChr", "blkID")), mirror=True)
    at = F.split("blkID", "\u0001")
    return parts.withColumns({"refChr": at[0], "blkID": at[1], "refGenome": F.lit(reference)})


def genes_in_blocks(blocks: DataFrame, genes: DataFrame) -> DataFrame:
    """For both genomes of each block, the genes between its bounds: ``(blkID, side, ofID, chr, ord)``."""
    sides = [(1, "startOrd1", "endOrd1"), (2, "minOrd2", "maxOrd2")]
    parts = []
    for n, lo, hi in sides:
        b = blocks.select("blkID", F.lit(n).alias("side"), F.col(f"genome{n}").alias("genome"), F.col(f"chr{n}").alias("chr"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
        b = b.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_lo") / 100), F.floor(F.col("_hi") / 100))))
        g = genes.select("genome", "chr", "ofID", "ord").withColumn("_bin", F.floor(F.col("ord") / 100))
        parts.append(b.join(g, ["genome", "chr", "_bin"]).where("ord between _lo and _hi").select("blkID", "side", "genome", "ofID", "chr", "ord"))
    return parts[0].unionByName(parts[1])


def interpolated_positions(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """The position of every array representative in a block, and of its anchors, on the block's other genome, in fractional ranks.

    Both directions; where a gene is placed more than once at one rank of one block, once.
    """
    spark = hits.sparkSession
    anchors = hits.where("isAnchor and blkID is not null").select("blkID", *(f"{c}{n}" for n in (1, 2) for c in ("genome", "chr", "ofID", "ord")))
    with scratch.shuffles_removed(spark):  # both directions are asked for more than once, and are written once
        both = scratch.materialize(ranks.keep_first(anchors.unionByName(H.swapped(anchors)), ["blkID", "ofID1", "ofID2"], ["genome1"]), "both")
        rest = scratch.materialize(_between_anchors(both, genes), "between")
    known = both.withColumn("ord2", F.col("ord2").cast("double"))
    every = known.unionByName(rest.select(*known.columns))
    out = spatial.interpolate(every, ["blkID", "genome1", "genome2"], "ord1", "ord2", "_pos").withColumn("ord2", F.col("_pos")).drop("_pos").where("ord2 is not null")
    out = out.select("blkID", "genome1", "chr1", "genome2", "chr2", "ofID1", "ofID2", "ord1", "ord2")
    return ranks.keep_first(out, ["blkID", "genome1", "genome2", "ofID1", "ord2"], [F.col("ofID2").asc_nulls_last()])


def _between_anchors(both: DataFrame, genes: DataFrame) -> DataFrame:
    """The array representatives between the bounds of each block that aren't among its anchors."""
    bounds = both.groupBy("blkID", "genome1", "chr1", "genome2", "chr2").agg(F.min("ord1").alias("_lo"), F.max("ord1").alias("_hi"))
    binned = bounds.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_lo") / 100), F.floor(F.col("_hi") / 100))))
    g = genes.where("isArrayRep").select(F.col("genome").alias("genome1"), F.col("chr").alias("chr1"), F.col("ofID").alias("ofID1"), F.col("ord").alias("ord1")).withColumn("_bin", F.floor(F.col("ord1") / 100))
    at = binned.join(g, ["genome1", "chr1", "_bin"]).where("ord1 between _lo and _hi").drop("_lo", "_hi", "_bin")
    own = both.select("blkID", "genome1", "genome2", "ofID1").distinct()
    return at.join(own, ["blkID", "genome1", "genome2", "ofID1"], "left_anti").withColumns({"ofID2": F.lit(None).cast("string"), "ord2": F.lit(None).cast("double")})


def position_census(positions: DataFrame, genes: DataFrame) -> DataFrame:
    """Per pair of genomes: genes of the first with none, one, two or more positions on the second."""
    n = positions.groupBy("genome1", "genome2", "ofID1").agg(F.count_distinct("chr2", "ord2").alias("n"))
    pairs = positions.select("genome1", "genome2").distinct()
    every = genes.select(F.col("genome").alias("genome1"), F.col("ofID").alias("ofID1")).join(pairs, "genome1")
    c = every.join(n, ["genome1", "genome2", "ofID1"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return c.groupBy("genome1", "genome2").agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in (0, 1, 2)), F.count_if(F.col("n") > 2).alias("nMore"))
