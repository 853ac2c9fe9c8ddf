"""Questions to the results: hits, pan-genes and copy numbers, by region or as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synblock.operators import hits as H
from synblock.operators import intervals, pangenes

LAST = (1 << 62) - 1


def regions(bed: DataFrame, genes: DataFrame) -> DataFrame:
    """``(region, genome, chr, start, end)`` with open ends filled in; a chromosome that no gene is on is an error."""
    unknown = bed.select("genome", "chr").distinct().join(genes.select("genome", "chr").distinct(), ["genome", "chr"], "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"no genes on {[tuple(r) for r in unknown]}")
    have = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in bed.columns else F.lit(default)
    b = bed.select("genome", "chr", have("start", 0).cast("long").alias("start"), have("end", LAST).cast("long").alias("end"))
    return b.withColumn("region", F.concat(F.col("genome"), F.lit(", "), F.col("chr"), F.lit(": "), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))


def _clipped(bed: DataFrame, genes: DataFrame) -> DataFrame:
    """``genome, chr, region, _s, _e``: regions clipped to the genes' extent, so that none has more bins than its chromosome."""
    extent = genes.groupBy("genome", "chr").agg(F.max("end").alias("_last"))
    return regions(bed, genes).join(extent, ["genome", "chr"]).select("genome", "chr", "region", F.col("start").alias("_s"), F.least("end", "_last").alias("_e"))


def _overlapping(genes: DataFrame, bed: DataFrame) -> DataFrame:
    """Genes with each region that they overlap."""
    return intervals.overlap_join(genes, _clipped(bed, genes), ["genome", "chr"], "start", "end", "_s", "_e", 1_000_000).drop("_s", "_e")


def region_hits(hits: DataFrame, bed: DataFrame, genes: DataFrame, synteny_only: bool = True) -> DataFrame:
    """Hits whose gene on the region's genome overlaps the region, seen from that genome, with the region's label."""
    h = hits.where("isSyntenic") if synteny_only else hits
    every = H.swapped(h.where("genome1 != genome2")).unionByName(h)
    every = every.dropDuplicates(["ofID1", "ofID2"])
    r = _clipped(bed, genes).withColumnsRenamed({"genome": "genome1", "chr": "chr1"})
    return intervals.overlap_join(every, r, ["genome1", "chr1"], "start1", "end1", "_s", "_e", 1_000_000).drop("_s", "_e")


def region_pangenes(pan: DataFrame, bed: DataFrame, genes: DataFrame, genomes: list[str], show_unplaced: bool = False, **how) -> DataFrame:
    """Wide pan-genes between the first and the last whose genes lie within each region."""
    r = regions(bed, genes)
    within = genes.join(r.select("region", "genome", "chr", F.col("start").alias("_s"), F.col("end").alias("_e")), ["genome", "chr"]).where("start >= _s and end <= _e").select("region", "ofID")
    bounds = pan.join(within, "ofID").where("interpChr is not null").groupBy("region", "interpChr").agg(F.min("pgID").alias("_lo"), F.max("pgID").alias("_hi"))
    table = pan if show_unplaced else pan.where("interpChr is not null")
    met = table.join(bounds, "interpChr").where("pgID between _lo and _hi")
    keep = met.select("region", "pgID").distinct()
    return keep.join(pangenes.wide(met.drop("region", "_lo", "_hi").dropDuplicates(["pgID", "ofID"]), genomes, **how), "pgID")


def reference_pangenes(pan: DataFrame, genes: DataFrame, genomes: list[str], show_unplaced: bool = False, **how) -> DataFrame:
    """All pan-genes of a reference, wide, with name and position of each one's representative."""
    table = pan if show_unplaced else pan.where("interpChr is not null")
    rep = genes.select(F.col("ofID").alias("pgRepID"), F.col("id").alias("repGene"), F.col("genome").alias("repGenome"), F.col("chr").alias("repChr"), F.col("start").alias("repStart"), F.col("end").alias("repEnd"))
    return pangenes.wide(table, genomes, **how).join(rep, "pgRepID", "left")


def copy_numbers(genes: DataFrame, kinds: dict[str, Column | str], only_representatives: bool = False, most: int | None = None, bed: DataFrame | None = None) -> DataFrame:
    """``genome, ogType, copyNumber, nGenes, nOgs, percGenes, percOGs``: groups with 0, 1, 2 … members in each genome.

    ``kinds`` names the columns that hold groups. Numbers above ``most`` count as ``most``. With ``bed`` there is a table for each of its
    regions, told apart by ``region``, of the groups that have a gene there. Of a kind only genomes that have any of its groups are counted.
    """
    g = genes.where("isArrayRep") if only_representatives else genes
    c = lambda x: F.col(x) if isinstance(x, str) else x
    kind = F.explode(F.array(*(F.struct(F.lit(k).alias("ogType"), c(x).alias("og")) for k, x in kinds.items()))).alias("s")
    long = g.select("genome", kind).select("genome", "s.ogType", "s.og").where("og is not null")
    by = ["ogType"]
    if bed is not None:
        found = _overlapping(g, bed).select("region", kind).select("region", "s.ogType", "s.og").where("og is not null").distinct()
        long, by = long.join(found, ["ogType", "og"]), ["region", "ogType"]
    counts = long.groupBy(*by, "og", "genome").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy(*by, "og").agg(F.map_from_entries(F.collect_list(F.struct("genome", "n"))).alias("_n"))
    present = counts.groupBy(*by).agg(F.collect_set("genome").alias("_genomes"))  # a row a kind and region
    full = groups.join(F.broadcast(present), by).select(*by, "og", "_n", F.explode("_genomes").alias("genome")).withColumn("n", F.coalesce(F.col("_n")[F.col("genome")], F.lit(0)))
    number = F.least("n", F.lit(most)) if most is not None else F.col("n")
    out = full.groupBy("genome", *by, number.cast("long").alias("copyNumber")).agg(F.count(F.lit(1)).alias("nOgs"))
    out = out.withColumn("nGenes", F.col("copyNumber") * F.col("nOgs"))
    w = Window.partitionBy("genome", *by)
    order = [*(["region"] if bed is not None else []), "genome", "ogType", "copyNumber", "nGenes", "nOgs"]
    return out.select(*order).withColumns({"percGenes": 100.0 * F.col("nGenes") / F.sum("nGenes").over(w), "percOGs": 100.0 * F.col("nOgs") / F.sum("nOgs").over(w)})
