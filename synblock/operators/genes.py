"""The gene table: rank order, orthogroup placements, quality flags, tandem arrays.

A gene table has ``genome, chr, start, end, id, ofID, pepLen, ord, og`` (and the flags added here).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synblock import scratch
from synblock.functions.columns import chromosome_number
from synblock.operators import ranks


def gene_order(beds: DataFrame) -> DataFrame:
    """Adds ``ord``: the rank of a gene in its genome, by chromosome number, name, size and start."""
    size = F.count(F.lit(1)).over(Window.partitionBy("genome", "chr"))
    w = Window.partitionBy("genome").orderBy(F.col("_n").asc_nulls_first(), "chr", F.desc("_size"), "start", "end", "ofID")
    return beds.withColumns({"_n": chromosome_number(F.col("chr")), "_size": size}).withColumn("ord", F.row_number().over(w).cast("long")).drop("_n", "_size")


def attach(genes: DataFrame, table: DataFrame, key: list[str], column: str) -> DataFrame:
    """A dictionary look-up: the table's first value (the least) per key, null where it has none."""
    return genes.join(table.where(F.col(column).isNotNull()).groupBy(*key).agg(F.min(column).alias(column)), key, "left")


def fill_orthogroups(genes: DataFrame, column: str = "og", prefix: str = "NoOG") -> DataFrame:
    """Genes without a group get one of their own, numbered in gene order within their genome."""
    missing = F.col(column).isNull()
    n = F.sum(missing.cast("int")).over(Window.partitionBy("genome").orderBy("ord", "ofID").rowsBetween(Window.unboundedPreceding, 0))
    return genes.withColumn(column, F.when(missing, F.concat(F.lit(prefix), F.lpad(n.cast("string"), 5, "0"), F.lit("_"), F.col("genome"))).otherwise(F.col(column)))


def placements(genes: DataFrame, jump: int) -> DataFrame:
    """Adds ``nOGPlaces``: how many groups of members more than ``jump`` ranks apart an orthogroup has in a genome."""
    w = Window.partitionBy("genome", "og").orderBy("ord", "ofID")
    far = F.coalesce((F.col("ord") - F.lag("ord").over(w) > jump).cast("long"), F.lit(1))
    return genes.withColumn("_far", far).withColumn("nOGPlaces", F.sum("_far").over(Window.partitionBy("genome", "og"))).drop("_far")


def small_chromosomes(genes: DataFrame, block_size: int) -> DataFrame:
    """Adds ``smallChr``: fewer than twice ``block_size`` distinct orthogroups on the chromosome."""
    n = genes.groupBy("genome", "chr").agg(F.count_distinct("og").alias("_n"))
    return genes.join(n, ["genome", "chr"], "left").withColumn("smallChr", F.col("_n") < 2 * block_size).drop("_n")


def dispersed(genes: DataFrame, jump: int, most: int) -> DataFrame:
    """Adds ``dispOG``: the orthogroup has more than ``most`` placements in the genome."""
    return placements(genes, jump).withColumn("dispOG", F.col("nOGPlaces") > most).drop("nOGPlaces")


def array_round(genes: DataFrame, buffer: int, order: str = "ord") -> DataFrame:
    """Adds ``arrayID``: genes of one genome, chromosome and orthogroup with ranks at most ``buffer`` apart."""
    dense = ranks.dense_rank(genes, ["genome"], order, "_rank")
    sessions = ranks.gap_sessions(dense, ["genome", "chr", "og"], "_rank", buffer, "_session", ["ofID"])
    return sessions.withColumn("arrayID", F.concat_ws("_", "genome", "chr", "og", F.col("_session").cast("string"))).drop("_session", "_rank")


def tandem_arrays(genes: DataFrame, buffer: int, rounds: int = 10, always: bool = False) -> DataFrame:
    """``arrayID`` by rounds: arrays found, their genes moved to the mean rank, until the number of arrays stops falling (with ``always``, all rounds); the last round counts.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs a re-read.
    """
    spark = genes.sparkSession
    now, path = scratch.written(array_round(genes.withColumn("_ord", F.col("ord").cast("double")), buffer, "_ord"), "arrays")
    n = now.select("arrayID").distinct().count()
    for _ in range(rounds - 1):
        moved = now.withColumn("_ord", F.avg("_ord").over(Window.partitionBy("arrayID"))).drop("arrayID")
        new, new_path = scratch.written(array_round(moved, buffer, "_ord"), "arrays")
        count = new.select("arrayID").distinct().count()
        scratch.delete(spark, path)
        now, path = new, new_path
        if count >= n and not always:
            break
        n = count
    return now.drop("_ord")


def array_representatives(genes: DataFrame) -> DataFrame:
    """Adds ``isArrayRep``: of each array the gene nearest to its median rank, then the longest peptide, then the first."""
    median = genes.groupBy("arrayID").agg(F.median("ord").alias("_m"))
    away = genes.join(median, "arrayID", "left").withColumn("_d", F.abs(F.col("ord") - F.col("_m")))
    first = F.row_number().over(Window.partitionBy("arrayID").orderBy("_d", F.desc_nulls_last("pepLen"), "ord", "ofID"))
    return away.withColumn("isArrayRep", first == 1).drop("_d", "_m")


def annotate(beds: DataFrame, block_size: int = 5, buffer: int = 100, max_places: int = 8) -> DataFrame:
    """The whole gene table from positions, peptide lengths and orthogroups."""
    genes = gene_order(beds)
    genes = fill_orthogroups(genes)
    genes = small_chromosomes(dispersed(genes, buffer // 2, max_places), block_size)
    genes = array_representatives(tandem_arrays(genes, buffer))
    return genes.withColumn("noAnchor", F.col("smallChr") | F.col("dispOG") | ~F.col("isArrayRep")).drop("smallChr", "dispOG")


def flag_shares(genes: DataFrame) -> DataFrame:
    """Per genome: genes on small chromosomes and in dispersed orthogroups, and whether either is above five percent."""
    return genes.groupBy("genome").agg(
        F.count(F.lit(1)).alias("nGenes"), F.count_if("smallChr").alias("nSmallChr"), F.count_if("dispOG").alias("nDispOG"),
        (F.avg(F.col("smallChr").cast("double")) > 0.05).alias("manySmall"), (F.avg(F.col("dispOG").cast("double")) > 0.05).alias("manyDispersed"),
    )
