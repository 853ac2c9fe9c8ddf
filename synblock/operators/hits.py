"""The hit table: alignments between genes, with the coordinates of both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synblock.operators import ranks

END = ("ofID", "chr", "start", "end", "id", "ord", "genome", "isArrayRep")
SCORES = ("pid", "length", "mismatches", "gapopenings", "queryStart", "queryEnd", "subjectStart", "subjectEnd", "Evalue", "bitScore")


def suffixed(genes: DataFrame, n: int, extra: tuple[str, ...] = ("og", "noAnchor")) -> DataFrame:
    return genes.select(*(F.col(c).alias(f"{c}{n}") for c in (*END, *extra) if c in genes.columns))


def swapped(hits: DataFrame) -> DataFrame:
    """Every hit seen from its other end."""
    ends = {c[:-1] for c in hits.columns if c.endswith("1") and f"{c[:-1]}2" in hits.columns}
    turn = {f"{c}1": f"{c}2" for c in ends} | {f"{c}2": f"{c}1" for c in ends} | {"queryStart": "subjectStart", "queryEnd": "subjectEnd", "subjectStart": "queryStart", "subjectEnd": "queryEnd"}
    return hits.select(*(F.col(turn.get(c, c) if turn.get(c, c) in hits.columns else c).alias(c) for c in hits.columns))


def ranked_pairs(genes: DataFrame) -> DataFrame:
    """``genome1, genome2, ofID1, ofID2, r1, r2``: pairs of genes of one group in two genomes, with the dense ranks of both among the genes that are in such a pair.

    Ranks are those of genes and are joined before genes meet, so that pairs, whose number grows with the square of a group, are neither sorted nor dealt out.
    """
    there = genes.select("og", "genome").distinct()
    sides = []
    for n, other in ((1, 2), (2, 1)):
        own = genes.select("og", F.col("genome").alias(f"genome{n}"), F.col("ofID").alias(f"ofID{n}"), F.col("ord").alias(f"_ord{n}"))
        met = own.join(there.withColumnRenamed("genome", f"genome{other}"), "og").where("genome1 < genome2")
        sides.append(ranks.dense_rank_by_ranges(met, ["genome1", "genome2"], f"_ord{n}", f"r{n}").drop(f"_ord{n}"))
    return sides[0].join(sides[1], ["genome1", "genome2", "og"]).drop("og")


def best_per_pair(hits: DataFrame) -> DataFrame:
    """The best-scoring hit of each pair of genes."""
    return ranks.keep_first(hits, ["ofID1", "ofID2"], [F.desc_nulls_last("bitScore"), *(c for c in ("Evalue", "pid", "length") if c in hits.columns)])


def annotate(forward: DataFrame, reverse: DataFrame | None, genes: DataFrame) -> DataFrame:
    """Raw alignments in both directions, best per pair, with both genes' columns, ``sameOG`` and ``noAnchor``."""
    raw = forward if reverse is None else forward.unionByName(swapped(reverse))
    best = best_per_pair(raw.repartition("ofID1"))  # the first join finds its rows dealt out
    both = best.join(suffixed(genes, 1), "ofID1").join(suffixed(genes, 2), "ofID2")
    return both.withColumns({"sameOG": F.coalesce(F.col("og1") == F.col("og2"), F.lit(False)), "noAnchor": F.col("noAnchor1") | F.col("noAnchor2")}).drop("og1", "og2", "noAnchor1", "noAnchor2")


def top_both(hits: DataFrame, n1: int, n2: int) -> DataFrame:
    """Hits among the best ``n1`` of their first and ``n2`` of their second gene; scores count in tens, ties stay."""
    tens = -F.bround(F.col("bitScore"), -1)
    out = ranks.dense_rank(ranks.dense_rank(hits, ["genome1", "genome2", "ofID1"], tens, "_r1"), ["genome1", "genome2", "ofID2"], tens, "_r2")
    return out.where((F.col("_r1") <= n1) & (F.col("_r2") <= n2)).drop("_r1", "_r2")


def reciprocal_best(hits: DataFrame, by: list[str]) -> DataFrame:
    """Hits that are the best of both their genes within ``by``; ties go to the lesser partner."""
    from pyspark.sql import Window

    first = lambda a, b: F.row_number().over(Window.partitionBy(*by, a).orderBy(F.desc("bitScore"), b)) == 1
    return hits.withColumns({"_a": first("ofID1", "ofID2"), "_b": first("ofID2", "ofID1")}).where("_a and _b").drop("_a", "_b")


def reference_view(hits: DataFrame, genome: str) -> DataFrame:
    """Hits of one genome with it as the first end; of a pair in both directions, the one with it as query stays."""
    query = hits.where(F.col("genome1") == genome).withColumn("_turned", F.lit(0))
    target = swapped(hits.where(F.col("genome2") == genome)).withColumn("_turned", F.lit(1))
    return ranks.keep_first(query.unionByName(target), ["ofID1", "ofID2"], ["_turned", F.desc_nulls_last("bitScore")]).drop("_turned")


def array_pairs(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """All pairs of genes in the arrays that hits connect: ``(ofID1, ofID2)``."""
    member = genes.select("ofID", "arrayID")
    a = hits.select("ofID1", "ofID2").join(member.select(F.col("ofID").alias("ofID1"), F.col("arrayID").alias("a1")), "ofID1").join(member.select(F.col("ofID").alias("ofID2"), F.col("arrayID").alias("a2")), "ofID2")
    arrays = a.select("a1", "a2").distinct()
    return arrays.join(member.select(F.col("ofID").alias("ofID1"), F.col("arrayID").alias("a1")), "a1").join(member.select(F.col("ofID").alias("ofID2"), F.col("arrayID").alias("a2")), "a2").select("ofID1", "ofID2").distinct()


def summary(hits: DataFrame) -> DataFrame:
    """Per pair of genomes: hits, those in an orthogroup, anchors, blocks, chromosome pairs, and structural variants (blocks beyond one a pair)."""
    out = hits.groupBy("genome1", "genome2").agg(
        F.count(F.lit(1)).alias("nHits"), F.count_if("sameOG").alias("nOgHits"), F.count_if("isAnchor").alias("nAnchors"),
        F.count_distinct(F.when(F.col("isAnchor"), F.col("blkID"))).alias("nBlks"), F.count_distinct(F.when(F.col("blkID").isNotNull() & F.col("isAnchor"), F.struct("chr1", "chr2"))).alias("nChrPairs"),
    )
    return out.withColumn("nSVs", F.col("nBlks") - F.col("nChrPairs"))
