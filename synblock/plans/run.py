"""The whole analysis: genes, hits, blocks, orthogroups, positions, pan-genes."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synblock import scratch
from synblock.operators import blocks, genes, hits, orthogroups, pangenes, synteny
from synblock.plans.params import Params
from synblock.sources import tables


@dataclass
class Result:
    genes: DataFrame
    hits: DataFrame
    positions: DataFrame
    blocks: DataFrame
    regions: DataFrame
    pangenes: dict[str, DataFrame]

    def pairs(self) -> DataFrame:
        """All pairs of genes whose arrays a syntenic hit connects."""
        return hits.array_pairs(self.hits.where("isSyntenic"), self.genes)


def _keep_parameters(spark: SparkSession, params: Params, folder: str) -> None:
    """Writes the parameters to the folder, or refuses a folder that was made with others."""
    text, path = json.dumps(asdict(params), sort_keys=True), f"{folder}/parameters"
    if scratch.exists(spark, f"{path}/_SUCCESS"):
        found = spark.read.text(path, wholetext=True).first()[0].strip()
        if found != text:
            raise ValueError(f"{folder} was made with other parameters: {found}")
    else:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def run(params: Params, beds: DataFrame, forward: DataFrame, reverse: DataFrame | None = None, orthologues: DataFrame | None = None, references: tuple[str, ...] | None = None, folder: str | None = None) -> Result:
    """From genes ``(genome, chr, start, end, id, ofID, pepLen, og)``, perhaps with ``hog``, and alignments to pan-genes of every reference.

    What later steps use more than once is written to the shared folder. With ``folder`` all results are written there, blocks and
    regions as CSV too, and a run that finds a step's table there takes it up from it; the parameters must be the same.
    """
    spark = beds.sparkSession
    if folder:
        _keep_parameters(spark, params, folder)

    def step(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if folder is None:
            return scratch.materialize(make(), name.rsplit("/", 1)[-1])
        path = f"{folder}/{name}"
        if not scratch.exists(spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    if "hog" in beds.columns:  # hierarchical groups beside the flat ones
        beds = beds.withColumns({"globOG": F.col("og"), "globHOG": F.col("hog"), "og": F.coalesce("hog", "og") if params.use_hogs else F.col("og")}).drop("hog")
    kept = [g for g in params.genomes if g not in params.outgroup]
    first = step("annotated", lambda: genes.annotate(beds.where(F.col("genome").isin(kept)), params.block_size, params.buffer, params.places))
    search = lambda: synteny.synteny(scratch.materialize(hits.annotate(forward, reverse, first), "hits"), params.settings(), params.ploidy, params.second())
    found = step("hits", search) if folder else search()
    some = found if folder else scratch.materialize(found.where("isSyntenic"), "syntenic")  # what later steps read
    table = step("genes", lambda: orthogroups.syntenic_orthogroups(first, some))
    between = some.where("genome1 != genome2")
    positions = step("positions", lambda: blocks.interpolated_positions(between, table))
    make = {r: (lambda r=r: pangenes.pangenes(table, positions, r, params.buffer, params.max_place_per_chr, params.min_share, orthologues)) for r in references or kept}
    pans = {r: step(f"pangenes/{r}", f) if folder else f() for r, f in make.items()}
    whole = {name: blocks.unphased(between, params.block_size, name == "regions") for name in ("blocks", "regions")}
    if folder:
        whole = {name: step(name, lambda df=df: df) for name, df in whole.items()}
        for name, df in whole.items():
            if not scratch.exists(spark, f"{folder}/{name}_csv/_SUCCESS"):
                tables.write_csv(df, f"{folder}/{name}_csv")
    return Result(table, found, positions, whole["blocks"], whole["regions"], pans)
