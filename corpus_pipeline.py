"""A training corpus from raw documents: quality rules, near-duplicates, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synblock import scratch
from synblock.llm import bpe, mixing, quality, simhash
from synblock.llm.queries import PATTERN, RANKS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: the one with the smallest id, null ids last, then the smallest fingerprint.

    Rows are told apart by a number of their own, so ids may be null or shared by texts that aren't linked.
    """
    return simhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, and that they decode to its text."""
    out = bpe.encoded(docs, RANKS, PATTERN, decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("mixing sources", mix_sources), ("BPE encoding and decoding", encode)]

#: Expectation maximisation, covering hashing and BPE can't be put into SQL; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch.recording() as made:
            docs, path = scratch.written(stage(spark, docs, sf_dir), "stage")
        for old in {*made, before} - {path, None}:  # read by nothing from here on
            scratch.delete(spark, old)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
