"""The operators over their whole tables, as registered in ``__spark_entry__.py``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synblock.llm import bpe, centroids, edits, hmm, html, minhash, mixing, quality, sharding, simhash, spelling, topk, warc

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(_table(spark, sf_dir, "documents"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encoded(_table(spark, sf_dir, "documents"), RANKS, PATTERN, decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_table(spark, sf_dir, "documents"))


def op8_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens before and after three edits that its id decides, and the characters encoded anew."""
    docs = _table(spark, sf_dir, "documents").withColumn("edits", edits.sample_edits())
    return edits.followed(docs, RANKS, PATTERN).select("doc_id", "n_tokens_before", "n_tokens", "n_encoded")


def op9_kd_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(_table(spark, sf_dir, "embeddings"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash_dedup, op2_html_text, op3_mix_sources, op4_quality_rules, op5_kd_shards, op6_bpe_codec, op7_hmm_score, op8_edit_counts, op9_kd_topk, op10_warc_archive, op11_spelling_variants, op12_centroid_clusters, op13_minhash_dedup)}
ORACLE_SQL = {"op3_mix_sources": mixing.ORACLE, "op9_kd_topk": topk.ORACLE, "op10_warc_archive": warc.ORACLE, "op12_centroid_clusters": centroids.oracle(), "op13_minhash_dedup": minhash.ORACLE}
