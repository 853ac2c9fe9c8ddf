"""Gene tables made of the order tables, the same on Spark and in plain SQL.

Three genomes whose genes are collinear by construction; one has inverted chromosomes, another
translocated ends. ``genes`` are positions and orthogroups, ``ranked`` has ranks, ``hits`` are the pairs of genes of
one orthogroup in two genomes, ``blocks`` the hits cut where neighbours are far apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GENES = """
SELECT concat('G', CAST(g AS STRING)) AS genome, concat('chr', CAST(ci2 AS STRING)) AS chr,
  CAST(ps2 * 1000 + 1 AS BIGINT) AS start, CAST(ps2 * 1000 + 100 + c % 700 AS BIGINT) AS `end`,
  concat('g', CAST(k AS STRING)) AS ofID, concat('g', CAST(k AS STRING)) AS id, CAST(100 + c % 400 AS BIGINT) AS pepLen,
  concat('OG', CAST(CASE WHEN c % 10 = 0 THEN locus DIV 2 * 2 WHEN c % 10 = 1 THEN (locus + 1777) % 5000 ELSE locus END AS STRING)) AS og
FROM (SELECT *, CASE WHEN g = 2 AND ps >= 400 THEN ci + 1 ELSE ci END AS ci2,
        CASE WHEN g = 1 AND ci % 4 = 3 THEN 499 - ps WHEN g = 2 AND ps >= 400 THEN ps + 200 ELSE ps END AS ps2
      FROM (SELECT *, locus DIV 500 AS ci, locus % 500 AS ps
            FROM (SELECT o_orderkey AS k, o_orderkey % 3 AS g, o_orderkey DIV 3 AS locus, o_custkey AS c FROM orders) b) p) q
"""
RANKED = """
SELECT *, CAST(row_number() OVER (PARTITION BY genome ORDER BY TRY_CAST(replace(chr, 'chr', '') AS DOUBLE), chr, start, ofID) AS BIGINT) AS ord FROM genes
"""
HITS = """
SELECT a.genome AS genome1, a.chr AS chr1, a.start AS start1, a.`end` AS end1, a.ofID AS ofID1, a.id AS id1, a.ord AS ord1, a.og AS og,
  b.genome AS genome2, b.chr AS chr2, b.start AS start2, b.`end` AS end2, b.ofID AS ofID2, b.id AS id2, b.ord AS ord2,
  CAST(100 + (a.pepLen * 7 + b.pepLen * 3) % 900 AS DOUBLE) AS bitScore
FROM ranked a JOIN ranked b ON a.og = b.og AND a.genome < b.genome
"""
BLOCKS = """
SELECT *, concat(genome1, '_', genome2, '_', chr1, '_', chr2, '_', CAST(s AS STRING)) AS blkID FROM (
  SELECT *, CAST(sum(j) OVER (PARTITION BY genome1, genome2, chr1, chr2 ORDER BY ord1, ord2, ofID1, ofID2 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM (
    SELECT *, CASE WHEN ord1 - lag(ord1) OVER (PARTITION BY genome1, genome2, chr1, chr2 ORDER BY ord1, ord2, ofID1, ofID2) > 25 THEN 1 ELSE 0 END AS j FROM hits) x) y
"""
VIEWS = {"genes": GENES, "ranked": RANKED, "hits": HITS, "blocks": BLOCKS}


def duck(sql: str) -> str:
    """The same text for DuckDB."""
    return sql.replace(" DIV ", " // ").replace("AS STRING)", "AS VARCHAR)").replace("`", '"')


def with_views(sql: str, *views: str) -> str:
    """``sql`` with the named views, and those they are made of, before it."""
    order = list(VIEWS)
    need = order[: max(order.index(v) for v in views) + 1] if views else []
    head = ",\n".join(f"{v} AS ({duck(VIEWS[v]).strip()})" for v in need)
    body = sql.strip()
    if not need:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    return f"WITH {head},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head}\n{body}"


class Tables:
    """The tables of a folder, and the views made of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.made = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self.made:
            if name in VIEWS:
                source = {"genes": "orders", "ranked": "genes", "hits": "ranked", "blocks": "hits"}[name]
                sql = VIEWS[name].replace(f"FROM {source}", "FROM {t}").replace(f"JOIN {source}", "JOIN {t}")
                self.made[name] = self.spark.sql(sql, t=getattr(self, source))
            else:
                self.made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.made[name]
