"""Interval, neighbourhood, gene, hit, block and pan-gene operators over the gene tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synblock import scratch
from synblock.operators import blocks, genes, graph, hits, intervals, orthogroups, pangenes, ranks, sequence, spatial, synteny, windows
from synblock.plans import layout, riparian
from synblock.plans import query as Q
from synblock.plans.catalogue import query
from synblock.plans.workload import Tables
from synblock.sources import tables

FEATURES = """f AS (SELECT genome, chr, 1 + (k * 7919) % 700000 AS fs, 1 + (k * 7919) % 700000 + k % 900 AS fe, k AS fid FROM (
  SELECT o_orderkey AS k, concat('G', CAST(o_custkey % 3 AS VARCHAR)) AS genome, concat('chr', CAST(o_orderkey // 3 // 500 AS VARCHAR)) AS chr FROM orders))"""


def features(t: Tables) -> DataFrame:
    """Intervals of no meaning, one an order, along all chromosomes of the genes, in the same way as in the SQL."""
    o = t.orders.select(F.col("o_orderkey").alias("fid"), F.concat(F.lit("G"), (F.col("o_custkey") % 3).cast("string")).alias("genome"), F.concat(F.lit("chr"), F.expr("o_orderkey div 3 div 500").cast("string")).alias("chr"))
    start = 1 + (F.col("fid") * 7919) % 700000
    return o.select("genome", "chr", start.alias("fs"), (start + F.col("fid") % 900).alias("fe"), "fid")


def intervals_of(t: Tables) -> DataFrame:
    return features(t).select("genome", "chr", F.col("fs").alias("start"), F.col("fe").alias("end"))


LENGTHS = "l AS (SELECT genome, chr, max(e) AS length FROM (SELECT genome, chr, fe AS e FROM f UNION ALL SELECT genome, chr, \"end\" FROM genes) GROUP BY 1, 2)"
REDUCED = """r AS (SELECT genome, chr, min(fs) AS s, max(fe) AS e, count(*) AS n FROM (
  SELECT *, sum(j) OVER (PARTITION BY genome, chr ORDER BY fs, fe, fid) AS i FROM (
    SELECT *, CASE WHEN fs - max(fe) OVER (PARTITION BY genome, chr ORDER BY fs, fe, fid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 >= 1 THEN 1 ELSE 0 END AS j FROM f)) GROUP BY genome, chr, i)"""
GENE_SPANS = """g AS (SELECT genome, chr, min(start) AS s, max("end") AS e FROM (
  SELECT *, sum(j) OVER (PARTITION BY genome, chr ORDER BY start, "end", ofID) AS i FROM (
    SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY genome, chr ORDER BY start, "end", ofID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 >= 1 THEN 1 ELSE 0 END AS j FROM genes)) GROUP BY genome, chr, i)"""
GAPS = """x AS (SELECT genome, chr, e + 1 AS s, lead(s) OVER (PARTITION BY genome, chr ORDER BY s, e) - 1 AS e FROM (
  SELECT genome, chr, s, e FROM r UNION ALL SELECT genome, chr, 0, 0 FROM l UNION ALL SELECT genome, chr, length + 1, length + 1 FROM l))"""
BOTH = ["genome", "chr"]


def lengths(t: Tables) -> DataFrame:
    """Chromosomes reach as far as their last gene or feature."""
    ends = intervals_of(t).select("genome", "chr", "end").unionByName(t.genes.select("genome", "chr", "end"))
    return ends.groupBy("genome", "chr").agg(F.max("end").alias("length"))


# Files, written and read again


@query("SELECT genome, chr, start, \"end\", id FROM genes", "genes")
def src01_bed(t: Tables) -> DataFrame:
    """A BED file per genome, of which the file's name is the genome's."""
    path = scratch.new_path(t.spark, "bed")
    for genome in ("G0", "G1", "G2"):
        tables.write_bed(t.genes.where(F.col("genome") == genome), f"{path}/{genome}.bed")
    return tables.read_bed(t.spark, f"{path}/*.bed").select("genome", "chr", "start", "end", "id")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, upper(regexp_replace(p_type, '[^A-Za-z]+', '', 'g')) AS seq, CAST(length(regexp_replace(p_type, '[^A-Za-z]+', '', 'g')) AS BIGINT) AS n FROM part WHERE length(regexp_replace(p_type, '[^A-Za-z]+', '', 'g')) >= 5")
def src02_fasta(t: Tables) -> DataFrame:
    seqs = t.part.select(F.col("p_partkey").cast("string").alias("id"), F.upper(F.regexp_replace("p_type", "[^A-Za-z]+", "")).alias("seq"))
    tables.write_fasta(seqs, path := scratch.new_path(t.spark, "fasta"), least=5)
    return tables.read_fasta(t.spark, path).select("id", "seq", F.length("seq").cast("long").alias("n"))


@query("SELECT ofID1, ofID2, bitScore, CAST(NULL AS BIGINT) AS length FROM hits", "hits")
def src07_blast(t: Tables) -> DataFrame:
    have = {"ofID1", "ofID2", "bitScore"}
    cols = [p.rsplit(" ", 1)[0] for p in tables.BLAST.split(", ")]
    raw = t.hits.select(*(F.col(c).cast("string").alias(c) if c in have else F.lit("NA").alias(c) for c in cols))
    raw.write.csv(path := scratch.new_path(t.spark, "blast"), sep="\t", compression="gzip")
    return tables.read_blast(t.spark, path).select("ofID1", "ofID2", "bitScore", "length")


@query("SELECT og, genome, id FROM genes", "genes")
def src10_orthogroups(t: Tables) -> DataFrame:
    wide = t.genes.groupBy("og").pivot("genome", ["G0", "G1", "G2"]).agg(F.array_join(F.collect_list("id"), ", "))
    wide.write.csv(path := scratch.new_path(t.spark, "orthogroups"), sep="\t", header=True)
    return tables.read_orthogroups(t.spark, path).select("og", "genome", "id")


@query("SELECT blkID, genome1, genome2, ofID1, ofID2, CAST(ord1 AS DOUBLE) AS ord1, CAST(ord2 AS DOUBLE) + 0.5 AS ord2 FROM blocks", "blocks")
def src17_positions(t: Tables) -> DataFrame:
    tables.write_table(t.blocks.withColumn("ord2", F.col("ord2") + F.lit(0.5).cast("double")), path := scratch.new_path(t.spark, "positions"), tables.POSITIONS)
    return tables.read_table(t.spark, path, tables.POSITIONS).drop("chr1", "chr2")


@query("SELECT ofID1, ofID2, bitScore FROM hits WHERE genome1 = 'G1' UNION ALL SELECT ofID2, ofID1, bitScore FROM hits WHERE genome2 = 'G1'", "hits")
def src19_reference_view(t: Tables) -> DataFrame:
    return hits.reference_view(t.hits, "G1").select("ofID1", "ofID2", "bitScore")


# Range joins


@query("SELECT h.ofID1, h.ofID2, a.ord AS ord1, b.ord AS ord2, a.og = b.og AS sameOG FROM (SELECT ofID1, ofID2 FROM (SELECT *, row_number() OVER (PARTITION BY ofID1, ofID2 ORDER BY bitScore DESC) AS r FROM hits) WHERE r = 1) h JOIN ranked a ON a.ofID = h.ofID1 JOIN ranked b ON b.ofID = h.ofID2", "hits")
def jn01_annotate_hits(t: Tables) -> DataFrame:
    g = t.ranked.withColumns({"isArrayRep": F.lit(True), "noAnchor": F.lit(False)})
    return hits.annotate(t.hits.select("ofID1", "ofID2", "bitScore"), None, g).select("ofID1", "ofID2", "ord1", "ord2", "sameOG")


@query(f"WITH {FEATURES} SELECT ofID, fid FROM genes JOIN f USING (genome, chr) WHERE start <= fe AND fs <= \"end\"", "genes")
def jn09_overlap_join(t: Tables) -> DataFrame:
    return intervals.overlap_join(t.genes, features(t), BOTH, "start", "end", "fs", "fe").select("ofID", "fid")


@query(f"WITH {FEATURES} SELECT ofID, fid FROM genes LEFT JOIN f ON genes.genome = f.genome AND genes.chr = f.chr AND start <= fe AND fs <= \"end\"", "genes")
def jn09_overlap_left(t: Tables) -> DataFrame:
    return intervals.overlap_join(t.genes, features(t), BOTH, "start", "end", "fs", "fe", how="left").select("ofID", "fid")


@query("WITH b AS (SELECT 1 AS side, genome1 AS genome, chr1 AS chr, blkID, min(ord1) AS lo, max(ord1) AS hi FROM blocks GROUP BY ALL UNION ALL SELECT 2, genome2, chr2, blkID, min(ord2), max(ord2) FROM blocks GROUP BY ALL) SELECT blkID, side, ofID FROM b JOIN ranked USING (genome, chr) WHERE ord BETWEEN lo AND hi", "blocks")
def jn11_genes_in_block(t: Tables) -> DataFrame:
    b = t.blocks.groupBy("blkID", "genome1", "chr1", "genome2", "chr2").agg(F.min("ord1").alias("startOrd1"), F.max("ord1").alias("endOrd1"), F.min("ord2").alias("minOrd2"), F.max("ord2").alias("maxOrd2"))
    return blocks.genes_in_blocks(b, t.ranked).select("blkID", "side", "ofID")


@query("WITH b AS (SELECT genome1, genome2, chr1, chr2, blkID AS box, min(ord1) AS x1, max(ord1) AS x2, min(ord2) AS y1, max(ord2) AS y2 FROM blocks GROUP BY ALL HAVING count(*) >= 5) SELECT ofID1, ofID2, min(box) AS box FROM hits LEFT JOIN b ON hits.genome1 = b.genome1 AND hits.genome2 = b.genome2 AND hits.chr1 = b.chr1 AND hits.chr2 = b.chr2 AND ord1 BETWEEN x1 AND x2 AND ord2 BETWEEN y1 AND y2 GROUP BY 1, 2", "blocks")
def jn12_point_in_box(t: Tables) -> DataFrame:
    by = ["genome1", "genome2", "chr1", "chr2"]
    b = t.blocks.groupBy(*by, F.col("blkID").alias("box")).agg(F.min("ord1").alias("x1"), F.max("ord1").alias("x2"), F.min("ord2").alias("y1"), F.max("ord2").alias("y2"), F.count(F.lit(1)).alias("n")).where("n >= 5").drop("n")
    return spatial.points_in_boxes(t.hits, b, by, "ord1", "ord2", ["ofID1", "ofID2"], "box").select("ofID1", "ofID2", "box")


ANCHOR = "CAST(substr(ofID1, 2) AS BIGINT) % 11 = 0"


@query(f"WITH a AS (SELECT * FROM hits WHERE {ANCHOR}) SELECT h.ofID1, h.ofID2, count(a.ofID1) > 0 AS near FROM hits h LEFT JOIN a ON a.genome1 = h.genome1 AND a.genome2 = h.genome2 AND a.chr1 = h.chr1 AND a.chr2 = h.chr2 AND (a.ord1 - h.ord1) * (a.ord1 - h.ord1) + (a.ord2 - h.ord2) * (a.ord2 - h.ord2) <= 625 GROUP BY 1, 2", "hits")
def jn13_radius_flag(t: Tables) -> DataFrame:
    h = t.hits.withColumn("anchor", F.substring("ofID1", 2, 20).cast("long") % 11 == 0)
    return spatial.flag_in_radius(h, ["genome1", "genome2", "chr1", "chr2"], "ord1", "ord2", "anchor", 25, ["ofID1", "ofID2"], "near").select("ofID1", "ofID2", "near")


@query(f"WITH a AS (SELECT * FROM hits WHERE {ANCHOR}) SELECT ofID1, ofID2, near_ofID1, near_ofID2 FROM (SELECT h.ofID1, h.ofID2, a.ofID1 AS near_ofID1, a.ofID2 AS near_ofID2, row_number() OVER (PARTITION BY h.ofID1, h.ofID2 ORDER BY (a.ord1 - h.ord1) * (a.ord1 - h.ord1) + (a.ord2 - h.ord2) * (a.ord2 - h.ord2), a.ofID1, a.ofID2) AS r FROM hits h LEFT JOIN a ON a.genome1 = h.genome1 AND a.genome2 = h.genome2 AND a.chr1 = h.chr1 AND a.chr2 = h.chr2 AND (a.ord1 - h.ord1) * (a.ord1 - h.ord1) + (a.ord2 - h.ord2) * (a.ord2 - h.ord2) <= 625) WHERE r = 1", "hits")
def jn14_nearest(t: Tables) -> DataFrame:
    h = t.hits.withColumn("anchor", F.substring("ofID1", 2, 20).cast("long") % 11 == 0)
    return spatial.nearest_in_radius(h, ["genome1", "genome2", "chr1", "chr2"], "ord1", "ord2", "anchor", 25, ["ofID1", "ofID2"], ["ofID1", "ofID2"]).select("ofID1", "ofID2", "near_ofID1", "near_ofID2")


@query("""WITH p AS (SELECT genome, chr, ord, ofID, CASE WHEN CAST(substr(ofID, 2) AS BIGINT) % 5 = 0 THEN CAST(start AS DOUBLE) END AS y FROM ranked),
w AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN ord END IGNORE NULLS) OVER a AS x0, last_value(y IGNORE NULLS) OVER a AS y0, first_value(CASE WHEN y IS NOT NULL THEN ord END IGNORE NULLS) OVER b AS x1, first_value(y IGNORE NULLS) OVER b AS y1 FROM p
WINDOW a AS (PARTITION BY genome, chr ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY genome, chr ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT ofID, round(CASE WHEN y IS NOT NULL THEN y WHEN x0 IS NULL OR x1 IS NULL THEN NULL ELSE y0 + (y1 - y0) / (x1 - x0) * (ord - x0) END, 6) AS pos FROM w""", "ranked")
def jn15_interpolate(t: Tables) -> DataFrame:
    p = t.ranked.withColumn("y", F.when(F.substring("ofID", 2, 20).cast("long") % 5 == 0, F.col("start").cast("double")))
    return spatial.interpolate(p, BOTH, "ord", "y", "pos").select("ofID", F.round("pos", 6).alias("pos"))


@query("WITH a AS (SELECT ofID, genome || chr || og AS arr FROM genes), h AS (SELECT DISTINCT x.arr AS a1, y.arr AS a2 FROM hits JOIN a x ON ofID1 = x.ofID JOIN a y ON ofID2 = y.ofID) SELECT DISTINCT x.ofID AS ofID1, y.ofID AS ofID2 FROM h JOIN a x ON a1 = x.arr JOIN a y ON a2 = y.arr", "hits")
def jn18_array_pairs(t: Tables) -> DataFrame:
    return hits.array_pairs(t.hits, t.genes.withColumn("arrayID", F.concat("genome", "chr", "og")))


# Intervals


@query(f"WITH {FEATURES}, {REDUCED} SELECT genome, chr, s AS start, e AS \"end\", n FROM r")
def iv01_reduce(t: Tables) -> DataFrame:
    return intervals.reduce(intervals_of(t), BOTH)


@query("SELECT doc_id AS chr, CAST(length(text) AS BIGINT) AS length FROM documents")
def iv02_lengths(t: Tables) -> DataFrame:
    return sequence.lengths(t.documents.select(F.col("doc_id").alias("chr"), F.col("text").alias("seq")))


@query(f"WITH {FEATURES}, {LENGTHS}, {REDUCED}, {GAPS} SELECT genome, chr, s AS start, e AS \"end\" FROM x WHERE e >= s", "genes")
def iv03_gaps(t: Tables) -> DataFrame:
    return intervals.gaps(intervals_of(t), lengths(t), BOTH)


@query(f"WITH {FEATURES}, {REDUCED}, {GENE_SPANS} SELECT g.genome, g.chr, greatest(g.s, r.s) AS start, least(g.e, r.e) AS \"end\" FROM g JOIN r ON g.genome = r.genome AND g.chr = r.chr AND g.s <= r.e AND r.s <= g.e", "genes")
def iv04_intersect(t: Tables) -> DataFrame:
    return intervals.intersect(t.genes.select("genome", "chr", "start", "end"), intervals_of(t), BOTH)


@query(f"WITH {FEATURES}, {LENGTHS}, {REDUCED}, {GAPS}, {GENE_SPANS} SELECT g.genome, g.chr, greatest(g.s, x.s) AS start, least(g.e, x.e) AS \"end\" FROM g JOIN x ON g.genome = x.genome AND g.chr = x.chr AND g.s <= x.e AND x.s <= g.e AND x.e >= x.s", "genes")
def iv05_subtract(t: Tables) -> DataFrame:
    return intervals.subtract(t.genes.select("genome", "chr", "start", "end"), intervals_of(t), lengths(t), BOTH)


@query(f"WITH {FEATURES}, {LENGTHS} SELECT genome, chr, CAST(1 AS BIGINT) AS start, length AS \"end\" FROM l", "genes")
def iv06_whole(t: Tables) -> DataFrame:
    return intervals.whole(lengths(t), BOTH)


@query(f"WITH {FEATURES}, {LENGTHS}, {REDUCED}, w AS (SELECT genome, chr, s AS ws, least(s + 99999, length) AS we FROM l, range(1, 1000001, 50000) q(s) WHERE s <= length) SELECT w.genome, w.chr, ws AS start, we AS \"end\", CAST(coalesce(sum(CASE WHEN s IS NOT NULL THEN least(we, e) - greatest(ws, s) + 1 END), 0) AS BIGINT) AS bp FROM w LEFT JOIN r ON w.genome = r.genome AND w.chr = r.chr AND ws <= e AND s <= we GROUP BY ALL", "genes")
def iv07_window_coverage(t: Tables) -> DataFrame:
    return intervals.coverage(intervals.windows(lengths(t), BOTH, 100000, 50000), intervals_of(t), BOTH)


@query(f"""WITH {FEATURES}, {LENGTHS}, {REDUCED}, {GAPS}, {GENE_SPANS}, c AS (
  SELECT genome, chr, s, e FROM (SELECT r.genome, r.chr, greatest(s, 1) AS s, least(e, length) AS e FROM r JOIN l USING (genome, chr)) WHERE e >= s),
b AS (SELECT g.genome, g.chr, greatest(g.s, x.s) AS s, least(g.e, x.e) AS e FROM g JOIN x ON g.genome = x.genome AND g.chr = x.chr AND g.s <= x.e AND x.s <= g.e AND x.e >= x.s)
SELECT genome, chr, class, CAST(sum(e - s + 1) AS BIGINT) AS bp FROM (SELECT *, 'feature' AS class FROM c UNION ALL SELECT *, 'gene' FROM b) GROUP BY ALL
UNION ALL SELECT l.genome, l.chr, 'unknown', CAST(max(length) - coalesce(sum(e - s + 1), 0) AS BIGINT) FROM l LEFT JOIN (SELECT * FROM c UNION ALL SELECT * FROM b) u ON u.genome = l.genome AND u.chr = l.chr GROUP BY ALL HAVING max(length) > coalesce(sum(e - s + 1), 0)""", "genes")
def iv08_classify(t: Tables) -> DataFrame:
    parts = intervals.classify([("feature", intervals_of(t)), ("gene", t.genes.select("genome", "chr", "start", "end"))], lengths(t), BOTH)
    return parts.groupBy("genome", "chr", "class").agg(F.sum(F.col("end") - F.col("start") + 1).cast("long").alias("bp"))


@query(f"""WITH {FEATURES}, u AS (SELECT genome, chr, fs AS s, fe AS e FROM f UNION ALL SELECT genome, chr, start, "end" FROM genes)
SELECT genome, chr, min(s) AS start, max(e) AS "end" FROM (SELECT *, sum(j) OVER (PARTITION BY genome, chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM (
  SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY genome, chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 >= 1 THEN 1 ELSE 0 END AS j FROM u)) GROUP BY genome, chr, i""", "genes")
def jn19_union(t: Tables) -> DataFrame:
    return intervals.merged(intervals_of(t).unionByName(t.genes.select("genome", "chr", "start", "end")), BOTH)


@query("WITH p AS (SELECT genome, id FROM genes WHERE CAST(substr(id, 2) AS BIGINT) % 50 <> 0) SELECT genome, count(*) AS nBed, count(p.id) AS nPep, count(p.id) AS nBoth, count(*) FILTER (g.id LIKE '%:%') AS nColon, count(p.id) >= 0.95 * count(*) AS ok, count(p.id) < 100 AS few FROM genes g LEFT JOIN p USING (genome, id) GROUP BY 1", "genes")
def qc01_agreement(t: Tables) -> DataFrame:
    return tables.agreement(t.genes, t.genes.where(F.substring("id", 2, 20).cast("long") % 50 != 0))


SEQS = "s AS (SELECT CAST(doc_id AS VARCHAR) AS chr, text AS seq FROM documents)"


def sequences(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").cast("string").alias("chr"), F.col("text").alias("seq"))


@query(f"WITH {SEQS} SELECT chr, p AS start, p + 3 AS \"end\", upper(substr(seq, p, 4)) AS kmer FROM (SELECT chr, seq, unnest(range(1, length(seq) + 1)) AS p FROM s) WHERE p + 3 <= length(seq) AND upper(substr(seq, p, 4)) IN ('TION', 'THER')")
def iv11_kmer_hits(t: Tables) -> DataFrame:
    return sequence.kmer_hits(sequences(t), ["TION", "THER"])


def iv10_kmer_ranges(t: Tables) -> DataFrame:
    return sequence.kmer_ranges(sequences(t), ["TION", "IONS", "THER"])


query(f"""WITH {SEQS}, k AS (SELECT chr, p AS s, p + 3 AS e FROM (SELECT chr, seq, unnest(range(1, length(seq) + 1)) AS p FROM s) WHERE p + 3 <= length(seq) AND upper(substr(seq, p, 4)) IN ('TION', 'IONS', 'THER'))
SELECT chr, min(s) AS start, max(e) AS "end" FROM (SELECT *, sum(j) OVER (PARTITION BY chr ORDER BY s) AS i FROM (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY chr ORDER BY s) - 1 >= 1 THEN 1 ELSE 0 END AS j FROM k)) GROUP BY chr, i""")(iv10_kmer_ranges)


@query(f"""WITH {SEQS}, k AS (SELECT chr, p AS s FROM (SELECT chr, seq, unnest(range(1, length(seq) + 1)) AS p FROM s) WHERE p <= length(seq) AND upper(substr(seq, p, 1)) = 'N')
SELECT chr, start, "end" FROM (SELECT chr, min(s) AS start, max(s) AS "end" FROM (SELECT *, sum(j) OVER (PARTITION BY chr ORDER BY s) AS i FROM (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY chr ORDER BY s) - 1 >= 2 THEN 1 ELSE 0 END AS j FROM k)) GROUP BY chr, i) WHERE "end" - start >= 2""")
def iv12_runs(t: Tables) -> DataFrame:
    return sequence.runs_of(sequences(t), "N", 3)


TELOMERES = """ls AS (SELECT chr, string_split(seq, '') AS l FROM s), k AS (SELECT chr, p AS s, p + 2 AS e FROM (SELECT chr, unnest(list_filter(range(1, len(l) - 1), lambda i: upper(l[i] || l[i + 1] || l[i + 2]) IN ('THE', 'EHA', 'AND', 'DNT'))) AS p FROM ls)),
k1 AS (SELECT chr, min(s) AS s, max(e) AS e FROM (SELECT *, sum(j) OVER (PARTITION BY chr ORDER BY s) AS i FROM (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY chr ORDER BY s) - 1 >= 1 THEN 1 ELSE 0 END AS j FROM k)) GROUP BY chr, i),
k2 AS (SELECT chr, min(s) AS s, max(e) AS e, sum(e - s + 1) AS bp FROM (SELECT *, sum(j) OVER (PARTITION BY chr ORDER BY s) AS i FROM (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY chr ORDER BY s) - 1 >= 11 THEN 1 ELSE 0 END AS j FROM k1)) GROUP BY chr, i),
te AS (SELECT chr, k2.s AS start, k2.e AS "end", CASE WHEN k2.s <= 200 THEN 'left' WHEN k2.e >= length(seq) - 200 THEN 'right' ELSE 'inter' END AS position FROM k2 JOIN s USING (chr) WHERE k2.e - k2.s + 1 >= 15 AND bp / (k2.e - k2.s + 1) >= 0.3)"""


@query(f"WITH {SEQS}, {TELOMERES} SELECT chr, start, \"end\", position FROM te")
def iv13_telomeres(t: Tables) -> DataFrame:
    return sequence.telomeres(sequences(t), ["THE", "AND"], 10, 15, 0.3, 200)


@query(f"""WITH {SEQS}, {TELOMERES}, n1 AS (SELECT chr, unnest(list_filter(range(1, len(l) + 1), lambda i: l[i] IN ('n', 'N'))) AS s FROM ls),
n2 AS (SELECT chr, min(s) AS s, max(s) AS e FROM (SELECT *, sum(j) OVER (PARTITION BY chr ORDER BY s) AS i FROM (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY chr ORDER BY s) - 1 >= 2 THEN 1 ELSE 0 END AS j FROM n1)) GROUP BY chr, i HAVING max(s) - min(s) >= 2),
c1 AS (SELECT chr, e + 1 AS s, lead(s) OVER (PARTITION BY chr ORDER BY s, e) - 1 AS e FROM (SELECT chr, s, e FROM n2 UNION ALL SELECT chr, 0, 0 FROM s UNION ALL SELECT chr, length(seq) + 1, length(seq) + 1 FROM s)),
c2 AS (SELECT chr, e - s + 1 AS n FROM c1 WHERE e >= s), c3 AS (SELECT chr, max(n) AS contigN50 FROM (SELECT chr, n, sum(n) OVER (PARTITION BY chr ORDER BY n DESC) AS c, sum(n) OVER (PARTITION BY chr) AS t FROM c2) WHERE c * 2 >= t GROUP BY chr)
SELECT chr, CAST(length(seq) AS BIGINT) AS length, coalesce((SELECT count(*) FROM c2 WHERE c2.chr = s.chr), 0) AS nContigs, (SELECT max(contigN50) FROM c3 WHERE c3.chr = s.chr) AS contigN50, coalesce((SELECT count(*) FROM n2 WHERE n2.chr = s.chr), 0) AS nGaps,
  coalesce((SELECT string_agg(position, ',' ORDER BY position) FROM te WHERE te.chr = s.chr), '') AS telomeres FROM s""")
def iv14_assembly_report(t: Tables) -> DataFrame:
    return sequence.assembly_report(sequences(t), ["THE", "AND"], 3, max_distance=10, least=15, density=0.3, end_distance=200)


@query(f"WITH {SEQS} SELECT chr, seq FROM s WHERE length(seq) >= 2000")
def iv15_long_enough(t: Tables) -> DataFrame:
    return sequence.long_enough(sequences(t), 2000)


@query(f"WITH {SEQS} SELECT concat(chr, ':', CAST(p AS VARCHAR), '_', CAST(p + 499 AS VARCHAR)) AS name, chr, p AS start, p + 499 AS \"end\", substr(seq, p, 500) AS seq FROM (SELECT chr, seq, unnest(range(1, length(seq) + 1, 250)) AS p FROM s) WHERE p + 499 <= length(seq)")
def iv16_tiles(t: Tables) -> DataFrame:
    return sequence.tiles(sequences(t), 500, 250)


# Genes


@query("SELECT ofID, row_number() OVER (PARTITION BY genome ORDER BY TRY_CAST(replace(chr, 'chr', '') AS DOUBLE), chr, n DESC, start, \"end\", ofID) AS ord FROM (SELECT *, count(*) OVER (PARTITION BY genome, chr) AS n FROM genes)", "genes")
def sy02_gene_order(t: Tables) -> DataFrame:
    return genes.gene_order(t.genes).select("ofID", "ord")


@query("SELECT ofID, CASE WHEN CAST(substr(ofID, 2) AS BIGINT) % 13 = 0 THEN 'NoOG' || lpad(CAST(sum(CASE WHEN CAST(substr(ofID, 2) AS BIGINT) % 13 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY genome ORDER BY ord) AS VARCHAR), 5, '0') || '_' || genome ELSE og END AS og FROM ranked", "ranked")
def sy03_fill_orthogroups(t: Tables) -> DataFrame:
    g = t.ranked.withColumn("og", F.when(F.substring("ofID", 2, 20).cast("long") % 13 != 0, F.col("og")))
    return genes.fill_orthogroups(g).select("ofID", "og")


PLACED = "SELECT *, CASE WHEN ord - lag(ord) OVER (PARTITION BY genome, og ORDER BY ord) > 50 OR lag(ord) OVER (PARTITION BY genome, og ORDER BY ord) IS NULL THEN 1 ELSE 0 END AS far FROM ranked"


@query(f"SELECT ofID, CAST(sum(far) OVER (PARTITION BY genome, og) AS BIGINT) AS nOGPlaces FROM ({PLACED})", "ranked")
def sy04_placements(t: Tables) -> DataFrame:
    return genes.placements(t.ranked, 50).select("ofID", "nOGPlaces")


@query("SELECT ofID, n < 10 AS smallChr FROM genes JOIN (SELECT genome, chr, count(DISTINCT og) AS n FROM genes GROUP BY 1, 2) USING (genome, chr)", "genes")
def sy05_small_chromosomes(t: Tables) -> DataFrame:
    return genes.small_chromosomes(t.ranked, 5).select("ofID", "smallChr")


@query(f"SELECT ofID, sum(far) OVER (PARTITION BY genome, og) > 1 AS dispOG FROM ({PLACED})", "ranked")
def sy06_dispersed(t: Tables) -> DataFrame:
    return genes.dispersed(t.ranked, 50, 1).select("ofID", "dispOG")


@query("SELECT ofID, concat_ws('_', genome, chr, og, CAST(sum(j) OVER (PARTITION BY genome, chr, og ORDER BY ord) + 1 AS VARCHAR)) AS arrayID FROM (SELECT *, CASE WHEN ord - lag(ord) OVER (PARTITION BY genome, chr, og ORDER BY ord) > 100 THEN 1 ELSE 0 END AS j FROM ranked)", "ranked")
def sy07_array_round(t: Tables) -> DataFrame:
    return genes.array_round(t.ranked, 100).select("ofID", "arrayID")


@query()
def sy07_tandem_arrays(t: Tables) -> DataFrame:
    return genes.tandem_arrays(t.ranked, 100).select("ofID", "arrayID")


@query("WITH a AS (SELECT *, genome || chr || og AS arrayID FROM ranked), m AS (SELECT arrayID, median(ord) AS m FROM a GROUP BY 1) SELECT ofID, row_number() OVER (PARTITION BY arrayID ORDER BY abs(ord - m), pepLen DESC, ord, ofID) = 1 AS isArrayRep FROM a JOIN m USING (arrayID)", "ranked")
def sy08_array_representatives(t: Tables) -> DataFrame:
    return genes.array_representatives(t.ranked.withColumn("arrayID", F.concat("genome", "chr", "og"))).select("ofID", "isArrayRep")


def annotated(t: Tables) -> DataFrame:
    return scratch.materialize(genes.annotate(t.genes), "genes")


@query()
def sy01_gene_table(t: Tables) -> DataFrame:
    return genes.annotate(t.genes).select("ofID", "genome", "ord", "og", "arrayID", "isArrayRep", "noAnchor")


@query(f"SELECT genome, count(*) AS nGenes, count(*) FILTER (small) AS nSmallChr, count(*) FILTER (disp) AS nDispOG, avg(CASE WHEN small THEN 1.0 ELSE 0.0 END) > 0.05 AS manySmall, avg(CASE WHEN disp THEN 1.0 ELSE 0.0 END) > 0.05 AS manyDispersed FROM (SELECT genome, sum(far) OVER (PARTITION BY genome, og) > 1 AS disp, n < 10 AS small FROM ({PLACED}) JOIN (SELECT genome, chr, count(DISTINCT og) AS n FROM genes GROUP BY 1, 2) USING (genome, chr)) GROUP BY 1", "ranked")
def sy09_flag_shares(t: Tables) -> DataFrame:
    return genes.flag_shares(genes.small_chromosomes(genes.dispersed(t.ranked, 50, 1), 5))


# Synteny


def all_hits(t: Tables) -> DataFrame:
    """All hits, without the columns that no search reads."""
    with scratch.shuffles_removed(t.spark):
        h = hits.annotate(t.hits.select("ofID1", "ofID2", "bitScore"), None, annotated(t))
        return scratch.materialize(h.drop("id1", "id2", "start1", "start2", "end1", "end2"), "hits")


@query()
def sy10_hit_table(t: Tables) -> DataFrame:
    return hits.annotate(t.hits.select("ofID1", "ofID2", "bitScore"), None, annotated(t)).select("ofID1", "ofID2", "genome1", "genome2", "ord1", "ord2", "sameOG", "noAnchor")


SELF = "h AS (SELECT a.genome AS g, a.chr AS chr1, b.chr AS chr2, a.ofID AS ofID1, b.ofID AS ofID2, a.ord AS ord1, b.ord AS ord2 FROM ranked a JOIN ranked b ON a.genome = b.genome AND a.og = b.og)"


@query(f"WITH {SELF}, s AS (SELECT g, chr1, max(ord1) - min(ord1) AS span FROM h GROUP BY 1, 2), n AS (SELECT h.ofID1, h.ofID2, bool_or((a.ord1 - h.ord1) * (a.ord1 - h.ord1) + (a.ord2 - h.ord2) * (a.ord2 - h.ord2) <= 2500) AS near FROM h LEFT JOIN (SELECT * FROM h WHERE ofID1 = ofID2) a ON a.g = h.g AND a.chr1 = h.chr1 AND a.chr2 = h.chr2 GROUP BY 1, 2) SELECT ofID1, ofID2, ofID1 = ofID2 AS isAnchor, chr1 = chr2 AND (coalesce(near, false) OR span <= 50) AS isSyntenic FROM h JOIN n USING (ofID1, ofID2) JOIN s USING (g, chr1)", "ranked")
def sy13_self(t: Tables) -> DataFrame:
    r = t.ranked
    a = r.select("og", "genome", F.col("genome").alias("genome1"), F.col("chr").alias("chr1"), F.col("ofID").alias("ofID1"), F.col("ord").alias("ord1"))
    b = r.select("og", "genome", F.col("genome").alias("genome2"), F.col("chr").alias("chr2"), F.col("ofID").alias("ofID2"), F.col("ord").alias("ord2"))
    return synteny.self_flags(a.join(b, ["og", "genome"]).drop("genome"), 50.0).select("ofID1", "ofID2", "isAnchor", "isSyntenic")


@query()
def sy14_synteny(t: Tables) -> DataFrame:
    return synteny.synteny(all_hits(t)).select("ofID1", "ofID2", "isAnchor", "isSyntenic", "blkID", "regID")


@query()
def sy15_secondary(t: Tables) -> DataFrame:
    second = synteny.Settings(only_og=False, n_gaps=10, top1=1, top2=1)
    return synteny.synteny(all_hits(t), secondary=second).select("ofID1", "ofID2", "isAnchor", "isSyntenic", "blkID", "regID")


@query()
def sy16_chains(t: Tables) -> DataFrame:
    h = t.hits.select("genome1", "genome2", "chr1", "chr2", "ofID1", "ofID2", "ord1", "ord2")
    return synteny.chains_of(h, 5, 5)


@query()
def sy17_dbscan(t: Tables) -> DataFrame:
    h = t.hits.withColumn("k", F.substring("ofID1", 2, 20).cast("long") * 10_000_000 + F.substring("ofID2", 2, 20).cast("long"))
    return spatial.dbscan(h, ["genome1", "genome2", "chr1", "chr2"], "ord1", "ord2", 25, 5, "k").select("ofID1", "ofID2", "cluster")


@query()
def sy18_components(t: Tables) -> DataFrame:
    n = lambda c: F.substring(c, 2, 20).cast("long")
    return graph.connected_components(t.hits.select(n("ofID1").alias("a"), n("ofID2").alias("b")), "a", "b")


def found(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The gene table, and the syntenic hits between genomes; those that may not be anchors are in no block, and none of them are written."""
    with scratch.shuffles_removed(t.spark):
        g = annotated(t)
        h = hits.annotate(t.hits.select("ofID1", "ofID2", "bitScore"), None, g).where("not noAnchor and isArrayRep1 and isArrayRep2")
        h, path = scratch.written(h, "hits")
        h = scratch.materialize(synteny.synteny(h).where("isSyntenic"), "syntenic")
    scratch.delete(t.spark, path)
    return g, h


@query()
def sy19_syntenic_orthogroups(t: Tables) -> DataFrame:
    return orthogroups.syntenic_orthogroups(*found(t)).select("ofID", "genome", "og")


@query("""WITH RECURSIVE h AS (SELECT DISTINCT ofID1 AS a, ofID2 AS b FROM blocks WHERE CAST(substr(ofID1, 2) AS BIGINT) % 3 <> 0 AND CAST(substr(ofID1, 2) AS BIGINT) % 11 <> 0), e AS (SELECT a, b FROM h UNION SELECT b, a FROM h),
z AS (SELECT ofID AS x, ofID AS y FROM ranked UNION SELECT z.x, e.b FROM z JOIN e ON e.a = z.y),
m AS (SELECT x AS ofID, arg_min(y, (r.genome, r.ord, y)) AS name FROM z JOIN ranked r ON r.ofID = y GROUP BY x),
a AS (SELECT genome, chr, og, min(name) AS rep FROM ranked JOIN m USING (ofID) WHERE CAST(substr(ofID, 2) AS BIGINT) % 4 <> 0 GROUP BY 1, 2, 3)
SELECT ofID, r.genome, concat('synOG_', coalesce(rep, name)) AS og FROM ranked r JOIN m USING (ofID) LEFT JOIN a ON a.genome = r.genome AND a.chr = r.chr AND a.og = r.og""", "blocks")
def sy19_groups_of_blocks(t: Tables) -> DataFrame:
    """Syntenic orthogroups of given blocks; arrays are the genes of a group on a chromosome."""
    n = F.substring("ofID1", 2, 20).cast("long")
    h = t.blocks.withColumns({"isSyntenic": F.lit(True), "sameOG": n % 3 != 0, "noAnchor": n % 11 == 0})
    return orthogroups.syntenic_orthogroups(with_reps(t), h).select("ofID", "genome", "og")


@query()
def sy20_region_orthologues(t: Tables) -> DataFrame:
    """Of found regions, those with 10 genes or more on either side; ``sy20_region_groups`` has the same on given regions in SQL."""
    g = annotated(t)
    h = hits.annotate(t.hits.select("ofID1", "ofID2", "bitScore"), None, g).drop("id1", "id2", "start1", "start2", "end1", "end2")
    h = synteny.synteny(scratch.materialize(h, "hits"))
    return orthogroups.region_orthologues(h, g, least_genes=10).select("ofID1", "ofID2", "sameOG")


@query("""SELECT *, CASE WHEN orient = '-' THEN maxBp2 ELSE minBp2 END AS startBp2, CASE WHEN orient = '-' THEN minBp2 ELSE maxBp2 END AS endBp2, CASE WHEN orient = '-' THEN maxOrd2 ELSE minOrd2 END AS startOrd2, CASE WHEN orient = '-' THEN minOrd2 ELSE maxOrd2 END AS endOrd2,
CASE WHEN orient = '-' THEN maxGene2 ELSE minGene2 END AS firstGene2, CASE WHEN orient = '-' THEN minGene2 ELSE maxGene2 END AS lastGene2 FROM (
SELECT blkID, genome1, genome2, chr1, chr2, min(start1) AS startBp1, max(end1) AS endBp1, min(ord1) AS startOrd1, max(ord1) AS endOrd1, arg_min(ofID1, (ord1, ofID1)) AS firstGene1, arg_max(ofID1, (ord1, ofID1)) AS lastGene1, count(DISTINCT ofID1) AS nHits1,
min(start2) AS minBp2, max(end2) AS maxBp2, min(ord2) AS minOrd2, max(ord2) AS maxOrd2, arg_min(ofID2, (ord2, ofID2)) AS minGene2, arg_max(ofID2, (ord2, ofID2)) AS maxGene2, count(DISTINCT ofID2) AS nHits2,
CASE WHEN corr(CAST(ord1 AS DOUBLE), CAST(ord2 AS DOUBLE)) < 0 THEN '-' ELSE '+' END AS orient FROM blocks GROUP BY ALL)""", "blocks")
def sy22_block_coordinates(t: Tables) -> DataFrame:
    return blocks.coordinates(t.blocks)


@query("SELECT blkID, genome1, genome2, count(DISTINCT ofID1) AS nHits1 FROM blocks GROUP BY ALL HAVING count(*) >= 5", "blocks")
def sy23_blocks(t: Tables) -> DataFrame:
    return blocks.unphased(t.blocks.withColumn("isAnchor", F.lit(True)), 5).select("blkID", "genome1", "genome2", "nHits1")


@query()
def sy24_phased_blocks(t: Tables) -> DataFrame:
    return blocks.phased(found(t)[1], "G0", 5, 100)


def phasable(t: Tables) -> DataFrame:
    """Blocks of the hits, and chromosome pairs as regions."""
    return t.blocks.withColumns({"isAnchor": F.lit(True), "regID": F.concat_ws("_", "genome1", "genome2", "chr1", "chr2")})


PHASED = """WITH h AS (SELECT *, concat(genome1, '_', genome2, '_', chr1, '_', chr2) AS regID FROM blocks), v AS (SELECT ofID1, ofID2, chr1 AS refChr, start1 AS s, end1 AS e FROM h WHERE genome1 = 'G0'),
t AS (SELECT DISTINCT ofID1 AS g, refChr FROM v WHERE @limit UNION SELECT DISTINCT ofID2, refChr FROM v WHERE @limit),
a AS (SELECT h.*, p.refChr FROM h JOIN t p ON p.g = ofID1 JOIN t q ON q.g = ofID2 AND q.refChr = p.refChr)
SELECT genome1, genome2, chr1, chr2, refChr, 'G0' AS refGenome, concat(@block, '_1') AS blkID, count(DISTINCT ofID1) AS nHits1, count(DISTINCT ofID2) AS nHits2, min(ord1) AS startOrd1, max(ord1) AS endOrd1, min(ord2) AS minOrd2, max(ord2) AS maxOrd2
FROM a GROUP BY genome1, genome2, chr1, chr2, refChr, @block HAVING count(*) >= 5"""


def phases(t: Tables, **how) -> DataFrame:
    # the radius is that of a whole chromosome, so that a block and reference chromosome are one cluster, as in the SQL
    out = blocks.phased(phasable(t), "G0", 5, 1e6, **how)
    return out.select("genome1", "genome2", "chr1", "chr2", "refChr", "refGenome", "blkID", "nHits1", "nHits2", "startOrd1", "endOrd1", "minOrd2", "maxOrd2").where("genome1 < genome2")


@query(PHASED.replace("@limit", "true").replace("@block", "blkID"), "blocks")
def sy24_phases_of_blocks(t: Tables) -> DataFrame:
    return phases(t)


@query(PHASED.replace("@limit", "refChr = 'chr3' AND e >= 50000 AND s <= 300000").replace("@block", "regID"), "blocks")
def sy24_phases_in_a_region(t: Tables) -> DataFrame:
    """Regions in place of blocks, and only what descends from a part of one chromosome."""
    return phases(t, use_regions=True, region=("chr3", 50_000, 300_000))


@query()
def sy25_positions(t: Tables) -> DataFrame:
    g, h = found(t)
    return blocks.interpolated_positions(h, g)


REPS = "r AS (SELECT *, CAST(substr(ofID, 2) AS BIGINT) % 4 <> 0 AS rep FROM ranked)"


def with_reps(t: Tables) -> DataFrame:
    """Ranked genes; each fourth is no representative of its array."""
    return t.ranked.withColumns({"isArrayRep": F.substring("ofID", 2, 20).cast("long") % 4 != 0, "noAnchor": F.lit(False), "arrayID": F.concat("genome", "chr", "og")})


POSITIONS = f"""WITH {REPS}, b AS (SELECT blkID, genome1 AS g1, chr1 AS c1, genome2 AS g2, chr2 AS c2, ofID1 AS a, ofID2 AS b, ord1 AS x, CAST(ord2 AS DOUBLE) AS y FROM blocks UNION ALL SELECT blkID, genome2, chr2, genome1, chr1, ofID2, ofID1, ord2, CAST(ord1 AS DOUBLE) FROM blocks),
n AS (SELECT blkID, g1, c1, g2, c2, min(x) AS lo, max(x) AS hi FROM b GROUP BY ALL),
m AS (SELECT n.blkID, g1, c1, g2, c2, r.ofID AS a, CAST(NULL AS VARCHAR) AS b, r.ord AS x, CAST(NULL AS DOUBLE) AS y FROM n JOIN r ON r.genome = g1 AND r.chr = c1 AND r.rep AND r.ord BETWEEN lo AND hi WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.blkID = n.blkID AND b.g1 = n.g1 AND b.g2 = n.g2 AND b.a = r.ofID)),
u AS (SELECT * FROM b UNION ALL SELECT * FROM m), d AS (SELECT blkID, g1, g2, x, avg(y) AS y FROM u GROUP BY ALL),
e AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER p AS x0, last_value(y IGNORE NULLS) OVER p AS y0, first_value(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER q AS x1, first_value(y IGNORE NULLS) OVER q AS y1 FROM d
WINDOW p AS (PARTITION BY blkID, g1, g2 ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY blkID, g1, g2 ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT blkID, g1, g2, x, coalesce(y, y0 + (y1 - y0) / (x1 - x0) * (x - x0)) AS pos FROM e)
SELECT @ FROM (SELECT blkID, c2 AS chr2, g1 AS genome1, g2 AS genome2, a AS ofID1, b AS ofID2, x AS ord1, round(pos, 6) AS pos, row_number() OVER (PARTITION BY blkID, g1, g2, a, round(pos, 6) ORDER BY b NULLS LAST) AS k FROM u JOIN f USING (blkID, g1, g2, x)) WHERE k = 1"""


@query(POSITIONS.replace("@", "blkID, genome1, genome2, ofID1, ofID2, ord1, pos AS ord2"), "blocks")
def sy25_block_positions(t: Tables) -> DataFrame:
    out = blocks.interpolated_positions(t.blocks.withColumn("isAnchor", F.lit(True)), with_reps(t))
    return out.select("blkID", "genome1", "genome2", "ofID1", "ofID2", "ord1", F.round("ord2", 6).alias("ord2"))


@query(f"""WITH {REPS}, n AS (SELECT genome || chr || og AS arr, count(*) AS nInArray FROM r GROUP BY 1), s AS (SELECT r.*, nInArray FROM r JOIN n ON n.arr = r.genome || r.chr || r.og WHERE rep),
p AS (SELECT DISTINCT ofID, genome, og, nInArray, c, o FROM (SELECT ofID, genome, og, nInArray, chr AS c, CAST(ord AS DOUBLE) AS o FROM s WHERE genome = 'G0' UNION ALL SELECT s.ofID, s.genome, s.og, nInArray, h.chr1, h.ord1 + 0.5::DOUBLE FROM s JOIN hits h ON h.ofID2 = s.ofID WHERE h.genome1 = 'G0' AND s.genome <> 'G0')),
g AS (SELECT *, coalesce(o - lag(o) OVER (PARTITION BY og, c ORDER BY o, ofID), 0) AS gap FROM p), m AS (SELECT *, max(gap) OVER (PARTITION BY og, c) > 200 AS split FROM g),
k AS (SELECT *, sum(CASE WHEN split AND gap > sqrt(2.0::DOUBLE) * 100 THEN 1 ELSE 0 END) OVER (PARTITION BY og, c ORDER BY o, ofID) AS place FROM m),
t AS (SELECT og, count(DISTINCT ofID) AS n_split FROM k WHERE split GROUP BY 1),
q AS (SELECT og, c, place, split, count(DISTINCT ofID) AS n, arg_min(o, (CASE WHEN genome = 'G0' THEN 0 ELSE 1 END, genome, -nInArray, ofID, o)) AS spot FROM k GROUP BY ALL),
u AS (SELECT q.* FROM q LEFT JOIN t USING (og) WHERE NOT split OR n >= 0.75::DOUBLE * n_split),
v AS (SELECT *, count(*) OVER w AS places, min(n) OVER w AS low FROM u WINDOW w AS (PARTITION BY og, c)), x AS (SELECT *, sum(CASE WHEN n = low THEN 1 ELSE 0 END) OVER (PARTITION BY og, c) = 1 AS alone FROM v),
y AS (SELECT * FROM x WHERE NOT (split AND places > 2 AND n = low AND alone)),
z AS (SELECT k.og, count(DISTINCT ofID) AS total FROM k JOIN y ON y.og = k.og AND y.c = k.c AND y.place = k.place GROUP BY 1)
SELECT og, c AS interpChr, spot AS interpOrd FROM (SELECT y.*, total, max(n) OVER (PARTITION BY y.og) AS top FROM y JOIN z USING (og)) WHERE n >= 0.75::DOUBLE * total OR n = top""", "hits")
def sy26_places(t: Tables) -> DataFrame:
    at = t.hits.where("genome1 = 'G0'").select(F.col("ofID2").alias("ofID1"), F.lit("G0").alias("genome2"), F.col("chr1").alias("chr2"), (F.col("ord1") + F.lit(0.5)).cast("double").alias("ord2"))
    return pangenes.placed(with_reps(t), at, "G0", 100)


@query(f"""WITH p AS ({POSITIONS.replace("@", "*")}), n AS (SELECT genome1, genome2, ofID1, count(DISTINCT (chr2, pos)) AS n FROM p GROUP BY 1, 2, 3),
c AS (SELECT q.genome1, q.genome2, coalesce(n, 0) AS n FROM ranked r JOIN (SELECT DISTINCT genome1, genome2 FROM p) q ON q.genome1 = r.genome LEFT JOIN n ON n.genome1 = q.genome1 AND n.genome2 = q.genome2 AND n.ofID1 = r.ofID)
SELECT genome1, genome2, count(*) FILTER (n = 0) AS n0, count(*) FILTER (n = 1) AS n1, count(*) FILTER (n = 2) AS n2, count(*) FILTER (n > 2) AS nMore FROM c GROUP BY 1, 2""", "blocks")
def sy25_census_of_blocks(t: Tables) -> DataFrame:
    """Genes with none, one, two or more positions on another genome, from given blocks."""
    at = blocks.interpolated_positions(t.blocks.withColumn("isAnchor", F.lit(True)), with_reps(t)).withColumn("ord2", F.round("ord2", 6))
    return blocks.position_census(at, t.ranked)


@query()
def sy25_census(t: Tables) -> DataFrame:
    g, h = found(t)
    return blocks.position_census(blocks.interpolated_positions(h, g), g)


def pan(t: Tables) -> tuple[DataFrame, DataFrame]:
    g, h = found(t)
    g = scratch.materialize(orthogroups.syntenic_orthogroups(g, h), "genes")
    at = scratch.materialize(blocks.interpolated_positions(h, g), "positions")
    return g, scratch.materialize(pangenes.pangenes(g, at, "G0"), "pangenes")


@query()
def sy26_pangenes(t: Tables) -> DataFrame:
    return pan(t)[1]


@query()
def sy27_pairs(t: Tables) -> DataFrame:
    g, h = found(t)
    return hits.array_pairs(h.where("isSyntenic"), g)


@query()
def sy28_run(t: Tables) -> DataFrame:
    """The whole analysis, end to end; its blocks."""
    from synblock.plans.params import Params
    from synblock.plans.run import run

    return run(Params(("G0", "G1", "G2")), t.genes, t.hits.select("ofID1", "ofID2", "bitScore")).blocks


def paf(t: Tables, back: bool = False) -> DataFrame:
    """Window alignments made of the hits, a window a gene; ``back`` has those of the second genome's windows on the first, with scores of their own and without every seventh gene."""
    n = lambda c: F.substring(c, 2, 20).cast("long")
    a, b = ("2", "1") if back else ("1", "2")
    rows = t.hits.where(n("ofID2") % 7 != 0) if back else t.hits.where(n("ofID1") % 5 != 0)
    return rows.select(
        F.col(f"genome{a}").alias("genome1"), F.col(f"genome{b}").alias("genome2"), F.concat(f"chr{a}", F.lit(":"), F.col(f"start{a}").cast("string"), F.lit("_"), (F.col(f"start{a}") + 999).cast("string")).alias("windowName"), F.lit(1000).cast("long").alias("windowLength"),
        F.col(f"chr{b}").alias("refChr"), F.col(f"start{b}").alias("refStart"), (F.col(f"start{b}") + 999).alias("refEnd"), (500 + n(f"ofID{a}") % 400).alias("nmatches"), (950 + n(f"ofID{b}") % 50).alias("blkLen"), (n(f"ofID{a}") % 61).alias("mapq"),
    )


def _cut_paf(a: int, b: int, every: int) -> str:
    n = lambda i: f"CAST(substr(ofID{i}, 2) AS BIGINT)"
    p = f"SELECT genome{a} AS g1, genome{b} AS g2, chr{a} AS c1, start{a} AS s1, chr{b} AS c2, start{b} AS s2, 500 + {n(a)} % 400 AS nm, 950 + {n(b)} % 50 AS bl, {n(a)} % 61 AS mq FROM hits WHERE {n(a)} % {every} <> 0"
    q = "SELECT g1, g2, quantile_cont(bl / 1000.0::DOUBLE, 0.25) AS a, quantile_cont(nm / CAST(bl AS DOUBLE), 0.25) AS b, quantile_cont(mq, 0.25) AS c FROM p GROUP BY 1, 2"
    return f"""(WITH p AS ({p}), q AS ({q}) SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY g1, g2, c1, s1 ORDER BY mq DESC, nm DESC, bl DESC, c2, s2) AS r
  FROM p JOIN q USING (g1, g2) WHERE bl / 1000.0::DOUBLE >= a AND nm / CAST(bl AS DOUBLE) >= b AND mq >= c) WHERE r = 1)"""


@query(f"""WITH f AS {_cut_paf(1, 2, 5)}, r AS {_cut_paf(2, 1, 7)},
u AS (SELECT g1, c1, s1, g2, c2, s2, nm, mq FROM f UNION ALL SELECT g2, c2, s2, g1, c1, s1, nm, mq FROM r)
SELECT g1 AS genome1, g2 AS genome2, c1 AS chr1, s1 AS start1, c2 AS chr2, s2 AS start2, nm AS nmatches, mq AS mapq FROM (
  SELECT *, row_number() OVER (PARTITION BY g1, g2, c1, s1, c2, s2 ORDER BY mq DESC, nm DESC) AS k FROM u) WHERE k = 1""", "hits")
def sy33_combined_alignments(t: Tables) -> DataFrame:
    return windows.combine(paf(t), paf(t, back=True)).select("genome1", "genome2", "chr1", "start1", "chr2", "start2", "nmatches", "mapq")


@query()
def sy31_window_blocks(t: Tables) -> DataFrame:
    return windows.block_coordinates(windows.anchors(windows.combine(paf(t), paf(t, back=True)), 1000, 10, 5, 250_000))


# Questions


@query("WITH q AS (SELECT 'G0' AS genome, 'chr0' AS chr, 100000 AS s, 300000 AS e), h AS (SELECT genome1, chr1, start1, end1, ofID1, ofID2 FROM blocks UNION ALL SELECT genome2, chr2, start2, end2, ofID2, ofID1 FROM blocks) SELECT ofID1, ofID2 FROM h JOIN q ON genome1 = genome AND chr1 = chr AND start1 <= e AND s <= end1", "blocks")
def qy01_region_hits(t: Tables) -> DataFrame:
    bed = t.spark.createDataFrame([("G0", "chr0", 100000, 300000)], "genome string, chr string, start long, end long")
    return Q.region_hits(t.blocks.withColumn("isSyntenic", F.lit(True)), bed, t.ranked).select("ofID1", "ofID2")


@query()
def qy02_pangenes_wide(t: Tables) -> DataFrame:
    g, p = pan(t)
    bed = t.spark.createDataFrame([("G0", "chr0", 100000, 300000)], "genome string, chr string, start long, end long")
    out = Q.region_pangenes(p, bed, g, ["G0", "G1", "G2"])
    return out.select("region", "pgID", "interpChr", "pgRepID", *(F.array_join(F.coalesce(c, F.array()), ",").alias(c) for c in ("G0", "G1", "G2")))


@query("""WITH p AS (SELECT *, CAST(substr(ofID, 2) AS BIGINT) AS k FROM ranked), q AS (SELECT genome, concat(id, CASE k % 5 WHEN 0 THEN '+' WHEN 1 THEN '*' ELSE '' END) AS name, k // 6 + 1 AS pgID FROM p WHERE (k // 6 + 1) % 9 <> 0),
w AS (SELECT pgID, coalesce(string_agg(name, ',' ORDER BY name) FILTER (genome = 'G0'), '') AS G0, coalesce(string_agg(name, ',' ORDER BY name) FILTER (genome = 'G1'), '') AS G1, coalesce(string_agg(name, ',' ORDER BY name) FILTER (genome = 'G2'), '') AS G2 FROM q GROUP BY 1)
SELECT w.*, concat('chr', pgID % 7) AS interpChr, r.id AS repGene, r.genome AS repGenome, r.chr AS repChr, r.start AS repStart, r."end" AS repEnd FROM w LEFT JOIN ranked r ON r.ofID = concat('g', (pgID - 1) * 6)""", "ranked")
def qy02_reference_pangenes(t: Tables) -> DataFrame:
    """Given pan-genes of six genes each, those without a place left out, by genome and with their representative."""
    k = F.substring("ofID", 2, 20).cast("long")
    number = F.expr("cast(substr(ofID, 2) as bigint) div 6") + 1
    p = t.ranked.withColumn("pgID", number).withColumns({
        "interpChr": F.when(F.col("pgID") % 9 != 0, F.concat(F.lit("chr"), (F.col("pgID") % 7).cast("string"))), "interpOrd": F.col("pgID").cast("double"),
        "pgRepID": F.concat(F.lit("g"), ((F.col("pgID") - 1) * 6).cast("string")), "flag": F.when(k % 5 == 0, "array").when(k % 5 == 1, "NSOrtho").otherwise("PASS"),
    })
    out = Q.reference_pangenes(p, t.ranked, ["G0", "G1", "G2"])
    return out.select("pgID", "interpChr", "repGene", "repGenome", "repChr", "repStart", "repEnd", *(F.array_join(F.coalesce(c, F.array()), ",").alias(c) for c in ("G0", "G1", "G2")))


CNV = """WITH c AS (SELECT genome, og, count(*) AS n FROM genes GROUP BY 1, 2), f AS (SELECT g.genome, o.og, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT genome FROM genes) g CROSS JOIN (SELECT DISTINCT og FROM genes) o LEFT JOIN c ON c.genome = g.genome AND c.og = o.og),
k AS (SELECT genome, 'globalOGs' AS ogType, n AS copyNumber, CAST(sum(n) AS BIGINT) AS nGenes, count(*) AS nOgs FROM f GROUP BY genome, n)
SELECT *, round(100.0::DOUBLE * nGenes / CAST(sum(nGenes) OVER (PARTITION BY genome) AS DOUBLE), 6) AS percGenes, round(100.0::DOUBLE * nOgs / CAST(sum(nOgs) OVER (PARTITION BY genome) AS DOUBLE), 6) AS percOGs FROM k"""


@query(CNV, "genes")
def qy03_copy_numbers(t: Tables) -> DataFrame:
    out = Q.copy_numbers(t.genes, {"globalOGs": "og"})
    return out.withColumns({"percGenes": F.round("percGenes", 6), "percOGs": F.round("percOGs", 6)})


REGION_CNV = """WITH t AS (SELECT *, 'globalOGs' AS ogType, og AS grp FROM genes UNION ALL SELECT *, 'globalHOGs', og || '_' || CAST(CAST(substr(ofID, 2) AS BIGINT) % 2 AS VARCHAR) FROM genes UNION ALL SELECT *, 'syntenicHOGs', og || chr FROM genes),
l AS (SELECT * FROM t WHERE CAST(substr(ofID, 2) AS BIGINT) % 9 <> 0),
b AS (SELECT 'G0' AS genome, 'chr0' AS chr, 100000 AS s, 300000 AS e UNION ALL SELECT 'G2', 'chr0', 0, 4611686018427387903),
r AS (SELECT *, concat(genome, ', ', chr, ': ', s, '-', e) AS region FROM b),
f AS (SELECT DISTINCT region, ogType, grp FROM l JOIN r ON l.genome = r.genome AND l.chr = r.chr AND l."end" >= s AND l.start <= e),
c AS (SELECT region, l.ogType, l.grp, genome, count(*) AS n FROM l JOIN f ON f.ogType = l.ogType AND f.grp = l.grp GROUP BY ALL),
x AS (SELECT p.region, p.ogType, p.grp, g.genome FROM (SELECT DISTINCT region, ogType, grp FROM c) p JOIN (SELECT DISTINCT region, ogType, genome FROM c) g ON p.region = g.region AND p.ogType = g.ogType),
k AS (SELECT x.region, x.genome, x.ogType, CAST(least(coalesce(n, 0), 3) AS BIGINT) AS copyNumber, count(*) AS nOgs FROM x LEFT JOIN c ON c.region = x.region AND c.ogType = x.ogType AND c.grp = x.grp AND c.genome = x.genome GROUP BY ALL)
SELECT *, copyNumber * nOgs AS nGenes, round(100.0::DOUBLE * (copyNumber * nOgs) / CAST(sum(copyNumber * nOgs) OVER (PARTITION BY region, genome, ogType) AS DOUBLE), 6) AS percGenes, round(100.0::DOUBLE * nOgs / CAST(sum(nOgs) OVER (PARTITION BY region, genome, ogType) AS DOUBLE), 6) AS percOGs FROM k"""


@query(REGION_CNV, "genes")
def qy03_copy_numbers_of_regions(t: Tables) -> DataFrame:
    """Three kinds of groups, array representatives only, numbers above three as three, for two regions."""
    n = F.substring("ofID", 2, 20).cast("long")
    g = t.genes.withColumns({"isArrayRep": n % 9 != 0, "hog": F.concat("og", F.lit("_"), (n % 2).cast("string")), "syn": F.concat("og", "chr")})
    bed = t.spark.createDataFrame([("G0", "chr0", 100000, 300000), ("G2", "chr0", None, None)], "genome string, chr string, start long, end long")
    out = Q.copy_numbers(g, {"globalOGs": "og", "globalHOGs": "hog", "syntenicHOGs": "syn"}, True, 3, bed)
    return out.withColumns({"percGenes": F.round("percGenes", 6), "percOGs": F.round("percOGs", 6)})


# Lay-out


@query("""WITH c AS (SELECT genome1, genome2, chr1, chr2, CAST(round_even(ord1 / 100.0::DOUBLE, 0) * 100 AS BIGINT) AS bin1, CAST(round_even(ord2 / 100.0::DOUBLE, 0) * 100 AS BIGINT) AS bin2, count(*) AS n FROM hits GROUP BY ALL),
q AS (SELECT genome1, genome2, least(greatest(quantile_cont(n, 0.95), 5), 20) AS cap FROM c GROUP BY 1, 2) SELECT c.*, least(CAST(n AS DOUBLE), cap) AS shown FROM c JOIN q USING (genome1, genome2)""", "hits")
def vz01_dotplot_bins(t: Tables) -> DataFrame:
    return layout.dotplot_bins(t.hits)


@query("WITH c AS (SELECT genome, chr, max(ord) - min(ord) + 1 AS length, min(ord) AS lo FROM ranked GROUP BY 1, 2), w AS (SELECT *, sum(length) OVER (PARTITION BY genome) AS total, count(*) OVER (PARTITION BY genome) AS n, coalesce(sum(length) OVER (PARTITION BY genome ORDER BY lo, chr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY genome ORDER BY lo, chr) - 1 AS place FROM c) SELECT genome, chr, length, round(before + place * total * 0.01::DOUBLE - (total + (n - 1) * total * 0.01::DOUBLE) / 2, 4) AS offset_ FROM w", "ranked")
def vz04_chromosome_layout(t: Tables) -> DataFrame:
    return layout.chromosome_layout(t.ranked).select("genome", "chr", "length", F.round("offset", 4).alias("offset_"))


SIDE_BY_SIDE = """c AS (SELECT genome, chr, max(ord) - min(ord) + 1 AS length, min(ord) AS lo FROM ranked GROUP BY 1, 2),
w AS (SELECT *, sum(length) OVER (PARTITION BY genome) AS total, count(*) OVER (PARTITION BY genome) AS n, coalesce(sum(length) OVER (PARTITION BY genome ORDER BY lo, chr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY genome ORDER BY lo, chr) - 1 AS place FROM c),
lay AS (SELECT genome, chr, length, before + place * total * 0.01::DOUBLE - (total + (n - 1) * total * 0.01::DOUBLE) / 2 AS x, CAST(substr(genome, 2) AS DOUBLE) AS y FROM w)"""


@query(f"""WITH {SIDE_BY_SIDE}, b AS (SELECT blkID, genome1, genome2, chr1, chr2, min(ord1) AS s1, max(ord1) AS e1, CASE WHEN m THEN max(ord2) ELSE min(ord2) END AS s2, CASE WHEN m THEN min(ord2) ELSE max(ord2) END AS e2 FROM (
  SELECT *, corr(CAST(ord1 AS DOUBLE), CAST(ord2 AS DOUBLE)) OVER (PARTITION BY blkID) < 0 AS m FROM blocks) WHERE (genome1 = 'G0' AND genome2 = 'G1') OR (genome1 = 'G1' AND genome2 = 'G2') GROUP BY blkID, genome1, genome2, chr1, chr2, m HAVING count(*) >= 5),
v AS (SELECT blkID, s1 + p.x AS a1, e1 + p.x AS b1, s2 + q.x AS a2, e2 + q.x AS b2, p.y AS y1, q.y AS y2, unnest(range(0, 42)) AS i FROM b JOIN lay p ON p.genome = genome1 AND p.chr = chr1 JOIN lay q ON q.genome = genome2 AND q.chr = chr2),
u AS (SELECT *, CASE WHEN i > 20 THEN 41 - i ELSE i END / 20.0::DOUBLE AS t FROM v)
SELECT blkID, CAST(i AS INT) AS i, round(CASE WHEN i > 20 THEN b1 + (b2 - b1) * (1 - cos(t * pi())) / 2 ELSE a1 + (a2 - a1) * (1 - cos(t * pi())) / 2 END, 4) AS x, round(y1 + (y2 - y1) * t, 6) AS y FROM u""", "blocks")
def vz06_braids(t: Tables) -> DataFrame:
    levels = t.spark.createDataFrame([("G0", 0.0), ("G1", 1.0), ("G2", 2.0)], "genome string, level double")
    b = layout.consecutive(blocks.unphased(t.blocks.withColumn("isAnchor", F.lit(True)), 5), ["G0", "G1", "G2"])
    return layout.braids(b, layout.chromosome_layout(t.ranked), levels).withColumns({"x": F.round("x", 4), "y": F.round("y", 6)})


@query(f"""WITH {SIDE_BY_SIDE}, p AS (SELECT concat(genome, ' ', chr) AS key, x AS x1, x + length AS x2, least(0.2::DOUBLE, length / 2) AS r, unnest(range(0, 32)) AS i FROM lay),
q AS (SELECT *, i // 8 AS c, (i // 8 + i % 8 / 7.0::DOUBLE) * pi() / 2 AS a FROM p)
SELECT key, CAST(i AS INT) AS i, round(CASE WHEN c IN (0, 3) THEN x2 - r ELSE x1 + r END + r * cos(a), 4) AS x, round(CASE WHEN c IN (0, 1) THEN 0.4::DOUBLE - r ELSE r END + r * sin(a), 6) AS y FROM q""", "ranked")
def vz07_rounded_rectangles(t: Tables) -> DataFrame:
    c = layout.chromosome_layout(t.ranked)
    out = layout.rounded_rectangles(c.select(F.concat("genome", F.lit(" "), "chr").alias("key"), F.col("offset").alias("x1"), (F.col("offset") + F.col("length")).alias("x2"), F.lit(0.0).alias("y1"), F.lit(0.4).alias("y2")))
    return out.withColumns({"x": F.round("x", 4), "y": F.round("y", 6)})


@query("SELECT genome2, chr2, median(ord1) AS at, count(*) AS n FROM hits WHERE genome1 = 'G0' GROUP BY 1, 2", "hits")
def vz08_order_by_synteny(t: Tables) -> DataFrame:
    return layout.order_by_synteny(t.hits, "G0")


@query("SELECT c.genome, c.chr, (row_number() OVER (PARTITION BY genome, chr ORDER BY s) - 1) % 2 + 1 AS colour, s AS start, e AS \"end\" FROM (WITH " + FEATURES + ", " + LENGTHS + ", " + REDUCED + ", " + GAPS + " SELECT genome, chr, s, e FROM x WHERE e >= s) c", "genes")
def vz09_contig_map(t: Tables) -> DataFrame:
    from synblock.plans.catalogue import over

    c = intervals.gaps(intervals_of(t), lengths(t), BOTH)
    return c.select("genome", "chr", ((F.row_number().over(over("genome", "chr", order=["start"])) - 1) % 2 + 1).cast("long").alias("colour"), "start", "end")


@query(f"""WITH {FEATURES}, {LENGTHS}, {REDUCED}, {GAPS}, {GENE_SPANS}, nm AS (SELECT genome, chr, length, row_number() OVER (PARTITION BY genome ORDER BY TRY_CAST(regexp_replace(chr, '[^0-9]+', '', 'g') AS DOUBLE) NULLS LAST, chr) AS place FROM l WHERE genome IN ('G0', 'G1')),
tt AS (SELECT genome, sum(length) AS total, count(*) AS k FROM nm GROUP BY 1),
ga AS (SELECT genome, round((SELECT total FROM tt WHERE genome = 'G0') * 0.005::DOUBLE) + ((SELECT max(total) FROM tt) - total) / k * 0.25::DOUBLE AS gap FROM tt),
st AS (SELECT nm.*, 1 + coalesce(sum(length + 1) OVER (PARTITION BY genome ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (row_number() OVER (PARTITION BY genome ORDER BY place) - 1) * gap AS s FROM nm JOIN ga USING (genome)),
ch AS (SELECT genome, chr, length, s - max(s + length) OVER (PARTITION BY genome) / 2 AS x0 FROM st),
bl AS (SELECT blkID, genome1, genome2, chr1, chr2, min(start1) AS s1, max("end1") AS e1, min(start2) AS s2, max("end2") AS e2, CASE WHEN corr(CAST(ord1 AS DOUBLE), CAST(ord2 AS DOUBLE)) < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS v FROM blocks WHERE genome1 = 'G0' AND genome2 = 'G1' GROUP BY blkID, genome1, genome2, chr1, chr2 HAVING count(*) >= 5),
wi AS (SELECT genome, chr, q.s AS ws, least(q.s + 99999, length) AS we FROM ch, range(1, 1000001, 50000) q(s) WHERE q.s <= length),
wc AS (SELECT wi.genome, wi.chr, ws, we, sum(CASE WHEN r.s IS NOT NULL THEN least(we, r.e) - greatest(ws, r.s) + 1 ELSE 0 END) / (we - ws + 1) AS p FROM wi LEFT JOIN r ON wi.genome = r.genome AND wi.chr = r.chr AND ws <= r.e AND r.s <= we GROUP BY wi.genome, wi.chr, ws, we),
wg AS (SELECT wi.genome, wi.chr, ws, we, sum(CASE WHEN g.s IS NOT NULL THEN least(we, g.e) - greatest(ws, g.s) + 1 ELSE 0 END) / (we - ws + 1) AS p FROM wi LEFT JOIN g ON wi.genome = g.genome AND wi.chr = g.chr AND ws <= g.e AND g.s <= we GROUP BY wi.genome, wi.chr, ws, we),
pa AS (SELECT 'band' AS kind, blkID AS id, genome1 AS genome, chr1 AS chr, s1 AS s, e1 AS e, v AS value FROM bl UNION ALL SELECT 'band', blkID, genome2, chr2, s2, e2, v FROM bl
UNION ALL SELECT 'class', 'feature', r.genome, r.chr, greatest(r.s, 1), least(r.e, length), NULL FROM r JOIN ch USING (genome, chr) WHERE least(r.e, length) >= greatest(r.s, 1)
UNION ALL SELECT 'class', 'gene', g.genome, g.chr, greatest(g.s, x.s), least(g.e, x.e), NULL FROM g JOIN x ON g.genome = x.genome AND g.chr = x.chr AND g.s <= x.e AND x.s <= g.e AND x.e >= x.s
UNION ALL SELECT 'window', 'feature', genome, chr, ws, we, least(p, 1.0::DOUBLE) FROM wc
UNION ALL SELECT 'window', 'gene', genome, chr, ws, we, least(wc.p + wg.p, 1.0::DOUBLE) FROM wc JOIN wg USING (genome, chr, ws, we))
SELECT kind, id, genome, chr, round(x0 + s, 4) AS x1, round(x0 + e, 4) AS x2, round(value, 6) AS value FROM pa JOIN ch USING (genome, chr)""", "blocks")
def vz10_two_genomes(t: Tables) -> DataFrame:
    """Synteny bands, features and genes of two genomes, and their shares in sliding windows, stacked, on one axis."""
    classes = [("feature", intervals_of(t)), ("gene", t.genes.select("genome", "chr", "start", "end"))]
    b = blocks.unphased(t.blocks.withColumn("isAnchor", F.lit(True)), 5)
    out = riparian.two_genomes(b, classes, lengths(t), ("G0", "G1"), 100_000, 50_000)
    return out.withColumns({"x1": F.round("x1", 4), "x2": F.round("x2", 4), "value": F.round("value", 6)})


def flagship(t: Tables) -> DataFrame:
    return ranks.keep_first(Q.copy_numbers(t.genes, {"globalOGs": "og"}), ["genome", "ogType", "copyNumber"], ["nGenes"])
