"""Files written and read again, and what else stands at a run's edges, as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synblock import scratch
from synblock.operators import genes, hits, sequence
from synblock.plans import params
from synblock.plans import query as Q
from synblock.plans.catalogue import query
from synblock.plans.catalogue_genome import paf
from synblock.plans.workload import Tables
from synblock.sources import dna, tables

GENOMES = ("G0", "G1", "G2")
N = "CAST(substr({}, 2) AS BIGINT)"


def n(c: str) -> Column:
    return F.substring(c, 2, 20).cast("long")


def shaped(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the columns of a schema; those it hasn't are null."""
    parts = [p.rsplit(" ", 1) for p in schema.split(", ")]
    return df.select(*((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name) for name, kind in parts))


def again(t: Tables, df: DataFrame, schema: str) -> DataFrame:
    """A result table written and read again."""
    tables.write_table(shaped(df, schema), path := scratch.new_path(t.spark, "table"), schema)
    return tables.read_table(t.spark, path, schema)


def peptides(t: Tables) -> str:
    path = scratch.new_path(t.spark, "peptides")
    seqs = t.genes.select("genome", "id", F.rpad(F.lit("M"), F.col("pepLen").cast("int"), F.lit("ACDEFG")).alias("seq"))
    for genome in GENOMES:
        tables.write_fasta(seqs.where(F.col("genome") == genome), f"{path}/{genome}.fa")
    return f"{path}/*.fa"


@query("SELECT genome, id, pepLen FROM genes", "genes")
def src03_peptide_lengths(t: Tables) -> DataFrame:
    return tables.peptide_lengths(tables.read_fasta(t.spark, peptides(t)))


@query("SELECT genome AS file, count(*) AS n FROM genes GROUP BY 1", "genes")
def src04_count_records(t: Tables) -> DataFrame:
    return tables.count_records(t.spark, peptides(t))


def gff(df: DataFrame, path: str, tag: str = "Name", extra: DataFrame | None = None) -> None:
    """Rows ``(genome, chr, start, end, id, kind)`` as a GFF file per genome, after regions ``(genome, chr, start, end, note)``."""
    note = F.concat(F.lit("ID=x"), F.col("id"), F.lit(f";{tag}="), F.col("id"), F.lit(";note=a b"))
    line = lambda rows, kind, note: rows.select("genome", "chr", F.lit("src").alias("s"), kind.alias("kind"), "start", "end", F.lit(".").alias("a"), F.lit("+").alias("b"), F.lit(".").alias("c"), note.alias("d"))
    rows = line(df, F.col("kind"), note)
    if extra is not None:
        rows = line(extra, F.lit("region"), F.col("note")).unionByName(rows)
    for genome in GENOMES:
        rows.where(F.col("genome") == genome).drop("genome").write.csv(f"{path}/{genome}.gff3", sep="\t", quote="")


@query(f"SELECT genome, chr, start, \"end\", '+' AS strand, id FROM genes WHERE {N.format('id')} % 3 <> 0", "genes")
def src06_gff(t: Tables) -> DataFrame:
    path = scratch.new_path(t.spark, "gff")
    gff(t.genes.withColumn("kind", F.when(n("id") % 3 == 0, "mRNA").otherwise("gene")), path)
    return tables.read_gff(t.spark, f"{path}/*.gff3", "gene", "Name")


@query("SELECT DISTINCT substr(genome, 2) AS genomeNum, genome FROM genes", "genes")
def src08_species_ids(t: Tables) -> DataFrame:
    lines = t.genes.select("genome").distinct().select(F.concat(F.substring("genome", 2, 9), F.lit(": "), "genome", F.lit(".fa")))
    lines.write.text(path := scratch.new_path(t.spark, "species"))
    return tables.read_species_ids(t.spark, path)


@query(f"SELECT concat(substr(genome, 2), '_', substr(id, 2)) AS ofID, CAST(substr(genome, 2) AS BIGINT) AS genomeNum, {N.format('id')} AS geneNum, id FROM genes", "genes")
def src09_sequence_ids(t: Tables) -> DataFrame:
    lines = t.genes.select(F.concat(F.substring("genome", 2, 9), F.lit("_"), F.substring("id", 2, 20), F.lit(": "), "id"))
    lines.write.text(path := scratch.new_path(t.spark, "sequences"))
    return tables.read_sequence_ids(t.spark, path)


@query("SELECT concat('N0.', og, ' ', og) AS hog, genome, id FROM genes", "genes")
def src11_hogs(t: Tables) -> DataFrame:
    wide = t.genes.groupBy("og").pivot("genome", list(GENOMES)).agg(F.array_join(F.collect_list("id"), ", "))
    wide.select(F.concat(F.lit("N0."), "og").alias("HOG"), F.col("og").alias("OG"), F.lit("n0").alias("node"), *GENOMES).write.csv(path := scratch.new_path(t.spark, "hogs"), sep="\t", header=True)
    return tables.read_hogs(t.spark, path)


@query("SELECT DISTINCT a.og AS orthID, a.genome AS genome1, b.genome AS genome2, a.id AS id1, b.id AS id2 FROM genes a JOIN genes b ON a.og = b.og AND a.genome < b.genome", "genes")
def src12_orthologues(t: Tables) -> DataFrame:
    """A table of orthologues a pair of genomes."""
    path, out = scratch.new_path(t.spark, "orthologues"), None
    for a, b in (("G0", "G1"), ("G0", "G2"), ("G1", "G2")):
        wide = t.genes.groupBy(F.col("og").alias("Orthogroup")).pivot("genome", [a, b]).agg(F.array_join(F.collect_list("id"), ", ")).where(f"{a} is not null and {b} is not null")
        wide.write.csv(f"{path}/{a}__v__{b}.tsv", sep="\t", header=True)
        read = tables.read_orthologues(t.spark, f"{path}/{a}__v__{b}.tsv")
        out = read if out is None else out.unionByName(read)
    return out


PAF_SQL = f"""SELECT windowName, refChr, refStart, nmatches, blkLen, mapq, row_number() OVER (PARTITION BY windowName ORDER BY mapq DESC, nmatches DESC, blkLen DESC, refChr, refStart) AS place FROM (
  SELECT concat(genome1, '.', genome2, '.', chr1, ':', start1, '_', start1 + 999) AS windowName, chr2 AS refChr, start2 AS refStart, 500 + {N.format('ofID1')} % 400 AS nmatches, 950 + {N.format('ofID2')} % 50 AS blkLen, {N.format('ofID1')} % 61 AS mapq
  FROM hits WHERE {N.format('ofID1')} % 5 <> 0)"""


@query(PAF_SQL, "hits")
def src13_paf(t: Tables) -> DataFrame:
    """Alignments of all pairs of genomes, best first in each window."""
    named = paf(t).withColumn("windowName", F.concat_ws(".", "genome1", "genome2", "windowName"))
    shaped(named, tables.PAF).write.csv(path := scratch.new_path(t.spark, "paf"), sep="\t", nullValue="NA")
    return tables.best_first(tables.read_paf(t.spark, path)).select("windowName", "refChr", "refStart", "nmatches", "blkLen", "mapq", "place")


@query(f"SELECT ofID, genome, chr, start, \"end\", ord, pepLen, og, {N.format('ofID')} % 4 <> 0 AS isArrayRep FROM ranked", "ranked")
def src14_gene_table(t: Tables) -> DataFrame:
    return again(t, t.ranked.withColumn("isArrayRep", n("ofID") % 4 != 0), tables.GENES).select("ofID", "genome", "chr", "start", "end", "ord", "pepLen", "og", "isArrayRep")


HIT_COLUMNS = ["ofID1", "chr1", "start1", "ord1", "genome1", "ofID2", "chr2", "end2", "ord2", "genome2", "bitScore", "blkID"]


@query(f"SELECT {', '.join(HIT_COLUMNS)}, CAST(NULL AS DOUBLE) AS Evalue FROM blocks", "blocks")
def src15_hit_table(t: Tables) -> DataFrame:
    return again(t, t.blocks, tables.HITS).select(*HIT_COLUMNS, "Evalue")


@query(f"SELECT {', '.join(HIT_COLUMNS)} FROM blocks WHERE blkID IS NOT NULL", "blocks")
def src16_syntenic_hit_table(t: Tables) -> DataFrame:
    return again(t, t.blocks, tables.SYN_HITS).select(*HIT_COLUMNS)


@query(f"SELECT ofID, {N.format('ofID')} AS pgID, CASE WHEN genome = 'G0' THEN chr END AS interpChr, ord + 0.25::DOUBLE AS interpOrd, 'PASS' AS flag, og, ord FROM ranked", "ranked")
def src18_pangene_table(t: Tables) -> DataFrame:
    p = t.ranked.withColumns({"pgID": n("ofID"), "interpChr": F.when(F.col("genome") == "G0", F.col("chr")), "interpOrd": F.col("ord") + 0.25, "flag": F.lit("PASS")})
    return again(t, p, tables.PANGENES).select("ofID", "pgID", "interpChr", "interpOrd", "flag", "og", "ord")


BACK = f"SELECT genome2, genome1, ofID2, ofID1, bitScore - 1 AS bitScore FROM hits WHERE {N.format('ofID1')} % 2 = 0"


@query(f"""WITH u AS (SELECT genome1, genome2, ofID1, ofID2, bitScore FROM hits UNION ALL {BACK}),
v AS (SELECT ofID1, ofID2, bitScore, 0 AS turned FROM u WHERE genome1 = 'G1' UNION ALL SELECT ofID2, ofID1, bitScore, 1 FROM u WHERE genome2 = 'G1')
SELECT ofID1, ofID2, bitScore FROM (SELECT *, row_number() OVER (PARTITION BY ofID1, ofID2 ORDER BY turned, bitScore DESC) AS r FROM v) WHERE r = 1""", "hits")
def src20_reference_view_of_all(t: Tables) -> DataFrame:
    """Hits that are there in both directions, with scores of their own."""
    back = hits.swapped(t.hits.where(n("ofID1") % 2 == 0)).withColumn("bitScore", F.col("bitScore") - 1)
    return hits.reference_view(t.hits.unionByName(back), "G1").select("ofID1", "ofID2", "bitScore")


@query("SELECT chr, start, \"end\", id, genome FROM genes", "genes")
def src24_old_input(t: Tables) -> DataFrame:
    """Positions of an old run, a table with a header per genome, turned into BED files."""
    path = scratch.new_path(t.spark, "old")
    for genome in GENOMES:
        t.genes.where(F.col("genome") == genome).select("id", "chr", "start", "end", F.lit("+").alias("strand")).write.csv(f"{path}/{genome}.txt", sep="\t", header=True)
        tables.convert_old(t.spark, f"{path}/{genome}.txt", f"{path}/{genome}.bed")
    return tables.read_bed(t.spark, f"{path}/*.bed").select("chr", "start", "end", "id", "genome")


def annotation(t: Tables, preset: str) -> tuple[str, str]:
    """GFF and FASTA files of genes as annotations have them, a genome each.

    All genomes share their ids; some ids come twice, spelt differently but the same once cleaned, with wider features or longer sequences; some have no
    feature or no sequence. The ncbi ones have sequence ids in place of chromosomes, and regions that name some of these.
    """
    locus = F.expr("cast(substr(id, 2) as bigint) div 3")
    g = t.genes.withColumns({"k": locus, "id": F.concat(F.lit("g|"), locus.cast("string")), "kind": F.lit("gene")})
    other = g.withColumn("id", F.concat(F.lit("g_"), F.col("k").cast("string")))
    feats = g.where("k % 7 != 0").unionByName(g.where("k % 4 = 0").withColumn("end", F.col("end") + 50)).unionByName(other.where("k % 11 = 0").withColumn("end", F.col("end") + 80))
    seq = lambda extra: F.concat(F.rpad(F.lit("M"), (F.col("pepLen") + extra).cast("int"), F.lit("ACD")), F.lit(".-"))
    parts = {"phytozome": ("p", " pacid=1 transcript=t locus=", " annot=x"), "ncbi": ("lcl|x_", " [gene=", "] [protein=a b]")}[preset]
    header = F.concat(F.lit(parts[0]), F.col("k").cast("string"), F.lit(parts[1]), F.col("id"), F.lit(parts[2]))
    seqs = [x.select("genome", header.alias("id"), seq(extra).alias("seq")) for x, extra in ((g.where("k % 5 != 0"), 0), (g.where("k % 3 = 0"), 9), (other.where("k % 13 = 0"), 12))]
    fasta = seqs[0].unionByName(seqs[1]).unionByName(seqs[2])
    path, tag, extra = scratch.new_path(t.spark, "annotation"), "Name", None
    if preset == "ncbi":
        tag = "gene"
        number = F.regexp_extract("chr", "[0-9]+", 0).cast("int")
        feats = feats.withColumn("chr", F.concat(F.lit("NC_"), F.col("chr")))
        ends = t.genes.groupBy("genome", "chr").agg(F.max("end").alias("end"))
        name = F.when(number % 5 == 0, F.lit(";note=none")).when(number % 5 == 1, F.lit(";chromosome=Unknown")).otherwise(F.concat(F.lit(";chromosome="), F.col("chr")))
        extra = ends.where(number % 5 != 4).select("genome", F.concat(F.lit("NC_"), "chr").alias("chr"), F.lit(1).cast("long").alias("start"), "end", F.concat(F.lit("ID=r"), name).alias("note"))
    gff(feats, path, tag, extra)
    for genome in GENOMES:
        tables.write_fasta(fasta.where(F.col("genome") == genome), f"{path}/{genome}.fa")
    return f"{path}/*.gff3", f"{path}/*.fa"


ANNOTATION = f"""WITH k AS (SELECT *, {N.format('id')} // 3 AS k, CAST(regexp_extract(chr, '[0-9]+') AS INT) % 5 AS c FROM genes)
SELECT genome, @chr AS chr, start, "end" + CASE WHEN k % 11 = 0 THEN 80 WHEN k % 4 = 0 THEN 50 ELSE 0 END AS "end", concat('g_', k) AS id,
  rpad('M', CAST(pepLen + CASE WHEN k % 13 = 0 THEN 12 WHEN k % 3 = 0 THEN 9 ELSE 0 END AS INT), 'ACD') AS seq
FROM k WHERE (k % 7 <> 0 OR k % 4 = 0 OR k % 11 = 0) AND (k % 5 <> 0 OR k % 3 = 0 OR k % 13 = 0)"""


def ingested(t: Tables, preset: str) -> DataFrame:
    """Features and sequences matched, written as BED and FASTA files, and read again."""
    path = scratch.new_path(t.spark, "ingested")
    tables.write_annotation(scratch.materialize(tables.read_annotation(t.spark, *annotation(t, preset), preset), "matched"), path, list(GENOMES))
    bed, fasta = tables.read_bed(t.spark, f"{path}/bed/*.bed"), tables.read_fasta(t.spark, f"{path}/peptide/*.fa")
    return bed.join(fasta.select(F.col("file").alias("genome"), "id", "seq"), ["genome", "id"]).select("genome", "chr", "start", "end", "id", "seq")


@query(ANNOTATION.replace("@chr", "chr"), "genes")
def src25_annotation(t: Tables) -> DataFrame:
    return ingested(t, "phytozome")


@query(ANNOTATION.replace("@chr", "CASE WHEN c IN (2, 3) THEN chr ELSE concat('NC_', chr) END"), "genes")
def src26_ncbi_annotation(t: Tables) -> DataFrame:
    """Chromosomes are named by the file's regions, but for those whose region has no name, a masked one, or that have none."""
    return ingested(t, "ncbi")


@query("SELECT blkID, genome1, genome2, chr1, chr2, count(DISTINCT ofID1) AS nHits1, min(start1) AS startBp1 FROM blocks GROUP BY ALL", "blocks")
def sink01_blocks(t: Tables) -> DataFrame:
    from synblock.operators import blocks

    with scratch.shuffles_removed(t.spark):
        tables.write_csv(blocks.coordinates(t.blocks), path := scratch.new_path(t.spark, "blocks"), compress=True)
    read = t.spark.read.csv(path, header=True)
    return read.select("blkID", "genome1", "genome2", "chr1", "chr2", F.col("nHits1").cast("long").alias("nHits1"), F.col("startBp1").cast("long").alias("startBp1"))


@query("SELECT ofID, og, og AS pan_og, genome FROM genes", "genes")
def prj05_duplicate_column(t: Tables) -> DataFrame:
    return t.genes.select("ofID", "og", F.col("og").alias("pan_og"), "genome")


@query("""WITH b AS (SELECT genome, chr, CAST(regexp_extract(chr, '[0-9]+') AS INT) AS c, min(start) AS s, max("end") AS e FROM genes GROUP BY 1, 2),
r AS (SELECT genome, chr, CASE WHEN c % 2 = 0 THEN s ELSE 0 END AS start, CASE WHEN c % 3 = 0 THEN e ELSE 4611686018427387903 END AS "end" FROM b)
SELECT *, concat(genome, ', ', chr, ': ', start, '-', "end") AS region FROM r""", "genes")
def flt06_regions(t: Tables) -> DataFrame:
    """Regions of all chromosomes, some of which are open at one end or both: these are filled in. Those on no chromosome of the run are refused (see the tests)."""
    c = F.regexp_extract("chr", "[0-9]+", 0).cast("int")
    bed = t.genes.groupBy("genome", "chr").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    return Q.regions(bed.select("genome", "chr", F.when(c % 2 == 0, F.col("s")).alias("start"), F.when(c % 3 == 0, F.col("e")).alias("end")), t.genes)


@query("SELECT ofID1, ofID2, bitScore FROM hits WHERE genome1 = 'G0' AND genome2 = 'G2'", "hits")
def set07_one_pair_of_many(t: Tables) -> DataFrame:
    """Hits in a folder a pair of genomes, of which one is read."""
    tables.write_pairs(t.hits, path := scratch.new_path(t.spark, "pairs"))
    return t.spark.read.parquet(path).where("genome1 = 'G0' and genome2 = 'G2'").select("ofID1", "ofID2", "bitScore")


@query("SELECT og, genome, count(*) AS n FROM genes GROUP BY 1, 2", "genes")
def so03_bucketed(t: Tables) -> DataFrame:
    """Groups of a table that is bucketed by its key: no shuffle is left to the grouping."""
    return scratch.bucketed(t.genes.select("og", "genome"), "og", "genes")[0].groupBy("og", "genome").agg(F.count(F.lit(1)).alias("n"))


@query("WITH g AS (SELECT DISTINCT genome FROM genes) SELECT a.genome AS query, b.genome AS target, a.genome = b.genome AS isSelf, CASE b.genome WHEN 'G1' THEN 2 ELSE 1 END AS nTargets, CASE a.genome WHEN 'G1' THEN 2 ELSE 1 END AS nQueries, 5 AS blkSize, 5 AS nGaps, round(sqrt(2.0::DOUBLE) * 100, 9) AS synRad FROM g a JOIN g b ON a.genome <= b.genome", "genes")
def sy11_pair_parameters(t: Tables) -> DataFrame:
    out = params.pairs(t.spark, params.Params(GENOMES, {"G1": 2}))
    return out.select("query", "target", "isSelf", "nTargets", "nQueries", "blkSize", "nGaps", F.round("synRad", 9).alias("synRad"))


@query(f"""WITH f AS (SELECT ofID1, ofID2, bitScore FROM hits WHERE {N.format('ofID1')} % 3 <> 0 UNION ALL SELECT ofID1, ofID2, bitScore + {N.format('ofID1')} % 7 - 3 FROM hits WHERE {N.format('ofID2')} % 2 = 0),
b AS (SELECT ofID1, ofID2, max(bitScore) AS bitScore FROM f GROUP BY 1, 2)
SELECT ofID1, ofID2, bitScore, x.ord AS ord1, y.ord AS ord2, x.genome AS genome1, y.genome AS genome2, x.og = y.og AS sameOG, {N.format('ofID1')} % 11 = 0 OR {N.format('ofID2')} % 11 = 0 AS noAnchor FROM b JOIN ranked x ON x.ofID = ofID1 JOIN ranked y ON y.ofID = ofID2""", "hits")
def sy10_both_directions(t: Tables) -> DataFrame:
    forward = t.hits.where(n("ofID1") % 3 != 0).select("ofID1", "ofID2", "bitScore")
    reverse = t.hits.where(n("ofID2") % 2 == 0).select(F.col("ofID2").alias("ofID1"), F.col("ofID1").alias("ofID2"), (F.col("bitScore") + n("ofID1") % 7 - 3).alias("bitScore"))
    g = t.ranked.withColumns({"isArrayRep": F.lit(True), "noAnchor": n("ofID") % 11 == 0})
    return hits.annotate(forward, reverse, g).select("ofID1", "ofID2", "bitScore", "ord1", "ord2", "genome1", "genome2", "sameOG", "noAnchor")


@query("""SELECT p_partkey AS chr, p AS start, p + 3 AS "end", kmer FROM (SELECT p_partkey, upper(p_name) AS s, unnest(range(1, length(p_name) - 2)) AS p FROM part), (VALUES ('RING'), ('BOLD')) w(kmer)
WHERE CAST(substr(s, p, 1) <> substr(kmer, 1, 1) AS INT) + CAST(substr(s, p + 1, 1) <> substr(kmer, 2, 1) AS INT) + CAST(substr(s, p + 2, 1) <> substr(kmer, 3, 1) AS INT) + CAST(substr(s, p + 3, 1) <> substr(kmer, 4, 1) AS INT) <= 1""")
def sf20_kmers_with_mismatches(t: Tables) -> DataFrame:
    return sequence.kmer_hits(t.part.select(F.col("p_partkey").alias("chr"), F.col("p_name").alias("seq")), ["RING", "BOLD"], 1)


@query(f"""WITH r0 AS (SELECT genome, chr, og, ofID, CAST(ord AS DOUBLE) AS o FROM ranked),
{", ".join(f'''d{i} AS (SELECT *, dense_rank() OVER (PARTITION BY genome ORDER BY o) AS d FROM r{i - 1}), j{i} AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY genome, chr, og ORDER BY d, ofID) > 100 THEN 1 ELSE 0 END AS j FROM d{i}),
a{i} AS (SELECT *, concat_ws('_', genome, chr, og, CAST(sum(j) OVER (PARTITION BY genome, chr, og ORDER BY d, ofID ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1 AS VARCHAR)) AS arrayID FROM j{i}), r{i} AS (SELECT genome, chr, og, ofID, avg(o) OVER (PARTITION BY arrayID) AS o, arrayID AS a FROM a{i})''' for i in (1, 2, 3))}
SELECT ofID, a AS arrayID FROM r3""", "ranked")
def sy07_three_rounds(t: Tables) -> DataFrame:
    """Three rounds of arrays, whether or not their number still falls."""
    return genes.tandem_arrays(t.ranked, 100, 3, always=True).select("ofID", "arrayID")


# Sequences in chunks

LETTERS = "s AS (SELECT CAST(doc_id AS VARCHAR) AS chr, regexp_replace(text, '[^A-Za-z]+', '', 'g') AS seq FROM documents WHERE regexp_replace(text, '[^A-Za-z]+', '', 'g') <> '')"


def chunked(t: Tables, overlap: int) -> DataFrame:
    """The letters of all texts as FASTA files, read in chunks of 1,000 letters by ranges of 100,000 bytes."""
    seqs = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.regexp_replace("text", "[^A-Za-z]+", "").alias("seq"))
    tables.write_fasta(seqs, path := scratch.new_path(t.spark, "dna"), least=1)
    return dna.chunks(t.spark, path, 1_000, overlap, 100_000)


@query(f"WITH {LETTERS} SELECT chr, p AS start, p + 3 AS \"end\", upper(substr(seq, p, 4)) AS kmer FROM (SELECT chr, seq, unnest(range(1, length(seq) + 1)) AS p FROM s) WHERE p + 3 <= length(seq) AND upper(substr(seq, p, 4)) IN ('TION', 'THER')")
def src05_kmer_hits(t: Tables) -> DataFrame:
    return sequence.kmer_hits(chunked(t, 3), ["TION", "THER"])


@query(f"""WITH {LETTERS}, k AS (SELECT chr, p AS s FROM (SELECT chr, seq, unnest(range(1, length(seq) + 1)) AS p FROM s) WHERE p <= length(seq) AND upper(substr(seq, p, 1)) = 'N')
SELECT chr, start, "end" FROM (SELECT chr, min(s) AS start, max(s) AS "end" FROM (SELECT *, sum(j) OVER (PARTITION BY chr ORDER BY s) AS i FROM (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY chr ORDER BY s) - 1 >= 2 THEN 1 ELSE 0 END AS j FROM k)) GROUP BY chr, i) WHERE "end" - start >= 2""")
def src05_runs(t: Tables) -> DataFrame:
    return sequence.runs_of(chunked(t, 0), "N", 3)


@query(f"WITH {LETTERS} SELECT concat(chr, ':', CAST(p AS VARCHAR), '_', CAST(p + 499 AS VARCHAR)) AS name, chr, p AS start, p + 499 AS \"end\", substr(seq, p, 500) AS seq FROM (SELECT chr, seq, unnest(range(1, length(seq) + 1, 250)) AS p FROM s) WHERE p + 499 <= length(seq)")
def src05_tiles(t: Tables) -> DataFrame:
    return sequence.tiles(chunked(t, 499), 500, 250)


@query(f"WITH {LETTERS} SELECT chr, CAST(length(seq) AS BIGINT) AS length FROM s")
def src05_lengths(t: Tables) -> DataFrame:
    return sequence.lengths(chunked(t, 0))
