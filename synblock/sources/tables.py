"""Readers and writers of annotation, alignment, orthology and result tables.

All are Spark scans with explicit schemas; none reads a file on the driver. Fields that are empty or NA
are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from synblock.functions.columns import blank_to_null, strip_marks
from synblock.operators.ranks import keep_first

GENES = "chr string, start long, end long, id string, ofID string, pepLen long, ord long, genome string, arrayID string, isArrayRep boolean, globOG string, globHOG string, noAnchor boolean, og string"
_END = "ofID{0} string, chr{0} string, start{0} long, end{0} long, id{0} string, ord{0} long, genome{0} string, isArrayRep{0} boolean"
HITS = f"{_END.format(1)}, {_END.format(2)}, pid double, length long, mismatches long, gapopenings long, queryStart long, queryEnd long, subjectStart long, subjectEnd long, Evalue double, bitScore double, sameOG boolean, noAnchor boolean, isAnchor boolean, isSyntenic boolean, regID string, blkID string"
SYN_HITS = f"{_END.format(1)}, {_END.format(2)}, bitScore double, sameOG boolean, noAnchor boolean, isAnchor boolean, regID string, blkID string"
POSITIONS = "blkID string, genome1 string, chr1 string, genome2 string, chr2 string, ofID1 string, ofID2 string, ord1 double, ord2 double"
PANGENES = "ofID string, pgID long, interpChr string, interpOrd double, pgRepID string, genome string, og string, flag string, id string, chr string, start long, end long, ord long"
BLAST = "ofID1 string, ofID2 string, pid double, length long, mismatches long, gapopenings long, queryStart long, queryEnd long, subjectStart long, subjectEnd long, Evalue double, bitScore double"
PAF = "windowName string, windowLength long, windowStart long, windowEnd long, windowStrand string, refChr string, refLength long, refStart long, refEnd long, nmatches long, blkLen long, mapq long"


def _stem(c: Column | None = None) -> Column:
    """The file's name without folder and endings; a folder that Spark has written as one file counts as the file."""
    pattern = r"(?:^|/)([^/]*?)(?:\.(?:bed|txt|tsv|csv|fa|faa|fasta|gff3?|gz|paf))+(?:/part-[^/]*)?$"
    return F.regexp_extract(c if c is not None else F.col("_metadata.file_path"), pattern, 1)


def _typed(df: DataFrame, schema: str) -> DataFrame:
    for part in schema.split(", "):
        name, kind = part.rsplit(" ", 1)
        c = blank_to_null(F.col(f"`{name}`"))
        df = df.withColumn(name, c if kind == "string" else c.try_cast(kind))
    return df


def _strings(schema: str) -> str:
    return ", ".join(f"`{p.rsplit(' ', 1)[0]}` string" for p in schema.split(", "))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """``genome, chr, start, end, id`` of BED files, closed and 1-based; incomplete rows go, the genome is the file's name."""
    schema = "chr string, start long, end long, id string"
    raw = spark.read.csv(path, sep="\t", schema=_strings(schema), comment="#").withColumn("genome", _stem())
    return _typed(raw, schema).dropna(subset=["chr", "start", "end", "id"]).withColumn("start", F.col("start") + 1).select("genome", "chr", "start", "end", "id")


def write_bed(df: DataFrame, path: str) -> None:
    df.select("chr", (F.col("start") - 1).alias("start"), "end", "id").write.csv(path, sep="\t", header=False)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``file, id, header, seq``; the id is the header up to the first blank. A record is one row."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(_stem().alias("file"), F.regexp_replace("value", "^>", "").alias("v")).where(F.trim("v") != "")
    header = F.trim(F.regexp_replace(F.substring_index("v", "\n", 1), "\r", ""))
    return raw.select("file", F.substring_index(header, " ", 1).alias("id"), header.alias("header"), F.regexp_replace(F.expr("substring(v, instr(v || '\n', '\n') + 1)"), r"[\s>]", "").alias("seq"))


def peptide_lengths(seqs: DataFrame) -> DataFrame:
    return seqs.select(F.col("file").alias("genome"), "id", F.length("seq").cast("long").alias("pepLen"))


def count_records(spark: SparkSession, path: str) -> DataFrame:
    """How many sequences each file has, by their header lines alone."""
    return spark.read.text(path).where(F.col("value").startswith(">")).groupBy(_stem().alias("file")).agg(F.count(F.lit(1)).alias("n"))


def write_fasta(df: DataFrame, path: str, name: str = "id", least: int = 0) -> None:
    df.where(F.length("seq") >= least).select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col("seq"))).write.text(path)


def read_gff(spark: SparkSession, path: str, kind: str | None = "gene", tag: str = "Name") -> DataFrame:
    """``genome, chr, start, end, strand, id`` of the features of one kind, or of any; the id is an attribute."""
    names = "seqid source type start end score strand phase attributes".split()
    raw = spark.read.csv(path, sep="\t", comment="#", schema=", ".join(f"{n} string" for n in names), quote="")
    value = F.regexp_extract("attributes", rf"(?:^|;)\s*{tag}=([^;]*)", 1)
    return (raw if kind is None else raw.where(F.col("type") == kind)).select(_stem().alias("genome"), F.col("seqid").alias("chr"), F.col("start").try_cast("long").alias("start"), F.col("end").try_cast("long").alias("end"), "strand", blank_to_null(value).alias("id"))


def read_blast(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark.read.csv(path, sep="\t", schema=_strings(BLAST)), BLAST)


def read_species_ids(spark: SparkSession, path: str) -> DataFrame:
    """``genomeNum, genome`` from lines such as ``0: name.fa``."""
    v = F.split("value", ":")
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim(v[0]).alias("genomeNum"), F.regexp_replace(F.trim(F.get(v, 1)), r"\.fa$", "").alias("genome"))


def read_sequence_ids(spark: SparkSession, path: str) -> DataFrame:
    """``ofID, genomeNum, geneNum, id`` from lines such as ``0_12: gene``."""
    v, n = F.split("value", ": "), F.split(F.split("value", ": ")[0], "_")
    return spark.read.text(path).where(F.trim("value") != "").select(v[0].alias("ofID"), n[0].try_cast("long").alias("genomeNum"), F.get(n, 1).try_cast("long").alias("geneNum"), F.get(v, 1).alias("id"))


def _lists(df: DataFrame, keys: list[str], genomes: list[str]) -> DataFrame:
    long = df.unpivot(keys, genomes, "genome", "ids").where(F.trim(F.coalesce("ids", F.lit(""))) != "")
    return long.withColumn("id", F.explode(F.split("ids", ","))).withColumn("id", F.trim("id")).where("id != ''").drop("ids")


def read_orthogroups(spark: SparkSession, path: str, genomes: list[str] | None = None) -> DataFrame:
    """``og, genome, id`` from a wide table with a comma-separated list per genome."""
    wide = spark.read.csv(path, sep="\t", header=True)
    genomes = [c for c in wide.columns[1:] if genomes is None or c in genomes]
    return _lists(wide.withColumnRenamed(wide.columns[0], "og"), ["og"], genomes)


def read_hogs(spark: SparkSession, path: str, genomes: list[str] | None = None) -> DataFrame:
    """``hog, genome, id``; a hierarchical group is named by its own and its orthogroup's name."""
    wide = spark.read.csv(path, sep="\t", header=True)
    genomes = [c for c in wide.columns[3:] if genomes is None or c in genomes]
    return _lists(wide.withColumn("hog", F.concat_ws(" ", wide.columns[0], wide.columns[1])), ["hog"], genomes)


def read_orthologues(spark: SparkSession, path: str) -> DataFrame:
    """``orthID, genome1, genome2, id1, id2``: all pairs of the two lists in each row."""
    wide = spark.read.csv(path, sep="\t", header=True)
    og, a, b = wide.columns[:3]
    lists = wide.select(F.col(og).alias("orthID"), F.lit(a).alias("genome1"), F.lit(b).alias("genome2"), F.array_distinct(F.split(F.col(f"`{a}`"), ",\\s*")).alias("l1"), F.array_distinct(F.split(F.col(f"`{b}`"), ",\\s*")).alias("l2"))
    return lists.withColumn("id1", F.explode("l1")).withColumn("id2", F.explode("l2")).select("orthID", "genome1", "genome2", F.trim("id1").alias("id1"), F.trim("id2").alias("id2"))


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark.read.csv(path, sep="\t", schema=_strings(PAF)), PAF)


def best_first(paf: DataFrame) -> DataFrame:
    """Adds ``place``, from 1, of each alignment of a window: by mapping quality, matches and length, then by position."""
    order = [F.desc("mapq"), F.desc("nmatches"), F.desc("blkLen"), "refChr", "refStart"]
    return paf.withColumn("place", F.row_number().over(Window.partitionBy("windowName").orderBy(*order)).cast("long"))


def convert_old(spark: SparkSession, path: str, out: str) -> None:
    """The gene table of an old run (``id, chr, start, end`` with a header, 1-based) as a BED file."""
    old = spark.read.csv(path, sep="\t", header=True)
    write_bed(old.select("chr", F.col("start").try_cast("long").alias("start"), F.col("end").try_cast("long").alias("end"), "id").dropna(), out)


def write_csv(df: DataFrame, path: str, compress: bool = False) -> None:
    df.write.csv(path, header=True, compression="gzip" if compress else "none")


def write_annotation(matched: DataFrame, path: str, genomes: list[str]) -> None:
    """A BED and a FASTA file per genome, from ``match_annotation``."""
    for genome in genomes:
        own = matched.where(F.col("genome") == genome)
        write_bed(own, f"{path}/bed/{genome}.bed")
        write_fasta(own, f"{path}/peptide/{genome}.fa")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result table with a header; another header than the schema's is refused."""
    df = spark.read.csv(path, sep="\t", header=True)
    want = [p.rsplit(" ", 1)[0] for p in schema.split(", ")]
    if df.columns != want:
        raise ValueError(f"{path} is malformed: its columns are {df.columns}, not {want}")
    return _typed(df, schema).select(*want)


def write_table(df: DataFrame, path: str, schema: str, compress: bool = True) -> None:
    """The columns of the schema as tab-separated text with a header."""
    want = [p.rsplit(" ", 1)[0] for p in schema.split(", ")]
    if missing := [c for c in want if c not in df.columns]:
        raise ValueError(f"columns {missing} are missing")
    out = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NA")).alias(c) for c in want))
    out.write.csv(path, sep="\t", header=True, compression="gzip" if compress else "none")


def write_pairs(hits: DataFrame, path: str) -> None:
    """Hits as Parquet, a folder for each pair of genomes, so readers of one pair open no other."""
    hits.write.partitionBy("genome1", "genome2").parquet(path)


def match_annotation(gff: DataFrame, fasta: DataFrame, names: DataFrame | None = None, least: int = 0, distinct: bool = False) -> DataFrame:
    """``genome, chr, start, end, id, seq`` of the genes of each genome that have both a feature and a sequence.

    Genomes are the names of the files, ``genome`` in ``gff`` and ``file`` in ``fasta``; ids that two genomes share are genes of either. Odd characters of
    ids become ``_`` first. Of features with one id the widest counts, of sequences the longest as it is written (ties: the first by
    chromosome and start, or by letters); then stop and gap marks go. ``names`` has ``genome, seqid, chr``, for chromosomes that are
    renamed. Sequences shorter than ``least`` go, and with ``distinct`` those of a genome that equal an earlier one by id.
    """
    clean = F.regexp_replace("id", "[^A-Za-z0-9_.-]", "_")
    seqs = fasta.where("id is not null").select(F.col("file").alias("genome"), clean.alias("id"), "seq")
    seqs = keep_first(seqs, ["genome", "id"], [F.desc(F.length("seq")), "seq"]).withColumn("seq", strip_marks(F.col("seq"))).where(F.length("seq") >= least)
    feats = gff.where("id is not null").withColumn("id", clean)
    feats = keep_first(feats, ["genome", "id"], [F.desc(F.col("end") - F.col("start")), "chr", "start"])
    if names is not None:
        renamed = names.select("genome", F.col("seqid").alias("chr"), F.col("chr").alias("_chr"))
        feats = feats.join(renamed, ["genome", "chr"], "left").withColumn("chr", F.coalesce("_chr", "chr"))
    matched = feats.select("genome", "chr", "start", "end", "id").join(seqs, ["genome", "id"])
    if distinct:
        matched = keep_first(matched.withColumn("_h", F.sha2("seq", 256)), ["genome", "_h"], ["id"]).drop("_h")
    return matched.select("genome", "chr", "start", "end", "id", "seq")


#: Presets: the attribute that names a gene, which entry of a header does, from 1, what parts the entries and what is taken out of it.
PRESETS = {
    "ncbi": {"tag": "gene", "entry": 2, "sep": " ", "strip": r"gene=|\[|\]"},
    "phytozome": {"tag": "Name", "entry": 4, "sep": " ", "strip": "locus="},
}
#: Names that stand for no chromosome, in lower case.
MASKED = ("na", "none", "unknown")


def header_ids(fasta: DataFrame, entry: int, sep: str, strip: str) -> DataFrame:
    """Sequences with the id that one entry of the header gives; those without such an entry go."""
    found = F.get(F.split("header", F.lit(sep)), F.lit(entry - 1))
    return fasta.withColumn("id", blank_to_null(F.regexp_replace(found, strip, "") if strip else found)).where("id is not null")


def region_names(spark: SparkSession, path: str) -> DataFrame:
    """``genome, seqid, chr``: chromosomes of sequence ids by the features of kind ``region``.

    A region without a chromosome, or one of ``MASKED``, keeps its sequence id; of several regions of a sequence the first in the file counts.
    """
    found = read_gff(spark, path, "region", "chromosome").withColumn("_n", F.monotonically_increasing_id()).where("chr is not null")
    first = keep_first(found, ["genome", "chr"], ["start", "_n"])
    bad = F.col("id").isNull() | F.lower("id").isin(*MASKED)
    return first.select("genome", F.col("chr").alias("seqid"), F.when(bad, F.col("chr")).otherwise(F.col("id")).alias("chr"))


def read_annotation(spark: SparkSession, gff: str, fasta: str, preset: str, **how) -> DataFrame:
    """Genes of annotation files, a GFF and a FASTA file a genome of the same name, by a preset; ``ncbi`` names chromosomes by the file's own regions."""
    p = PRESETS[preset]
    names = region_names(spark, gff) if preset == "ncbi" else None
    return match_annotation(read_gff(spark, gff, None, p["tag"]), header_ids(read_fasta(spark, fasta), p["entry"], p["sep"], p["strip"]), names, **how)


def chromosome_names(headers: DataFrame, file: str = "file", header: str = "header", order: str = "n") -> DataFrame:
    """``headers`` with ``chr``, a short name: by the blank-separated entry of headers that tells the sequences of their file apart.

    Entries count that all headers of a file have. A file with one such entry is named by it. Else by the first of these that holds: the first entry, if it is
    unique and the file's first is a 1, perhaps after chr, chromosome or scaffold; the one unique entry that has "chr" in the file's first header; the entry after
    the only one that has "chr" there, if it is unique; otherwise by the whole header. Commas and semicolons at the end of an entry aren't part of it. Names
    may repeat only where whole headers do. The first header is that with the least ``order``.
    """
    has = F.lower("value").contains("chr")
    parts = headers.select(F.col(file).alias("file"), F.col(order).alias("n"), F.trim(header).alias("header"))
    total = parts.groupBy("file").agg(F.count(F.lit(1)).alias("total"), F.min("n").alias("first"))
    long = parts.select("file", "n", F.posexplode(F.split("header", "\\s+")).alias("at", "value")).withColumn("value", F.regexp_replace("value", "[,;]+$", ""))
    each = long.groupBy("file", "at").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("value").alias("d"), F.min_by("value", "n").alias("value"))
    full = each.join(total, "file").where("c = total").withColumn("unique", F.col("d") == F.col("total"))
    one = F.regexp_replace(F.lower("value"), "chr0|chromosome|chr|scaffold", "") == "1"
    chosen = full.groupBy("file").agg(
        F.count(F.lit(1)).alias("k"), F.min("at").alias("only"), F.bool_or((F.col("at") == 0) & F.col("unique") & one).alias("lead"),
        F.collect_list(F.when(has & F.col("unique"), F.col("at"))).alias("own"), F.collect_list(F.when(has, F.col("at"))).alias("word"), F.collect_list(F.when(F.col("unique"), F.col("at"))).alias("apart"),
    )
    after = F.element_at("word", 1) + 1
    at = F.when(F.col("k") == 1, F.col("only")).when(F.col("lead"), 0).when(F.size("own") == 1, F.element_at("own", 1)).when((F.size("word") == 1) & F.array_contains("apart", after), after)
    rule = chosen.select("file", at.alias("_at"))
    joined = headers.join(F.broadcast(rule).withColumnRenamed("file", file), file, "left")  # a row a file
    value = F.regexp_replace(F.get(F.split(F.trim(header), "\\s+"), F.col("_at")), "[,;]+$", "")
    return joined.withColumn("chr", F.coalesce(value, F.trim(header))).drop("_at")


def agreement(beds: DataFrame, peptides: DataFrame) -> DataFrame:
    """Per genome: genes, sequences, ids in both, ids with a colon, and whether 95 percent agree and none has a colon."""
    a, b = beds.select("genome", "id").distinct().withColumn("_a", F.lit(1)), peptides.select("genome", "id").distinct().withColumn("_b", F.lit(1))
    both = a.join(b, ["genome", "id"], "outer").groupBy("genome").agg(F.count("_a").alias("nBed"), F.count("_b").alias("nPep"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("nBoth"), F.count_if(F.col("id").contains(":")).alias("nColon"))
    return both.withColumn("ok", (F.col("nBoth") >= 0.95 * F.greatest("nBed", "nPep")) & (F.col("nColon") == 0)).withColumn("few", F.col("nBoth") < 100)
