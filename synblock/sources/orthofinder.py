"""Finds the result files of an orthology run and copies them where a run looks for them, on any file system that Hadoop knows."""

from __future__ import annotations

import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = {"SpeciesIDs.txt": "species_ids", "SequenceIDs.txt": "sequence_ids", "Orthogroups.tsv": "orthogroups", "N0.tsv": "hogs", "SpeciesTree_rooted.txt": "tree"}


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """``path, name, kind, length, modified`` of the known files anywhere below ``folder``; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    kind = F.lit(None).cast("string")
    for known, value in NAMES.items():
        kind = F.when(F.col("name") == known, value).otherwise(kind)
    kind = F.when(F.col("name").rlike(r"^Blast.*\.txt(\.gz)?$"), "blast").when(F.col("name").rlike(r"__v__.*\.tsv$"), "orthologues").otherwise(kind)
    found = files.select("path", name.alias("name"), "length", F.col("modificationTime").alias("modified"))
    return found.withColumn("kind", kind).where("kind is not null").select("path", "name", "kind", "length", "modified")


def find(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Paths of the known files by kind, a list each; the driver holds a row a file."""
    out: dict[str, list[str]] = {v: [] for v in [*NAMES.values(), "blast", "orthologues"]}
    for r in listing(spark, folder).select("kind", "path").orderBy("path").collect():
        out[r["kind"]].append(r["path"])
    return out


def copy(spark: SparkSession, folder: str, into: str) -> dict[str, list[str]]:
    """The known files copied to the folder ``into``, perhaps of another file system; returns where they are. Of files with one name the last by path stays."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    target = fs.Path(into)
    target.getFileSystem(conf).mkdirs(target)
    out = {}
    for kind, paths in find(spark, folder).items():
        out[kind] = []
        for p in paths:
            a, b = fs.Path(p), fs.Path(target, p.rsplit("/", 1)[-1])
            fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
            out[kind].append(b.toString())
    return out


def tool(name: str) -> str | None:
    """Where an external program is, if it is installed; none is needed, its files are read where it has run."""
    return shutil.which(name)
