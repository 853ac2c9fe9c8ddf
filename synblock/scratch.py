"""Tables written to the cluster's shared folder in order to cut lineage.

Every table goes to a folder of its own under ``spark.checkpoint.dir``, so a lost executor costs
a re-read and never a recomputation. Where the setting is absent (tests), local sessions get a
temporary folder and others a folder below the warehouse.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_recorders: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            _own[app] = "file://" + tempfile.mkdtemp(prefix="synblock-")
        else:
            _own[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_synblock"
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _recorders:
        made.append(path)
    return path


@contextlib.contextmanager
def recording() -> Iterator[list[str]]:
    """The list fills with the places of all tables written meanwhile, so that they can be deleted once what reads them is written."""
    made: list[str] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders.remove(made)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What the shuffles of tables made and written meanwhile leave on the executors' disks goes when each is written. A frame that outlives this may be read again, so it is made outside."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once as Parquet, and the place where it is."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` computed once, written to the shared folder and read again."""
    return written(df, name)[0]


def bucketed(df: DataFrame, key: str, name: str) -> tuple[DataFrame, str]:
    """``df`` written once as Parquet in buckets of ``key``, so that grouping by ``key`` needs no shuffle, and the place where it is.

    There are as many buckets as shuffle partitions. The catalog entry that Spark asks for goes at once; the frame keeps its bucketing.
    """
    spark = df.sparkSession
    path, n = new_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return found, path
