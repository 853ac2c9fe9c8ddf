"""New alignments as a stream: each micro-batch is annotated and appended to the table of hits.

Analyses themselves are batch jobs; only the arrival of alignments is incremental.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from synblock.operators import hits
from synblock.sources.tables import BLAST


def append_hits(spark: SparkSession, folder: str, genes: DataFrame, into: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Reads alignment files as they appear in ``folder`` and appends annotated hits to Parquet at ``into``, by genome pair.

    A batch that is run again writes to its own folder again, so none is doubled.
    """
    stream = spark.readStream.schema(BLAST).option("sep", "\t").csv(folder)

    def batch(df: DataFrame, number: int) -> None:
        hits.annotate(df, None, genes).write.mode("overwrite").partitionBy("genome1", "genome2").parquet(f"{into}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
