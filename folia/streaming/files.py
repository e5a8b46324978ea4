"""Conversion of files as they arrive: each is one row, so the stream needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folia.plans.convert import Options, convert


def read_stream(spark: SparkSession, path: str, pattern: str = "*.pdf", files_a_batch: int = 1000) -> DataFrame:
    """New files below a path as (doc_id, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch).load(path)
    return files.select(F.col("path").alias("doc_id"), "content")


def convert_stream(files: DataFrame, sink: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Write conversions as Parquet below ``sink``, a folder for each micro-batch.

    A batch is converted by the batch plan, whose passes need all pages of a
    document; a document is one file and so in one batch. A batch that runs
    again after a failure replaces its own folder.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        convert(batch, options).write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
