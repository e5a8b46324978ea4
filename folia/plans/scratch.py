"""Scratch tables in the folder that all executors and the driver share.

``spark.checkpoint.dir`` names it; a folder of our own is set only where the
session has none, as in local tests.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder, set to a local one only where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="folia-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder through Hadoop's file systems."""
    with contextlib.suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; whatever is left there goes when the driver ends."""
    path = f"{shared_dir(spark)}/folia-{name}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, path)
    return path


#: Rows of a file, where the number of rows is known.
FILE_ROWS = 250_000


#: Input splits that a narrow table's task takes, where there are more than tasks to run at once.
SPLITS = 4


def materialize(df: DataFrame, name: str, rows: int | None = None, narrow: bool = False, wide: bool = False) -> DataFrame:
    """Write a table to shared storage and read it back: its lineage ends there.

    Small files cost more than their rows: with a bound on its rows, a table has
    few files however many partitions its plan has (a wide one, whose rows are much
    work, at least two for each task that can run at once), and a narrow table, one
    made of a scan without a shuffle, has a file for several input splits.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism if wide else 1, -(-rows // FILE_ROWS)))
    elif narrow:
        n = df._jdf.queryExecution().toRdd().getNumPartitions()
        df = df.coalesce(max(-(-n // SPLITS), min(n, 2 * spark.sparkContext.defaultParallelism), 1))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folia_path = path
    return out


def drop_materialized(df: DataFrame) -> None:
    """Remove a table of :func:`materialize` that no later plan reads."""
    if path := getattr(df, "_folia_path", None):
        discard(df.sparkSession, path)


def settle(spark: SparkSession) -> None:
    """Remove the shuffle files of plans that are done: they stay until the driver collects what refers to them."""
    gc.collect()
    spark.sql("select 1").collect()  # listeners hold the last plan until another one ends
    spark._jvm.System.gc()
