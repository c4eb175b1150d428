"""Folders that driver and executors share, and results that are computed once and kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, a new temporary one in local mode (tests) and an error on a cluster, whose machines would not share it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return root or tempfile.mkdtemp(prefix="spark-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that shared_path() named."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept as files in the shared folder; a lost executor loses nothing."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def tasks_for(rows: DataFrame, rows_per_task=50_000) -> int:
    """One task for each rows_per_task of rows that checkpointed() has kept: what to coalesce them to in a loop.

    Else each of the loop's jobs starts as many tasks as the rows' origin had partitions, and as many again after each shuffle, however few the rows are; the driver keeps account of each. Rows of one task need no shuffle if what they are joined with is broadcast.
    """
    return max(1, -(-rows.count() // rows_per_task))
