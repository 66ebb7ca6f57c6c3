"""Folders that all executors share, and tables cut from their lineage there."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def _checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where it has none, spark.checkpoint.dir, or a temporary folder on a local master, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder of its own, not yet made, in the shared checkpoint folder."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid4().hex}"


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt evenly, or by columns, over as many tasks as a shuffle has: for work per row that is heavy against the bytes it is read from, as small files are read by few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def tasks_for(df: DataFrame, rows: int) -> int:
    """How many tasks hold a table at so many rows each; not fewer than run at once."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def cut(df: DataFrame) -> DataFrame:
    """The rows in a reliable checkpoint, which outlives any executor."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()
