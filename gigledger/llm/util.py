"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from uuid import uuid4

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir; where the session has none, take a temporary folder on a local master, as in tests, and fail on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows lie in the shared folder and outlive any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: smaller than a checkpoint for wide rows, and read by column."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, dict[str, str]]:
    """The table with a number per row (`row`), and the neutral name of each column.

    Where ids are whole numbers, unique and never null, they are the numbers; else rows get numbers of their
    own in a written table, so that null and repeated ids are rows like any other. Columns are
    renamed so that no name can clash.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    if id_col in names and dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint"):
        ids = plain.groupBy(F.col(names[id_col]).cast("long").alias("row")).agg(F.count(F.lit(1)).alias("n"))
        if ids.where("row is null or n > 1").isEmpty():
            return plain.withColumn("row", F.col(names[id_col]).cast("long")), names
    return written(plain.withColumn("row", F.monotonically_increasing_id())), names


def without_rows(rows: DataFrame, names: dict[str, str], gone: DataFrame) -> DataFrame:
    """The numbered table under its own names again, less the rows whose numbers are gone."""
    return rows.join(gone.select("row").distinct(), "row", "left_anti").select(*[F.col(n).alias(c) for c, n in names.items()])


def crc32_of_id(col) -> F.col:
    """crc32 of the id's decimal text; null ids count as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(col).cast("string"), F.lit("")), "UTF-8"))


def encode_utf8(text: str | None) -> bytes:
    """UTF-8 of a text, null as empty; lone surrogates cannot come from Spark."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def segment_starts(lengths: np.ndarray) -> np.ndarray:
    """Start offsets of consecutive segments with the given lengths."""
    out = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=out[1:])
    return out
