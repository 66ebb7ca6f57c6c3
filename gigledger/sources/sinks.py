"""Sinks: feeds, inventories and reports as partitioned files with manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feed_records(rows: DataFrame, kind: str, id_col: str, fields: list[str]) -> DataFrame:
    """(kind, id, payload): each row's fields as one JSON object."""
    return rows.select(F.lit(kind).alias("kind"), F.col(id_col).cast("string").alias("id"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))


def content_hash(payload: Column) -> Column:
    """Order-blind hash of a group of texts: count and the sums of two 32-bit words of each text's SHA-256."""
    digest = F.sha2(payload, 256)
    word = lambda at: F.sum(F.conv(F.substring(digest, at, 8), 16, 10).cast("decimal(20,0)"))
    return F.sha2(F.concat_ws("|", F.count(payload).cast("string"), word(1).cast("string"), word(9).cast("string")), 256)


def manifest(records: DataFrame) -> DataFrame:
    """(kind, records, bytes, content_hash) of feed records; nothing is gathered into one row."""
    return records.groupBy("kind").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("payload")).alias("bytes"), content_hash(F.col("payload")).alias("content_hash"))


def write_feed(records: DataFrame, folder: str, export_id: str) -> DataFrame:
    """Write records as JSON lines by kind under the export's folder and return the manifest of what was written."""
    path = f"{folder}/export_id={export_id}"
    records.select("kind", "payload").write.mode("overwrite").partitionBy("kind").text(path)
    return manifest(records.sparkSession.read.text(path).withColumnRenamed("value", "payload"))
