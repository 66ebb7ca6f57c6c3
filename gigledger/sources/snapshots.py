"""Published exports: four kinds of feeds, a hash per record, what changed since the export before, and a manifest that names the latest.

An export writes its records as compressed JSON lines by kind and its snapshot (kind, id, hash; the
hash as bytes), then one manifest row. Both come from records that are written first and deleted
when the export is whole. An export that fails gets a row with its error; readers go by rows that say success.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import manifest

#: The kinds of records in each type of export.
EXPORT_KINDS = {"events": ("event",), "pois": ("poi",), "venues": ("venue",), "full": ("event", "poi", "venue")}
_MANIFEST = "export_id string, export_type string, status string, generated_at timestamp, generated_by string, kind string, records long, bytes long, content_hash string, error string"


def records(rows: DataFrame, kind: str, id_col: str, record) -> DataFrame:
    """(kind, id, payload, hash) of one kind; record is the published form as a column."""
    made = rows.select(F.lit(kind).alias("kind"), F.col(id_col).cast("string").alias("id"), F.to_json(record, {"ignoreNullFields": "false"}).alias("payload"))
    return made.withColumn("hash", F.sha2("payload", 256))


def changes(former: DataFrame, current: DataFrame) -> DataFrame:
    """(kind, id, change, former_hash, hash): new, changed, unchanged or withdrawn records of two snapshots (kind, id, hash)."""
    a = former.select("kind", "id", F.col("hash").alias("former_hash"))
    both = a.join(current.select("kind", "id", "hash"), ["kind", "id"], "full")
    change = F.when(F.col("former_hash").isNull(), "new").when(F.col("hash").isNull(), "withdrawn").when(F.col("hash") != F.col("former_hash"), "changed").otherwise("unchanged")
    return both.select("kind", "id", change.alias("change"), "former_hash", "hash")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per export and kind (failed exports: one row without a kind)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def latest(exports: DataFrame, export_type: str | None = None) -> DataFrame:
    """The rows of the latest successful export of each type, or of one type."""
    good = exports.where("status = 'success'")
    good = good.where(F.col("export_type") == export_type) if export_type else good
    newest = good.groupBy("export_type").agg(F.max(F.struct("generated_at", "export_id")).alias("m")).select("export_type", "m.export_id")
    return good.join(newest, ["export_type", "export_id"], "left_semi")


def snapshot(spark: SparkSession, folder: str, export_type: str) -> DataFrame:
    """(kind, id, hash) of the latest successful export of a type; no rows if there is none."""
    row = latest(read_manifest(spark, folder), export_type).select("export_id").first()
    if row:
        return spark.read.parquet(f"{folder}/snapshot/export_id={row.export_id}").withColumn("hash", F.lower(F.hex("hash")))
    return spark.createDataFrame([], "kind string, id string, hash string")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def export(published: DataFrame, folder: str, export_type: str, export_id: str, generated_at: str, generated_by: str = "") -> bool:
    """Write one export of (kind, id, payload, hash) records, hash a SHA-256 in hex; false if it failed, with the error in the manifest.

    Records of kinds that the type does not have are left out. The same export_id again writes the
    same folders again.
    """
    spark = published.sparkSession
    head = lambda status: [F.lit(export_id).alias("export_id"), F.lit(export_type).alias("export_type"), F.lit(status).alias("status"), F.lit(generated_at).cast("timestamp").alias("generated_at"), F.lit(generated_by).alias("generated_by")]
    names = [c.split()[0] for c in _MANIFEST.split(", ")]
    staged = f"{folder}/records/export_id={export_id}"
    try:
        kinds = EXPORT_KINDS[export_type]
        wanted = published.where(F.col("kind").isin(*kinds))
        wanted.select("kind", "id", "payload", F.unhex("hash").alias("hash")).write.mode("overwrite").option("compression", "zstd").parquet(staged)
        held = spark.read.parquet(staged)
        held.select("kind", "payload").write.mode("overwrite").option("compression", "gzip").partitionBy("kind").text(f"{folder}/feed/export_id={export_id}")
        held.select("kind", "id", "hash").write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/snapshot/export_id={export_id}")
        counts = spark.createDataFrame([(k,) for k in kinds], "kind string").join(manifest(held), "kind", "left").na.fill(0, ["records", "bytes"])
        rows = counts.select(*head("success"), "kind", "records", "bytes", "content_hash", F.lit(None).cast("string").alias("error"))
    except Exception as failed:  # whatever a job may raise
        none = [F.lit(None).cast(k).alias(n) for n, k in (("kind", "string"), ("records", "long"), ("bytes", "long"), ("content_hash", "string"))]
        rows = spark.range(1).select(*head("failure"), *none, F.lit(str(failed).splitlines()[0][:500]).alias("error"))
        rows.select(*names).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
        _delete(spark, staged)
        return False
    rows.select(*names).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    _delete(spark, staged)
    return True
