"""A golden table that is merged on read.

Rows lie in hash buckets of their key. A batch writes one delta folder with the rows it created or
changed, only in the buckets it touches; a reader takes, per bucket, the newest base files and the
deltas after them, and the newest row per key. Compaction writes new base files for buckets that
have gathered deltas. A manifest of (kind, n, bucket) names what is whole, so that files of a batch
that failed half-way are never read, and a batch that runs again writes its own folder again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..operators.upsert import merge_fields
from ..operators.windows import latest

_MANIFEST = "kind string, n long, bucket int"


class GoldenTable:
    """One row per key under `folder`, merged by a policy per column (see merge_fields).

    schema lists the key and the policy's columns. Null keys are left out of every batch. At most
    `buckets` names times the batches since the last compaction reach the driver.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, policy: dict[str, str], schema: str, buckets: int = 64):
        self.spark, self.folder, self.key, self.policy, self.buckets = spark, folder, key, policy, buckets
        self.schema = spark.createDataFrame([], schema).select(key, *policy).schema

    def _path(self, path: str):
        """The Hadoop path and its file system."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _note(self, kind: str, n: int, buckets: list[int]) -> None:
        if buckets:
            self.spark.createDataFrame([(kind, n, b) for b in buckets], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def manifest(self, before: int | None = None) -> DataFrame:
        """(kind, n, bucket) of the bases and deltas that make up the table as it was before a batch, superseded ones left out."""
        path, fs = self._path(f"{self.folder}/manifest")
        if not fs.exists(path):
            return self.spark.createDataFrame([], _MANIFEST)
        known = self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest").distinct()
        if before is not None:
            known = known.where(F.col("n") < before)
        base = known.where("kind = 'base'").groupBy("bucket").agg(F.max("n").alias("base"))
        newer = (F.col("kind") == "base") & (F.col("n") == F.col("base")) | (F.col("kind") == "delta") & (F.col("n") > F.coalesce("base", F.lit(-1)))
        return known.join(base, "bucket", "left").where(newer).select("kind", "n", "bucket")

    def rows(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table's rows, of some buckets or all, as they were before a batch or are now; only the files of those buckets are read."""
        parts = self.manifest(before)
        if buckets is not None:
            parts = parts.where(F.col("bucket").isin(buckets))
        read = [self.spark.createDataFrame([], self.schema).withColumns({"n": F.lit(0).cast("long")})]
        found = parts.collect()
        for kind in ("base", "delta"):
            paths = [f"{self.folder}/{kind}/n={r.n}/bucket={r.bucket}" for r in found if r.kind == kind]
            if paths:
                schema = StructType([*self.schema.fields, StructField("n", LongType()), StructField("bucket", IntegerType())])
                read.append(self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*paths).drop("bucket"))
        rows = read[0]
        for r in read[1:]:
            rows = rows.unionByName(r)
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*self.policy), "n").alias("r"))
        return newest.select(self.key, *[F.col(f"r.{c}").alias(c) for c in self.policy])

    def _write(self, kind: str, n: int, rows: DataFrame) -> None:
        path = f"{self.folder}/{kind}/n={n}"
        placed = rows.select(self.key, *self.policy, self._bucket().alias("bucket"))
        placed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        _, fs = self._path(path)
        # the folders that the write left, one per bucket
        names = [s.getPath().getName() for s in fs.listStatus(self._path(path)[0]) if s.isDirectory()]
        self._note(kind, n, sorted(int(x.removeprefix("bucket=")) for x in names if x.startswith("bucket=")))

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def upsert(self, batch: DataFrame, n: int, order: list[str], ties: list[str] | None = None) -> None:
        """Merge a batch; within it the last row per key by `order` counts, of equal ones the first by `ties`. n numbers batches upwards; the same batch again gives the same files."""
        last = latest(batch.where(F.col(self.key).isNotNull()), [self.key], [*[F.col(c).desc_nulls_last() for c in order], *[F.col(c).asc() for c in ties or []]]).select(self.key, *self.policy)
        last = last.persist()
        try:
            touched = [r.bucket for r in last.select(self._bucket().alias("bucket")).distinct().collect()]  # at most `buckets`
            known = self.rows(n, touched).join(last.select(self.key), self.key, "left_semi")
            merged = merge_fields(known, last, self.key, self.policy)
            self._write("delta", n, merged.where("action in ('created', 'updated')"))
        finally:
            last.unpersist()

    def compact(self, upto: int, least_deltas: int = 1) -> list[int]:
        """Write new base files, as of batch `upto`, for buckets with at least so many deltas; returns them. Older files stay for readers until vacuum."""
        counts = self.manifest(upto + 1).where("kind = 'delta'").groupBy("bucket").agg(F.count(F.lit(1)).alias("deltas"))
        due = sorted(r.bucket for r in counts.where(F.col("deltas") >= least_deltas).collect())
        if due:
            self._write("base", upto, self.rows(upto + 1, due))
        return due

    def vacuum(self, before: int) -> int:
        """Delete the files that no reader as of batch `before` or later needs; returns how many bucket folders went."""
        path, fs = self._path(f"{self.folder}/manifest")
        if not fs.exists(path):
            return 0
        needed = self.manifest(before).unionAll(self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest").where(F.col("n") >= before))
        gone = 0
        for r in self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest").distinct().join(needed, ["kind", "n", "bucket"], "left_anti").collect():
            path, fs = self._path(f"{self.folder}/{r.kind}/n={r.n}/bucket={r.bucket}")
            gone += bool(fs.delete(path, True))
        return gone
