"""An export keeps compressed feeds and snapshots alone."""

import glob

from pyspark.sql import functions as F

from gigledger.sources import snapshots


def test_an_export_keeps_no_second_copy_of_its_records(spark, tmp_path):
    rows = snapshots.records(spark.range(50).select("id", F.lit("n").alias("name")), "poi", "id", F.struct("id", "name"))
    assert snapshots.export(rows, str(tmp_path), "pois", "1", "2026-01-01 00:00:00")
    assert not snapshots.export(rows.withColumn("id", F.raise_error(F.lit("no"))), str(tmp_path), "pois", "2", "2026-01-02 00:00:00")
    assert glob.glob(f"{tmp_path}/records/*") == []
    assert glob.glob(f"{tmp_path}/feed/export_id=1/kind=poi/*.gz") and not glob.glob(f"{tmp_path}/feed/export_id=1/kind=poi/*.txt")
    held = snapshots.snapshot(spark, str(tmp_path), "pois")
    assert sorted(tuple(r) for r in held.collect()) == sorted(tuple(r) for r in rows.select("kind", "id", "hash").collect())
