"""Streams of files against their batch twins."""

import pytest

from gigledger.plans.views import view
from gigledger.sources.golden import GoldenTable
from gigledger.streaming import jobs
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def stream(spark, df, folder, files=4):
    df.repartition(files).write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(df, name, checkpoint, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


@pytest.fixture()
def attempts(spark):
    return view(spark, SF, "v_attempt").withColumn("created_at", F.col("created_at").cast("timestamp"))


def test_closed_windows_equal_the_batch(spark, attempts, tmp_path):
    late = "60 days"  # nothing is late, so every closed window is whole
    batch = {tuple(r) for r in jobs.intake(attempts, late=late).collect()}
    s = stream(spark, attempts, str(tmp_path / "a"))
    got = {tuple(r) for r in drain(jobs.intake(s, late=late), "intake", str(tmp_path / "c"), "update").collect()}
    assert batch <= got


def test_first_seen_keeps_one_row_per_key(spark, attempts, tmp_path):
    s = stream(spark, attempts, str(tmp_path / "a"))
    got = drain(jobs.first_seen(s, ["email"], "created_at", "60 days"), "seen", str(tmp_path / "c"))
    assert got.count() == attempts.select("email").distinct().count()


def test_running_health_equals_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    crawls = view(spark, SF, "v_crawl").select("source_id", "crawl_id", "status", "candidates").where("source_id < 20")
    crawls.coalesce(1).write.parquet(str(tmp_path / "a"))
    s = spark.readStream.schema(crawls.schema).parquet(str(tmp_path / "a"))
    got = sorted(tuple(r) for r in drain(jobs.source_health(s), "health", str(tmp_path / "c")).collect())
    assert got == sorted(tuple(r) for r in jobs.source_health_batch(crawls).collect())


POLICY = {"name": "fill", "score": "raise"}
SCHEMA = "k long, name string, score double"


def fold(batches):
    """The same merges over a dict."""
    golden = {}
    for rows in batches:
        last = {}
        for k, seq, name, score in sorted(rows, key=lambda r: r[1]):
            last[k] = (name, score)
        for k, (name, score) in last.items():
            old = golden.get(k)
            golden[k] = (name, score) if old is None else (old[0] or name or old[0], max(old[1], score))
    return golden


def test_continuous_upsert(spark, tmp_path):
    made = [(i % 5, i, f"n{i}" if i % 3 else "", float(i % 7)) for i in range(40)]
    rows = spark.createDataFrame(made, "k long, seq long, name string, score double")
    s = stream(spark, rows, str(tmp_path / "a"), 3)
    golden = GoldenTable(spark, str(tmp_path / "g"), "k", POLICY, SCHEMA, buckets=4)
    jobs.continuous_upsert(s, golden, ["seq"], str(tmp_path / "c"), compact_every=2, least_deltas=1).awaitTermination()
    got = golden.rows()
    assert got.count() == 5 and got.where("name is null or name = ''").count() == 0


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet") if "manifest" not in str(p)}


def test_golden_table_writes_only_touched_buckets(spark, tmp_path):
    batches = [
        [(i, i, f"n{i}", float(i)) for i in range(200)],
        [(3, 1, "other", 50.0), (3, 2, "other", 1.0), (7, 1, "", 0.0), (500, 1, None, 2.0)],
        [(3, 9, "", 60.0)],
        [(8, 1, "n8", 8.0)],  # changes nothing
        [(i, 1, "late", 300.0) for i in range(0, 200, 2)] + [(None, 1, "x", 1.0)],
    ]
    frame = lambda rows: spark.createDataFrame(rows, "k long, seq long, name string, score double")
    golden = GoldenTable(spark, str(tmp_path / "g"), "k", POLICY, SCHEMA, buckets=16)
    folder, states = tmp_path / "g", []
    for n, rows in enumerate(batches):
        before = files(folder)
        golden.upsert(frame(rows), n, ["seq"])
        after = files(folder)
        assert before.items() <= after.items()  # what was there is not touched
        new = {x.split("bucket=")[1].split("/")[0] for x in after.keys() - before.keys()}
        states.append({r.k: (r.name, r.score) for r in golden.rows().collect()})
        assert states[-1] == fold([[r for r in b if r[0] is not None] for b in batches[: n + 1]])
        if n == 1:
            assert 1 <= len(new) <= 2  # keys 3 and 500; 7 did not change
        if n == 3:
            assert not new
        if n == 2:
            due = golden.compact(2, least_deltas=2)
            assert due and len(due) < 16 and {r.k: (r.name, r.score) for r in golden.rows().collect()} == states[2]
    # a batch that runs again, also one before a compaction, leaves the same table
    for n in (2, 4, 4):
        golden.upsert(frame(batches[n]), n, ["seq"])
    assert {r.k: (r.name, r.score) for r in golden.rows().collect()} == states[-1]
    assert {r.k: (r.name, r.score) for r in golden.rows(before=3).collect()} == states[2]
    golden.compact(4)
    assert golden.manifest().where("kind = 'delta'").count() == 0 and golden.vacuum(5) > 0
    assert {r.k: (r.name, r.score) for r in golden.rows().collect()} == states[-1] and golden.vacuum(5) == 0


def test_half_written_batches_are_not_read(spark, tmp_path):
    golden = GoldenTable(spark, str(tmp_path / "g"), "k", POLICY, SCHEMA, buckets=4)
    assert golden.rows().count() == 0 and golden.compact(9) == [] and golden.vacuum(9) == 0
    golden.upsert(spark.createDataFrame([(1, 1, "a", 1.0)], "k long, seq long, name string, score double"), 0, ["seq"])
    lost = spark.createDataFrame([(1, "b", 9.0, 0)], SCHEMA + ", bucket int")
    lost.write.partitionBy("bucket").parquet(str(tmp_path / "g/delta/n=1"))  # no manifest names it
    assert [tuple(r) for r in golden.rows().collect()] == [(1, "a", 1.0)]
