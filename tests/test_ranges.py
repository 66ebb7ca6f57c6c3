"""Ranges of a sequence: their number grows with the rows, so that none does."""

from pyspark.sql import functions as F

from gigledger.operators import sweep


def test_more_rows_make_more_ranges_not_longer_ones(spark, monkeypatch):
    monkeypatch.setattr(sweep, "RANGE", 50)
    rows = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    dealt = sweep.ranged(rows, ["k"], ["id"])
    assert dealt.rdd.getNumPartitions() == 20
    assert dealt.groupBy(sweep.PART).count().agg(F.max("count")).first()[0] <= 100
    summed = sweep.running_sums(dealt, ["k"], ["id"], {"n": F.lit(1)})
    assert {(r.k, r.id): r.n for r in summed.collect()} == {(i % 2, i): i // 2 + 1 for i in range(1000)}


def test_next_rows_are_found_once_before_the_steps_are_dealt(spark, monkeypatch):
    seen, cut = [], sweep.cut
    monkeypatch.setattr(sweep, "cut", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    rows = spark.range(50).selectExpr("id", "cast(id % 3 as string) as k", "cast(id % 4 as string) as v", "timestamp_seconds(id * 60) as ts")
    measures = [sweep.LookBack("n", "k", 600), sweep.LookBack("others", "k", 600, value="v")]
    assert sweep.look_backs(rows, "id", "ts", measures).count() == 50
    assert "lead(" not in seen[-1] and sum("lead(" in p for p in seen) == 1
