"""Rows of a batch that are equal by its order: the first by the tie columns counts."""

from gigledger.sources.golden import GoldenTable


def test_of_equal_rows_the_first_by_the_ties_counts(spark, tmp_path):
    golden = GoldenTable(spark, str(tmp_path), "k", {"a": "replace"}, "k long, a string", buckets=2)
    batch = spark.createDataFrame([(1, "last", 7, 3), (1, "first", 7, 1), (1, "former", 6, 0), (2, "x", 7, 9), (1, "mid", 7, 2)], "k long, a string, c long, place long")
    golden.upsert(batch.repartition(3), 0, ["c"], ["place"])
    assert sorted(tuple(r) for r in golden.rows().collect()) == [(1, "first"), (2, "x")]
