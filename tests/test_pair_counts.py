"""Counts of pairs of places without the pairs."""

import random

from pyspark.sql import functions as F

from gigledger.operators import matching

SCHEMA = "poi_id long, name string, lat double, lng double, city string, state string, website string, phone string"


def test_counts_equal_the_pairs_even_with_repeated_ids(spark):
    r = random.Random(4)
    rows = [(r.choice([i, i, r.randrange(40)]), r.choice(["Café A", "cafe a", "B", ""]), 10 + r.randrange(5) * 0.0003, r.choice([None, 20 + r.randrange(4) * 0.0004]), r.choice("xy"), r.choice([None, "s"]), r.choice([None, "", "u", "v"]), r.choice([None, "", "1", "2"])) for i in range(150)]
    places = spark.createDataFrame(rows, SCHEMA)
    for made in (places, places.dropDuplicates(["poi_id"]), places.limit(0)):
        want = {x.confidence: (x.n, x.a) for x in matching.poi_pairs(made).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a")).collect()}
        assert {x.confidence: (x.n, x.first_a) for x in matching.poi_pair_counts(made).collect()} == want


def test_a_hundred_thousand_places_at_two_points(spark):
    point = F.col("id") % 2 * 0.0006
    rows = spark.range(100_000).select(F.col("id").alias("poi_id"), F.lit("Hall").alias("name"), (10 + point).alias("lat"), F.lit(20.0).alias("lng"), F.lit("x").alias("city"), F.lit("s").alias("state"), F.lit("u").alias("website"), F.lit("1").alias("phone"))
    got = {x.confidence: (x.n, x.first_a) for x in matching.poi_pair_counts(rows).collect()}
    assert got == {"medium": (50_000 * 49_999, 0), "weak": (50_000 * 50_000, 0)}
