"""Search index and ranked search for many queries at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_text

# Points of an entry's type.
TYPE_POINTS = (("region", 70), ("itinerary", 45), ("search_seed", 25))


def index_entries(rows: DataFrame, entity_type: str, id_col: str, name: str, more: list[str], priority=100, weight=1.0, popularity=0.0, ready=False, certified=False, upcoming=False) -> DataFrame:
    """Rows of one kind in the index's common shape; the last options are columns or constants."""
    c = lambda x: x if not isinstance(x, (bool, int, float)) else F.lit(x)
    return rows.select(
        F.lit(entity_type).alias("entity_type"),
        F.col(id_col).cast("long").alias("entity_id"),
        F.col(name).alias("name"),
        search_text(name).alias("normalized_name"),
        search_text(F.concat_ws(" ", name, *more)).alias("search_text"),
        c(priority).cast("double").alias("priority"),
        c(weight).cast("double").alias("weight"),
        c(popularity).cast("double").alias("popularity"),
        c(ready).alias("ready"),
        c(certified).alias("certified"),
        c(upcoming).alias("upcoming"),
    )


def build_index(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def text_score(name, text, query):
    """1000 equal, 800 prefix, 650 in the name, 500 in the text, 420 all words, 300 without spaces, 100 empty query, else 0."""
    squeeze = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    return (
        F.when(query == "", 100.0)
        .when(name == query, 1000.0)
        .when(name.startswith(query), 800.0)
        .when(name.contains(query), 650.0)
        .when(text.contains(query), 500.0)
        .when(F.size(F.array_except(F.split(query, " "), F.split(text, " "))) == 0, 420.0)
        .when(squeeze(text).contains(squeeze(query)), 300.0)
        .otherwise(0.0)
    )


def scored(index: DataFrame, queries: list[str]) -> DataFrame:
    """The index's rows with n, query and score, for each of a stated list of queries that they answer.

    The queries travel with every index row as one small array: no join with the index.
    """
    asked = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(q).alias("query")) for i, q in enumerate(dict.fromkeys(queries))])
    rows = index.select("*", F.explode(asked).alias("q")).select("*", "q.n", "q.query").withColumn("wanted", search_text("query"))
    text = text_score(F.col("normalized_name"), F.col("search_text"), F.col("wanted"))
    points = F.lit(0.0)
    for name, value in TYPE_POINTS:
        points = F.when(F.col("entity_type") == name, float(value)).otherwise(points)
    more = lambda c, p: F.when(F.col(c), float(p)).otherwise(0.0)
    score = text + points + more("ready", 40) + more("certified", 55) + more("upcoming", 30) + F.greatest(F.lit(0.0), 100 - F.col("priority")) + F.col("weight") * 10 + F.col("popularity")
    return rows.withColumn("text_score", text).where("text_score > 0").withColumn("score", F.round(score, 2))


def search(index: DataFrame, queries: list[str], limit: int = 20, offset: int = 0) -> DataFrame:
    """(query, rank, total, score, entity_type, entity_id, name) of a stated list of queries, best first.

    Ranks are cut per task before they are compared; totals come from a count of their own, which
    scores the index a second time.
    """
    hits = scored(index, queries)
    totals = hits.groupBy("n").agg(F.count(F.lit(1)).alias("total"))
    order = Window.partitionBy("n").orderBy(F.col("score").desc(), "entity_type", F.lower("name"), "entity_id")
    page = hits.withColumn("rank", F.row_number().over(order)).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
    return page.join(totals, "n").select("query", "rank", "total", "score", "entity_type", "entity_id", "name")


def suggest(index: DataFrame, queries: list[str], limit: int = 8) -> DataFrame:
    found = search(index, queries, limit)
    return found.select("query", "rank", F.concat_ws(":", "entity_type", F.col("entity_id").cast("string")).alias("ref"), "name")


# Words in a place's subcategory that make a seed's type, and types of regions that seeds keep.
SEED_WORDS = (("festival", "festival"), ("airport", "airport"), ("stadium", "stadium"))
REGION_SEEDS = ("city", "metro", "state", "country", "tourism_board")
LAUNCHED = ("ready", "launched")


def poi_seeds(pois: DataFrame) -> DataFrame:
    """Search seeds of places: (seed_key, name, normalized_name, seed_type, region_id, lat, lng, priority, weight, popularity, app) of poi_id, name, category, subcategory, lat, lng, rating; app (shown in the app) is null, as an editor decides it."""
    category, sub = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("category", "subcategory"))
    kind = F.when((category == "music site") & (sub == "venues"), "venue").otherwise("poi")
    for word, name in reversed(SEED_WORDS):
        hit = sub.contains(word) | category.contains(word) if word == "airport" else sub.contains(word)
        kind = F.when(hit, name).otherwise(kind)
    region = F.col("region_id").cast("long") if "region_id" in pois.columns else F.lit(None).cast("long")
    return pois.select(
        F.concat(F.lit("poi:"), F.col("poi_id").cast("string")).alias("seed_key"), "name", search_text("name").alias("normalized_name"), kind.alias("seed_type"), region.alias("region_id"), "lat", "lng",
        F.when(kind == "venue", 30).otherwise(60).alias("priority"), F.when(kind == "venue", 1.5).otherwise(1.0).alias("weight"), F.coalesce(F.col("rating").cast("double"), F.lit(0.0)).alias("popularity"), F.lit(None).cast("boolean").alias("app"),
    )


def region_seeds(regions: DataFrame) -> DataFrame:
    """Search seeds of regions in the same columns, of region_id, region_key, name, region_type, certified, launch_status, lat, lng; certified ones come first."""
    kind = F.when(F.col("region_type").isin(*REGION_SEEDS), F.col("region_type")).otherwise("unknown")
    sure = F.coalesce("certified", F.lit(False))
    return regions.select(
        F.concat(F.lit("region:"), "region_key").alias("seed_key"), "name", search_text("name").alias("normalized_name"), kind.alias("seed_type"), F.col("region_id").cast("long").alias("region_id"), "lat", "lng",
        F.when(sure, 10).otherwise(20).alias("priority"), F.when(sure, 3.0).otherwise(2.0).alias("weight"), F.when(sure, 100.0).otherwise(50.0).alias("popularity"), F.coalesce(F.col("launch_status").isin(*LAUNCHED), F.lit(False)).alias("app"),
    )


def upsert_seeds(known: DataFrame, seeds: DataFrame) -> DataFrame:
    """The seed table after an update, with action: created, updated, or kept (no seed came for it).

    A seed takes all values of the incoming one; where that leaves open whether the app shows it,
    the known choice stays, and a new one is not shown. Keys must be unique on either side; the
    same update again creates nothing.
    """
    columns = [c for c in seeds.columns if c != "seed_key"]
    both = known.alias("k").join(seeds.alias("s"), "seed_key", "full")
    new, old = F.col("k.name").isNull() & F.col("k.priority").isNull(), F.col("s.priority").isNull()
    value = lambda c: F.coalesce(F.col("s.app"), F.col("k.app"), F.lit(False)) if c == "app" else F.when(old, F.col(f"k.{c}")).otherwise(F.col(f"s.{c}"))
    return both.select("seed_key", *[value(c).alias(c) for c in columns], F.when(old, "kept").when(new, "created").otherwise("updated").alias("action"))
