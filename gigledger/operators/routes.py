"""Routes: positions and segments of their stops, their quality, and the feed of those that are ready."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import MILES, haversine
from ..functions.text import flags, is_blank
from .sweep import PART, ranged, running_sums, with_next


def positioned(stops: DataFrame, route: str, order: list[str], lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Adds stop_order (from 1 within the route), to_stop (the next stop's last order column, null at the end), to_lat and to_lng.

    order must be total within a route. A route may span tasks: positions are running sums over
    ranges of stops, and the last stop of a range meets the first of the next.
    """
    dealt = ranged(stops, [route], order)
    placed = running_sums(dealt, [route], order, {"stop_order": F.lit(1)})
    return with_next(placed, [route], order, {"to_stop": order[-1], "to_lat": lat, "to_lng": lng}).drop(PART)


def legs(lat: str = "lat", lng: str = "lng") -> dict[str, Column]:
    """Columns of a leg to the next stop: miles (1 decimal), minutes at 28 mph, walking minutes at 3 mph up to 3 miles, at least one minute each, and both as texts; null without both places."""
    miles = F.round(haversine(lat, lng, "to_lat", "to_lng", MILES), 1)
    drive = F.greatest(F.lit(1), F.bround(miles / 28 * 60).cast("long"))
    walk = F.when(miles <= 3, F.greatest(F.lit(1), F.bround(miles / 3 * 60).cast("long")))
    hours, rest = F.floor(drive / 60), drive % 60
    text = F.when(drive < 60, F.concat(drive.cast("string"), F.lit(" min drive"))).when(rest == 0, F.concat(hours.cast("string"), F.lit(" hr drive"))).otherwise(F.concat(hours.cast("string"), F.lit(" hr "), rest.cast("string"), F.lit(" min drive")))
    known = miles.isNotNull()
    return {"miles": miles, "drive_minutes": F.when(known, drive), "walk_minutes": walk, "drive_text": F.when(known, text), "walk_text": F.concat(walk.cast("string"), F.lit(" min walk"))}


def segments(stops: DataFrame, route: str, order: list[str], lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Consecutive stops of a route with segment_order (from 1), to_stop and the columns of legs."""
    placed = positioned(stops, route, order, lat, lng).where("to_stop is not null")
    return placed.withColumnRenamed("stop_order", "segment_order").withColumns(legs(lat, lng))


def route_feed(routes: DataFrame, stops: DataFrame, order: list[str]) -> DataFrame:
    """(route_id, kind, ordinal, stop_id, to_stop, title, lat, lng, image_url, miles, drive_minutes, walk_minutes, drive_text, walk_text) of the routes that are ready: one row per stop and per segment.

    routes are those of route_quality, stops need its columns, order, title, lat and lng, too; the
    last order column is the stop's id. A logo is not shown as an image. Nothing is gathered per route.
    """
    ready = route_quality(routes, stops).where("feed_ready").select("route_id")
    placed = positioned(stops.join(ready, "route_id", "left_semi"), "route_id", order)
    image = F.when(F.lower(F.coalesce("image_url", F.lit(""))).contains("logo"), "").otherwise(F.coalesce("image_url", F.lit("")))
    stop = F.struct(F.lit("stop").alias("kind"), F.col("title").alias("title"), image.alias("image_url"), *[F.lit(None).cast(k).alias(n) for n, k in (("to_stop", dict(placed.dtypes)[order[-1]]), ("miles", "double"), ("drive_minutes", "long"), ("walk_minutes", "long"), ("drive_text", "string"), ("walk_text", "string"))])
    leg = F.struct(F.lit("segment").alias("kind"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("image_url"), F.col("to_stop"), *[F.col(n) for n in legs()])
    rows = placed.withColumns(legs()).select("route_id", F.col("stop_order").alias("ordinal"), F.col(order[-1]).alias("stop_id"), "lat", "lng", F.explode(F.when(F.col("to_stop").isNull(), F.array(stop)).otherwise(F.array(stop, leg))).alias("x"))
    return rows.select("route_id", "x.kind", "ordinal", "stop_id", "x.to_stop", "x.title", "lat", "lng", "x.image_url", "x.miles", "x.drive_minutes", "x.walk_minutes", "x.drive_text", "x.walk_text")


def route_quality(routes: DataFrame, stops: DataFrame) -> DataFrame:
    """(route_id, quality, route_flags, feed_ready) of routes from their stops.

    routes: route_id, title, status, hero_image_url, route_type, region_id, artist_id; stops:
    route_id, poi_id, located (boolean), image_url, event_excluded (boolean). Stops cost 8 without a
    location, 3 without an image, 20 with a logo or an excluded event; a place that stops twice
    costs 12 once. Stops are counted per route and place first, so a long route is no large group.
    """
    logo = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains("logo")
    per_place = stops.groupBy("route_id", "poi_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.coalesce("located", F.lit(False))).alias("lost"),
        F.count_if(is_blank("image_url")).alias("bare"),
        F.count_if(logo("image_url")).alias("logos"),
        F.count_if("event_excluded").alias("excluded"),
    )
    per_route = per_place.groupBy("route_id").agg(
        *[F.sum(c).alias(c) for c in ("n", "lost", "bare", "logos", "excluded")], F.bool_or((F.col("n") > 1) & F.col("poi_id").isNotNull()).alias("twice")
    )
    r = routes.join(per_route, "route_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    ready = F.col("status").isin("approved", "published")
    rules = (
        (is_blank("title"), "missing_title", 25),
        (n("n") < 2, "too_few_stops", 25),
        (~F.coalesce(ready, F.lit(False)), "not_approved_or_published", 10),
        (is_blank("hero_image_url"), "missing_hero_image", 8),
        (logo("hero_image_url"), "logo_asset_image", 40),
        (F.coalesce("twice", F.lit(False)), "duplicate_poi_stops", 12),
        (F.col("route_type").isin("regional", "city") & F.col("region_id").isNull(), "missing_region", 12),
        ((F.col("route_type") == "artist_tour") & F.col("artist_id").isNull(), "missing_artist", 12),
    )
    cost = sum((F.when(c, p).otherwise(0) for c, _, p in rules), F.lit(0)) + 8 * n("lost") + 3 * n("bare") + 20 * n("logos") + 20 * n("excluded")
    out = r.withColumns({"quality": F.greatest(F.lit(0), F.least(F.lit(100), 100 - cost)).cast("long"), "route_flags": flags(*[(c, f) for c, f, _ in rules])})
    return out.select("route_id", "quality", "route_flags", (F.coalesce(ready, F.lit(False)) & (F.col("quality") >= 70)).alias("feed_ready"))
