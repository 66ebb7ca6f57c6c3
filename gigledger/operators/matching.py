"""Entity matching: priority keys, fallbacks and grid-blocked distance joins.

No join here compares all pairs: candidates meet through equal keys or neighbouring grid cells, and
the best one per row is a min, so that no row's candidates are gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import clean, dedupe_text, place_name, region_key, url_host
from ..sources.shared import cut


def keyed(rows: DataFrame, id_col: str, keys: list[tuple[str, Column]]) -> DataFrame:
    """(id, rank, strategy, key) for each key that is not null, in the order given."""
    made = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("strategy"), k.alias("key")) for i, (n, k) in enumerate(keys)])
    return rows.select(F.col(id_col).alias("id"), F.explode(made).alias("k")).select("id", "k.*").where("key is not null")


def priority_join(left: DataFrame, left_id: str, left_keys, right: DataFrame, right_id: str, right_keys, same: bool = False) -> DataFrame:
    """(left_id, right_id, strategy) of the first strategy that meets anything, then the smallest right id.

    The right side is reduced to its smallest id per key before the join (with same, to its two
    smallest, as a row then never meets itself), so a key that many rows share costs one row.
    """
    index = keyed(right, right_id, right_keys)
    if same:
        order = Window.partitionBy("strategy", "key").orderBy("id")
        index = index.select("strategy", "key", "id").distinct().withColumn("n", F.row_number().over(order)).where("n <= 2")
        index = index.groupBy("strategy", "key").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
        met = keyed(left, left_id, left_keys).join(index, ["strategy", "key"])
        met = met.withColumn("right_id", F.when(F.col("first_id") != F.col("id"), F.col("first_id")).otherwise(F.col("last_id"))).where("right_id <> id")
    else:
        met = keyed(left, left_id, left_keys).join(index.groupBy("strategy", "key").agg(F.min("id").alias("right_id")), ["strategy", "key"])
    best = met.groupBy("id").agg(F.min(F.struct("rank", "right_id", "strategy")).alias("b"))
    return best.select(F.col("id").alias(left_id), F.col("b.right_id").alias(right_id), F.col("b.strategy").alias("strategy"))


def poi_keys() -> list[tuple[str, Column]]:
    """Eight strategies of a place, strongest first."""
    name, spot = place_name("name"), F.concat_ws("|", F.lower("city"), F.lower("state"))
    host = F.regexp_extract("website", r"^https?://(?:www\.)?([^/:]+)", 1)
    named = F.when(name != "", name)
    at = F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.concat_ws("|", F.format_string("%.4f", "lat"), F.format_string("%.4f", "lng")))
    return [
        ("places_id", F.lower(clean("places_id"))),
        ("export_id", F.lower(clean("export_id"))),
        ("name_geo", F.concat(named, F.lit("|"), at)),
        ("website_city_state", F.when(host != "", F.concat(F.lower(host), F.lit("|"), spot))),
        ("phone_city_state", F.concat(F.regexp_replace(clean("phone"), "[^0-9]", ""), F.lit("|"), spot)),
        ("name_address", F.concat(named, F.lit("|"), place_name(clean("address")))),
        ("name_city_state", F.concat(named, F.lit("|"), spot)),
        ("name_state", F.concat(named, F.lit("|"), F.lower("state"))),
    ]


def near_pairs(left: DataFrame, right: DataFrame, metres: float, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, distance) of all pairs at most so far apart, met in grid cells.

    Both sides have lat and lng; rows without them meet nothing. Cells are so wide at each latitude
    that no pair is lost, and meet across the date line and the poles.
    """
    size = geo.cell_size(metres, geo.METRES)
    a = left.where("lat is not null and lng is not null").select(F.col(left_id).alias("a_id"), F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"), F.explode(geo.neighbours("lat", "lng", size)).alias("c")).select("a_id", "a_lat", "a_lng", "c.cy", "c.cx")
    b = right.where("lat is not null and lng is not null").select(F.col(right_id).alias("b_id"), F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"), geo.cell("lat", "lng", size).alias("c")).select("b_id", "b_lat", "b_lng", "c.cy", "c.cx")
    met = a.join(b, ["cy", "cx"]).withColumn("distance", geo.haversine("a_lat", "a_lng", "b_lat", "b_lng")).where(F.col("distance") <= metres)
    return met.select(F.col("a_id").alias(left_id), F.col("b_id").alias(right_id), "distance")


def nearest(left: DataFrame, right: DataFrame, metres: float, left_id: str, right_id: str) -> DataFrame:
    """The nearest right row within the distance; ties to the smaller id.

    Both sides meet by their distinct points: a point where thousands of rows lie is one row of the join.
    """
    points = right.groupBy("lat", "lng").agg(F.min(right_id).alias(right_id))
    asked = left.where("lat is not null and lng is not null").select("lat", "lng").distinct().withColumn("_at", F.struct("lat", "lng"))
    best = near_pairs(asked, points, metres, "_at", right_id).groupBy("_at").agg(F.min(F.struct("distance", right_id)).alias("b"))
    best = best.select(F.col("_at.lat").alias("lat"), F.col("_at.lng").alias("lng"), F.col(f"b.{right_id}").alias(right_id), F.col("b.distance").alias("distance"))
    return left.select(left_id, "lat", "lng").join(best, ["lat", "lng"]).select(left_id, right_id, "distance")


def region_by_place(places: DataFrame, regions: DataFrame, place_id: str) -> DataFrame:
    """(place_id, region_id, confidence): same city, state and country first (.95), then same state and country of wide regions (.72).

    Blank parts are the key 'unknown' and only meet another blank. Among equals the smallest region.
    """
    state, country = region_key("state"), region_key("country")
    wide = regions.where(F.col("region_type").isin("state", "metro", "certified")).select(region_key("state").alias("s"), region_key("country").alias("c"), "region_id").groupBy("s", "c").agg(F.min("region_id").alias("wide_id"))
    exact = regions.select(region_key("city").alias("t"), region_key("state").alias("s"), region_key("country").alias("c"), "region_id").groupBy("t", "s", "c").agg(F.min("region_id").alias("exact_id"))
    found = places.select(place_id, region_key("city").alias("t"), state.alias("s"), country.alias("c")).join(exact, ["t", "s", "c"], "left").join(wide, ["s", "c"], "left")
    confidence = F.when(F.col("exact_id").isNotNull(), 0.95).when(F.col("wide_id").isNotNull(), 0.72)
    return found.select(place_id, F.coalesce("exact_id", "wide_id").alias("region_id"), confidence.alias("confidence"))


def nearest_region(places: DataFrame, regions: DataFrame, place_id: str, largest_miles: float) -> DataFrame:
    """(place_id, region_id, distance, confidence) of the nearest region whose own radius (radius_miles) holds the place.

    Regions meet places in cells of the largest radius; confidence is 1 - .4 d / r within .5 and .9.
    """
    pairs = near_pairs(places, regions, largest_miles * geo.METRES / geo.MILES, place_id, "region_id").join(regions.select("region_id", "radius_miles"), "region_id")
    pairs = pairs.withColumn("distance", F.col("distance") * geo.MILES / geo.METRES).where("distance <= radius_miles")
    best = pairs.groupBy(place_id).agg(F.min(F.struct("distance", "region_id", "radius_miles")).alias("b")).select(place_id, "b.*")
    return best.select(place_id, "region_id", "distance", F.greatest(F.lit(0.5), F.least(F.lit(0.9), 1 - 0.4 * F.col("distance") / F.col("radius_miles"))).alias("confidence"))


def assign_regions(places: DataFrame, regions: DataFrame, place_id: str, least: float, largest_miles: float) -> DataFrame:
    """Region by place where its confidence reaches the least, else by distance."""
    by_place = region_by_place(places, regions, place_id).where(F.col("confidence") >= least).withColumn("how", F.lit("place"))
    rest = places.join(by_place, place_id, "left_anti")
    by_distance = nearest_region(rest, regions, place_id, largest_miles).where(F.col("confidence") >= least).select(place_id, "region_id", "confidence", F.lit("distance").alias("how"))
    return by_place.unionByName(by_distance)


def _named_places(pois: DataFrame) -> DataFrame:
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return pois.where("lat is not null and lng is not null").select("poi_id", "lat", "lng", "website", "phone", place_name("name").alias("n"), low("city").alias("city"), low("state").alias("state")).where("n <> ''")


def poi_pairs(pois: DataFrame, medium: float = 50.0, weak: float = 100.0) -> DataFrame:
    """(a, b, confidence, distance) of places with one name, city and state: near ones medium, a bit farther ones with a common website or phone weak.

    Pairs meet by name and grid cell, so a name that is everywhere still only meets its neighbours
    and no block is too large to look at.
    """
    size = geo.cell_size(weak, geo.METRES)
    base = _named_places(pois)
    a = base.select(*[F.col(c).alias(f"a_{c}") for c in ("poi_id", "lat", "lng", "website", "phone")], "n", "city", "state", F.explode(geo.neighbours("lat", "lng", size)).alias("c")).select("*", "c.cy", "c.cx").drop("c")
    b = base.withColumn("c", geo.cell("lat", "lng", size)).select("*", "c.cy", "c.cx").drop("c")
    met = a.join(b, ["n", "city", "state", "cy", "cx"]).where("a_poi_id < poi_id").withColumn("distance", geo.haversine("a_lat", "a_lng", "lat", "lng"))
    contact = F.coalesce((F.col("a_website") == F.col("website")) & (F.col("website") != ""), F.lit(False)) | F.coalesce((F.col("a_phone") == F.col("phone")) & (F.col("phone") != ""), F.lit(False))
    confidence = F.when(F.col("distance") <= medium, "medium").when((F.col("distance") <= weak) & contact, "weak")
    return met.select(F.col("a_poi_id").alias("a"), F.col("poi_id").alias("b"), confidence.alias("confidence"), "distance").where("confidence is not null")


def poi_pair_counts(pois: DataFrame, medium: float = 50.0, weak: float = 100.0) -> DataFrame:
    """(confidence, n, first_a): how many pairs poi_pairs has of each confidence, and the smallest a among them; no pair of rows is made.

    Places of one name, city and state at one point are one row with their number; points meet in
    grid cells, once. Weak pairs are those with a common website and those with a common phone, less
    those with both, each met by that key at two points that lie so far apart. Pairs of rows with
    one id are taken off again.
    """
    size, name = geo.cell_size(weak, geo.METRES), ["n", "city", "state"]
    base = cut(_named_places(pois).where("poi_id is not null"))
    spots = base.select(*name, "lat", "lng").distinct()
    points = spots.select("lat", "lng").distinct()
    cells = points.select("lat", "lng", geo.cell("lat", "lng", size).alias("c")).select("lat", "lng", "c.cy", "c.cx")
    around = points.select("lat", "lng", F.explode(geo.neighbours("lat", "lng", size)).alias("c")).select(F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"), "c.cy", "c.cx")
    left = spots.withColumnsRenamed({"lat": "a_lat", "lng": "a_lng"}).join(around, ["a_lat", "a_lng"])
    met = left.join(spots.join(cells, ["lat", "lng"]), [*name, "cy", "cx"]).where(F.struct("a_lat", "a_lng") <= F.struct("lat", "lng"))
    met = met.select(*name, "a_lat", "a_lng", "lat", "lng", geo.haversine("a_lat", "a_lng", "lat", "lng").alias("distance"))
    met = cut(met.where(F.col("distance") <= weak).withColumn("near", F.col("distance") <= medium).drop("distance"))

    def counted(rows: DataFrame, also: list[str], near: bool, sign: int) -> DataFrame:
        for c in also:
            rows = rows.where(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
        held = rows.groupBy(*name, *also, "lat", "lng").agg(F.count(F.lit(1)).alias("k"), F.min("poi_id").alias("lo"), F.max("poi_id").alias("hi"))
        a = held.withColumnsRenamed({c: f"a_{c}" for c in ("lat", "lng", "k", "lo", "hi")})
        both = a.join(met.where(F.col("near") == near), [*name, "a_lat", "a_lng"]).join(held, [*name, *also, "lat", "lng"])
        one = (F.col("a_lat") == F.col("lat")) & (F.col("a_lng") == F.col("lng"))
        pairs = F.when(one, F.shiftright(F.col("k") * (F.col("k") - 1), 1)).otherwise(F.col("a_k") * F.col("k")) * sign
        lo, hi = F.least("a_lo", "lo"), F.greatest("a_hi", "hi")
        return both.select(F.lit("medium" if near else "weak").alias("confidence"), pairs.alias("pairs"), F.when(lo < hi, lo).alias("a"))

    parts = [(base, [], 1)]
    repeated = base.groupBy("poi_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("poi_id")
    if not repeated.isEmpty():
        parts.append((base.join(repeated, "poi_id", "left_semi"), ["poi_id"], -1))
    found = []
    for rows, own, sign in parts:
        found += [counted(rows, own, True, sign), counted(rows, [*own, "website"], False, sign), counted(rows, [*own, "phone"], False, sign), counted(rows, [*own, "website", "phone"], False, -sign)]
    out = reduce(DataFrame.unionByName, found)
    return out.groupBy("confidence").agg(F.sum("pairs").alias("n"), F.min("a").alias("first_a")).where("n > 0")


def _similar(x: Column, y: Column, least: float) -> Column:
    close = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1)) >= least
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x) | close)


def _two_smallest(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """The two smallest distinct ids of each key: rows of their own, so that one may be left out and no group is gathered."""
    order = Window.partitionBy(*keys).orderBy(id_col)
    return rows.select(*keys, id_col).distinct().withColumn("_n", F.row_number().over(order)).where("_n <= 2").drop("_n")


def similar_places(candidates: DataFrame, pois: DataFrame, id_col: str, poi_id: str, metres: float = 50.0, least: float = 0.82, same: bool = False) -> DataFrame:
    """(id, poi_id, confidence, strategy): the place with the smallest id that has a similar name and is near (medium), or shares city, state and web domain or phone (weak).

    Both have name, lat, lng, city, state, website, phone; places of the concert category don't
    count where pois have a category. With same, a row never meets the row of its own id. Rows meet
    as distinct names and points: names are compared once per pair that shares a neighbourhood, a
    thousand rows of one name at one point are one row of the join, and per group the two smallest
    ids are enough. Rows without a name meet nothing.
    """
    if "category" in pois.columns:
        pois = pois.where(F.lower(F.coalesce("category", F.lit(""))) != "concert")
    host = F.regexp_extract(F.lower(F.coalesce("website", F.lit(""))), r"^https?://(?:www\.)?([^/:?#]+)", 1)
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    side = lambda d, i, name: d.select(F.col(i).alias(name), place_name("name").alias("n"), "lat", "lng", low("city").alias("city"), low("state").alias("state"), F.nullif(host, F.lit("")).alias("domain"), clean("phone").alias("phone")).where("n <> ''")
    left, right = side(candidates, id_col, "id"), side(pois, poi_id, "other")
    size = geo.cell_size(metres, geo.METRES)

    spots = left.where("lat is not null and lng is not null").select("n", "lat", "lng").distinct()
    around = spots.select("n", "lat", "lng", F.explode(geo.neighbours("lat", "lng", size)).alias("c")).select("n", "lat", "lng", "c.cy", "c.cx")
    there = _two_smallest(right.where("lat is not null and lng is not null"), ["n", "lat", "lng"], "other").withColumn("c", geo.cell("lat", "lng", size))
    there = there.select(F.col("n").alias("y"), F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"), "other", "c.cy", "c.cx")
    names = around.select("cy", "cx", "n").distinct().join(there.select("cy", "cx", "y").distinct(), ["cy", "cx"]).select("n", "y").distinct().where(_similar(F.col("n"), F.col("y"), least))
    met = around.join(names, "n").join(there, ["cy", "cx", "y"]).where(geo.haversine("lat", "lng", "b_lat", "b_lng") <= metres)
    near = left.join(_two_smallest(met, ["n", "lat", "lng"], "other"), ["n", "lat", "lng"]).select("id", "other", F.lit(0).alias("tier"))

    parts = [near]
    for tier, contact in ((1, "domain"), (2, "phone")):
        key = ["city", "state", contact]
        held = _two_smallest(right.where(F.col(contact).isNotNull()), [*key, "n"], "other").withColumnRenamed("n", "y")
        asked = left.where(F.col(contact).isNotNull()).select(*key, "n").distinct()
        known = asked.join(held.select(*key, "y").distinct(), key).where(_similar(F.col("n"), F.col("y"), least)).join(held, [*key, "y"])
        parts.append(left.join(_two_smallest(known, [*key, "n"], "other"), [*key, "n"]).select("id", "other", F.lit(tier).alias("tier")))
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    if same:
        found = found.where("id <> other")
    best = found.groupBy("id").agg(F.min(F.struct("other", "tier")).alias("b"))
    strategy = F.element_at(F.array(F.lit("similar_name_nearby_geo"), F.lit("same_name_city_state_domain"), F.lit("same_name_city_state_phone")), F.col("b.tier") + 1)
    return best.select(F.col("id").alias(id_col), F.col("b.other").alias(poi_id), F.when(F.col("b.tier") == 0, "medium").otherwise("weak").alias("confidence"), strategy.alias("strategy"))


def match_events(candidates: DataFrame, events: DataFrame, claims: DataFrame) -> DataFrame:
    """(candidate_id, event_id, score, reason) in the order claim key 1.0, event key .96, title and day with venue .86, without venue .74, in conflict .58.

    candidates: candidate_id, claim_key, event_key, title, start_ts, venue; events: event_id,
    event_key, title, start_ts, venue; claims: claim_key, event_id. A title is compared normalised,
    a start by its day. Among equals the smallest event; without a match score is 0.
    """
    by_claim = claims.where("event_id is not null").groupBy("claim_key").agg(F.min("event_id").alias("claimed"))
    by_key = events.groupBy("event_key").agg(F.min("event_id").alias("keyed"))
    day = lambda d: d.select("*", dedupe_text("title").alias("t"), F.to_date("start_ts").alias("d"), dedupe_text("venue").alias("w"))
    found = candidates.join(by_claim, "claim_key", "left").join(by_key, "event_key", "left")
    rest = day(found.where("claimed is null and keyed is null")).where("t <> ''").select("candidate_id", "t", "d", "w")
    # one row per title, day and venue on both sides: a copy of a thousand rows meets others once
    side = day(events).where("t <> ''").groupBy("t", "d", "w").agg(F.min("event_id").alias("event_id"))
    wanted = rest.select("t", "d", "w").distinct().join(side.withColumnRenamed("w", "ew"), ["t", "d"])
    tier = F.when((F.col("w") != "") & (F.col("w") == F.col("ew")), 0).when((F.col("w") == "") | (F.col("ew") == ""), 1).otherwise(2)
    best = wanted.groupBy("t", "d", "w").agg(F.min(F.struct(tier.alias("tier"), "event_id")).alias("b"))
    fuzzy = rest.join(best, ["t", "d", "w"]).select("candidate_id", "b.*")
    out = found.join(fuzzy, "candidate_id", "left")
    reason = F.when(F.col("claimed").isNotNull(), "claim").when(F.col("keyed").isNotNull(), "event_key").when(F.col("tier") == 0, "title_day_venue").when(F.col("tier") == 1, "title_day").when(F.col("tier") == 2, "title_day_conflict").otherwise("none")
    score = F.lit(0.0)
    for name, value in (("title_day_conflict", 0.58), ("title_day", 0.74), ("title_day_venue", 0.86), ("event_key", 0.96), ("claim", 1.0)):
        score = F.when(reason == name, value).otherwise(score)
    return out.select("candidate_id", F.coalesce("claimed", "keyed", "event_id").alias("event_id"), score.alias("score"), reason.alias("reason"))


def listed(rows: DataFrame, entries: DataFrame, id_col: str, email: str = "email", domain: str = "domain") -> DataFrame:
    """Ids of rows whose email, email domain or URL domain is on a list of (kind, value)."""
    values = F.array(
        F.struct(F.lit("email").alias("kind"), F.lower(email).alias("value")),
        F.struct(F.lit("domain").alias("kind"), F.lower(F.substring_index(email, "@", -1)).alias("value")),
        F.struct(F.lit("domain").alias("kind"), F.lower(domain).alias("value")),
    )
    return rows.select(id_col, F.explode(values).alias("x")).select(id_col, "x.kind", "x.value").join(entries, ["kind", "value"], "left_semi").select(id_col).distinct()


def path_matches(submitted: DataFrame, known: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(id, known_id): for each submitted URL the smallest known one of its host at the same path, above it or below it.

    Both sides meet in one table of paths: a submitted path looks for its own ancestors among the
    known paths, and every known path is entered, with its smallest id, under each of its ancestors.
    A URL costs its depth on either side, whatever its host has.
    """
    url = lambda d: d.select(F.col(id_col).alias("id"), url_host(url_col).alias("host"), F.regexp_replace(F.regexp_extract(url_col, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", "").alias("path"))
    above = lambda: F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))
    index = url(known).groupBy("host", "path").agg(F.min("id").alias("known_id"))
    at = index.select("host", "path", "known_id", F.lit(False).alias("below"))
    # an entry under an ancestor is met by the submitted path itself, one at its own path by all descendants
    below = index.select("host", F.explode(above()).alias("path"), "known_id").groupBy("host", "path").agg(F.min("known_id").alias("known_id")).withColumn("below", F.lit(True))
    asked = url(submitted).withColumn("steps", above())
    asked = asked.select("id", "host", F.posexplode("steps").alias("depth", "step"), F.size("steps").alias("n")).select("id", "host", F.col("step").alias("path"), (F.col("depth") == F.col("n") - 1).alias("own"))
    met = asked.join(at.unionByName(below), ["host", "path"]).where("own or not below")
    return met.groupBy("id").agg(F.min("known_id").alias("known_id")).withColumnRenamed("id", id_col)
