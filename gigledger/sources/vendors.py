"""Vendor events into one schema, by a table of rules that is compiled into columns.

A rule names a vendor, a field and JSON paths in the order in which they count. What paths cannot
say (a lineup, the best of several ticket links, a price) has a rule of its own kind. A new vendor is a new
set of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, flags, price_text, trimmed
from ..operators.tickets import is_usable, link_class

#: The common schema: field and type.
FIELDS = (
    ("provider_event_id", "string"), ("event_name", "string"), ("description", "string"), ("event_status", "string"), ("start_datetime", "string"), ("end_datetime", "string"), ("timezone", "string"), ("doors_time", "string"), ("all_day", "boolean"),
    ("headliner", "string"), ("supporting_artists", "string"), ("provider_artist_id", "string"), ("provider_genre", "string"), ("venue_name", "string"), ("venue_address", "string"), ("city", "string"), ("state", "string"), ("zip_code", "string"), ("country", "string"), ("latitude", "double"), ("longitude", "double"),
    ("provider_venue_id", "string"), ("event_url", "string"), ("tickets_link", "string"), ("ticket_class", "string"), ("price", "string"), ("main_image_url", "string"), ("upstream_source", "string"), ("upstream_id", "string"),
)
# The vendors' keys, in the order in which they count. [] stands for every element of a list, the first text counts.
RULES = {
    "performer_feed": {
        "provider_event_id": ("$.identifier",), "event_name": ("$.name", '$["x-customTitle"]'), "description": ("$.description", '$["x-subtitle"]'), "event_status": ("$.eventStatus",), "start_datetime": ("$.startDate",), "end_datetime": ("$.endDate",),
        "timezone": ('$.location.address["x-timezone"]',), "doors_time": ("$.doorTime",), "headliner": "lead", "supporting_artists": "support", "provider_artist_id": "lead_id", "provider_genre": ("$.performer[].genre[0]",),
        "venue_name": ("$.location.name",), "venue_address": ("$.location.address.streetAddress",), "city": ("$.location.address.addressLocality",), "state": ("$.location.address.addressRegion.alternateName", "$.location.address.addressRegion.identifier", "$.location.address.addressRegion.name"),
        "zip_code": ("$.location.address.postalCode",), "country": ("$.location.address.addressCountry.identifier", "$.location.address.addressCountry.alternateName", "$.location.address.addressCountry.name"), "latitude": ("$.location.geo.latitude", "$.location.geo.lat"), "longitude": ("$.location.geo.longitude", "$.location.geo.lng"),
        "provider_venue_id": ("$.location.identifier",), "event_url": ("$.url",), "tickets_link": "offers", "price": "offer_price", "main_image_url": ("$.image", "$.image[]", '$["x-promoImage"]'), "upstream_source": ('$["x-externalIdentifiers"][].source',), "upstream_id": ('$["x-externalIdentifiers"][].identifier',),
    },
    "licensed_feed": {
        "provider_event_id": ("$.eventId",), "event_name": ("$.name",), "description": ("$.description", "$.summary"), "start_datetime": ("$.instances[].start", "$.start"), "end_datetime": ("$.instances[].end", "$.end"), "all_day": ("$.allDay",),
        "provider_genre": ("$.labels[0]", "$.categories[].name"), "venue_name": ("$.location.locationName",), "venue_address": ("$.location.address",), "city": ("$.location.city",), "state": ("$.location.state",), "country": ("$.location.country",),
        "latitude": ("$.location.latitude",), "longitude": ("$.location.longitude",), "event_url": ("$.url",), "tickets_link": "links", "price": "own_price", "main_image_url": ("$.primaryImage.largeImageUrl", "$.primaryImage.mediumImageUrl", "$.primaryImage.smallImageUrl"),
    },
    "generic": {
        "provider_event_id": ("$.provider_event_id", "$.event_id", "$.id"), "event_name": ("$.event_name", "$.name", "$.title"), "description": ("$.description", "$.summary"), "event_status": ("$.event_status", "$.eventStatus"), "start_datetime": ("$.start_datetime", "$.startDateTime", "$.startDate", "$.start", "$.date"),
        "end_datetime": ("$.end_datetime", "$.endDateTime", "$.end"), "timezone": ("$.timezone", "$.timeZone", "$.tz"), "doors_time": ("$.doors_time", "$.doorTime"), "all_day": ("$.all_day", "$.allDay"), "headliner": ("$.headliner", "$.performer", "$.artist.name", "$.artist"), "supporting_artists": ("$.supporting_artists", "$.support"),
        "provider_artist_id": ("$.provider_artist_id", "$.artist_id"), "provider_genre": ("$.provider_genre", "$.genre"), "venue_name": ("$.venue_name", "$.venue.name", "$.venue"), "venue_address": ("$.venue_address", "$.address", "$.venue.address"), "city": ("$.city", "$.venue.city"), "state": ("$.state", "$.venue.state"),
        "zip_code": ("$.zip_code", "$.postal_code", "$.zip", "$.venue.postal_code", "$.venue.zip"), "country": ("$.country", "$.venue.country"), "latitude": ("$.latitude", "$.lat", "$.venue.geo.lat"), "longitude": ("$.longitude", "$.lng", "$.lon", "$.venue.geo.lng", "$.venue.geo.lon"), "provider_venue_id": ("$.provider_venue_id", "$.venue_id"),
        "event_url": ("$.event_url", "$.eventUrl", "$.url"), "tickets_link": "own_link", "price": ("$.price",), "main_image_url": ("$.main_image_url", "$.image", "$.image_url", "$.imageUrl"), "upstream_source": ("$.upstream_event_source", "$.upstreamSource", "$.dataSource"), "upstream_id": ("$.upstream_event_id", "$.upstreamEventId", "$.external_event_id"),
    },
}


def _list(v: Column, path: str) -> Column:
    """A list of variants; one object alone is a list of one; no list where there is nothing."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.when(F.coalesce(F.try_variant_get(v, path, "string").startswith("{"), F.lit(False)), F.array(F.try_variant_get(v, path, "variant"))), F.array().cast("array<variant>"))


def _scalar(v: Column, path: str) -> Column:
    """The text at a path; an object or a list is no text."""
    return F.get(F.regexp_extract_all(F.try_variant_get(v, path, "string"), F.lit(r"(?s)\A *([^\[{ ](?:.*[^ ])?) *\z"), F.lit(1)), 0)


def path_text(v: Column, path: str) -> Column:
    """The text at a path; with [], of the first element that has one."""
    head, every, rest = path.partition("[]")
    return F.get(F.array_compact(F.transform(_list(v, head), lambda x: path_text(x, "$" + rest))), 0) if every else _scalar(v, path)


def _link(candidates: Column) -> Column:
    """The best of (url, priority), as (worse, priority, url, category): the first that is usable, else the first there is."""
    classed = lambda c: bind(link_class(c["url"]), lambda a: F.struct((~is_usable(a["category"], a["repair"])).alias("worse"), c["priority"].alias("priority"), c["url"].alias("url"), a["category"].alias("category")))
    return F.get(F.array_sort(F.transform(F.filter(candidates, lambda c: c["url"].isNotNull()), classed)), 0)


def _lineup(v: Column) -> Column:
    """Struct (lead, lead_id, support) of the performers that have a name; the first marked one leads, else the first."""
    people = F.transform(_list(v, "$.performer"), lambda p: F.struct(_scalar(p, "$.name").alias("name"), _scalar(p, "$.identifier").alias("id"), F.coalesce(F.try_variant_get(p, '$["x-isHeadliner"]', "boolean"), F.lit(False)).alias("marked")))

    def lineup(named: Column) -> Column:
        others = lambda lead: trimmed(F.array_join(F.transform(F.filter(named, lambda p: p["name"] != lead["name"]), lambda p: p["name"]), ", "))
        return bind(F.coalesce(F.get(F.filter(named, lambda p: p["marked"]), 0), F.get(named, 0)), lambda lead: F.struct(lead["name"].alias("lead"), lead["id"].alias("lead_id"), others(lead).alias("support")))

    return bind(F.filter(people, lambda p: p["name"].isNotNull()), lineup)


def _special(v: Column, kind: str) -> Column:
    """What a rule of its own kind reads; offers and links are those of _link."""
    offers = _list(v, "$.offers")

    def price(o: Column, at: str) -> Column:
        parts = F.struct(F.try_variant_get(o, f"{at}.minPrice", "double").alias("low"), F.try_variant_get(o, f"{at}.maxPrice", "double").alias("high"), _scalar(o, f"{at}.priceCurrency").alias("currency"))
        return trimmed(bind(parts, lambda p: price_text(p["low"], p["high"], p["currency"])))

    if kind == "offers":
        rank = lambda o, i: bind(_scalar(o, "$.category"), lambda k: F.when(k == "ticketingLinkPrimary", i).when(k == "ticketingLinkSecondary", i + 100).otherwise(i + 10))
        return _link(F.transform(offers, lambda o, i: F.struct(_scalar(o, "$.url").alias("url"), rank(o, i).alias("priority"))))
    if kind == "offer_price":
        return F.get(F.filter(F.transform(offers, lambda o: price(o, "$.priceSpecification")), lambda p: p.isNotNull()), 0)
    if kind == "own_price":
        return price(v, "$.price")
    if kind == "links":
        more = F.filter(_list(v, "$.links"), lambda x: F.lower(F.coalesce(_scalar(x, "$.linkType"), F.lit(""))).contains("ticket"))
        more = F.transform(more, lambda x, i: F.struct(_scalar(x, "$.linkUrl").alias("url"), (i + 1).alias("priority")))
        return _link(F.concat(F.array(F.struct(_scalar(v, "$.ticketUrl").alias("url"), F.lit(0).alias("priority"))), more))
    if kind == "own_link":
        return F.coalesce(*[_scalar(v, f"$.{k}") for k in ("tickets_link", "ticket_url", "ticketUrl", "tickets")])
    raise ValueError(f"no rule of the kind {kind}")


def compiled(records: DataFrame, vendor: str, key: str, record: str) -> DataFrame:
    """(key, the common schema) of one vendor's records; a field without a rule is null. What several fields are read from is a column first, computed once."""
    rules, v = RULES[vendor], F.col(record)
    ranked = rules["tickets_link"] in ("offers", "links")
    held = records.select(key, record, _lineup(v).alias("_lineup"), _special(v, rules["tickets_link"]).alias("_ticket"))
    link, kind_of_link = (F.col("_ticket.url"), F.coalesce("_ticket.category", F.lit("blank"))) if ranked else (F.col("_ticket"), link_class(F.col("_ticket"))["category"])
    made = []
    for field, kind in FIELDS:
        rule = rules.get(field)
        if field in ("ticket_class", "tickets_link"):
            made.append((link if field == "tickets_link" else kind_of_link).alias(field))
        elif rule is None:
            made.append(F.lit(None).cast(kind).alias(field))
        elif rule in ("lead", "lead_id", "support"):
            made.append(F.col(f"_lineup.{rule}").alias(field))
        else:
            value = _special(v, rule) if isinstance(rule, str) else F.coalesce(*[path_text(v, p) for p in rule])
            made.append((value.try_cast(kind) if kind != "string" else value).alias(field))
    return held.select(key, *made)


def vendor_events(records: DataFrame, vendor: str, key: str = "key", record: str = "record") -> DataFrame:
    """(key, the common schema, normalization_status, completeness, relevance, dedupe_key) of a table of variant records of one vendor.

    status is failed without a name or a start, partial without a headliner or a venue, else
    normalized; completeness is the percentage of COMPLETE that a record fills; relevance is 90 where
    name or description speak of music, else 72; dedupe_key hashes vendor, id, name, start and place. A null
    record gives a row without values.
    """
    out = compiled(records, vendor, key, record)
    has = lambda c: F.col(c).isNotNull()
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    status = F.when(~has("event_name") | ~has("start_datetime"), "failed").when(~has("headliner") | ~has("venue_name"), "partial").otherwise("normalized")
    said = F.lower(F.concat_ws(" ", "event_name", "description"))
    basis = F.concat_ws("|", F.lit(vendor), F.coalesce("provider_event_id", F.lit("")), low("event_name"), F.coalesce("start_datetime", F.lit("")), low("venue_name"), low("city"), low("state"))
    return out.withColumns({
        "normalization_status": status,
        "completeness": F.round(sum((has(c).cast("int") for c in COMPLETE), F.lit(0)) * 100 / len(COMPLETE), 2),
        "relevance": F.when(said.rlike("|".join(MUSIC_WORDS)), 90.0).otherwise(72.0),
        "dedupe_key": F.sha2(basis, 256),
    })


# Fields that make a record complete, and words of music.
COMPLETE = ("event_name", "headliner", "start_datetime", "venue_name", "city", "state", "tickets_link", "main_image_url")
MUSIC_WORDS = ("concert", "music", "live", "band", "artist")

# Genres that say nothing, and the relevance of a segment.
NO_GENRE = ("undefined", "miscellaneous", "other")
RELEVANCE = (("music", 94.0), ("other", 25.0), ("missing", 45.0))


def classification(v: Column) -> Column:
    """Struct (segment, provider_genre, provider_subgenre, music_category, normalized_genre, relevance, flags) of a record's classifications.

    The first object of a list of classifications counts, or the one there is, or the record
    itself. A node's name is its name, segment, genre, subgenre or subGenre. The sub-genre is the
    normalised genre, unless it says nothing, then the genre.
    """
    listed = F.filter(_list(v, "$.classifications"), lambda x: F.coalesce(F.try_variant_get(x, "$", "string").startswith("{"), F.lit(False)))
    node = lambda first, key: F.coalesce(*[_scalar(first, f"$.{key}.{n}") for n in ("name", "segment", "genre", "subgenre", "subGenre")])
    nodes = lambda first: F.struct(node(first, "segment").alias("segment"), node(first, "genre").alias("genre"), F.coalesce(node(first, "subGenre"), node(first, "subgenre")).alias("sub"))
    return bind(bind(F.coalesce(F.get(listed, 0), v), nodes), lambda n: _classified(n["segment"], n["genre"], n["sub"]))


def _classified(segment: Column, genre: Column, sub: Column) -> Column:
    music = F.lower(segment) == "music"
    points = dict(RELEVANCE)
    useful = lambda c: F.when(~F.lower(c).isin(*NO_GENRE), c)
    return F.struct(
        segment.alias("segment"), genre.alias("provider_genre"), sub.alias("provider_subgenre"), F.when(music, "Music").alias("music_category"), F.coalesce(useful(sub), useful(genre)).alias("normalized_genre"),
        F.when(music, points["music"]).when(segment.isNotNull(), points["other"]).otherwise(points["missing"]).alias("relevance"),
        flags((music, "music_segment"), (segment.isNotNull() & ~music, "non_music_segment"), (segment.isNotNull() & ~music, "low_event_relevance"), (segment.isNull(), "segment_missing")).alias("flags"),
    )
