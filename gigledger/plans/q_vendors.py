"""Queries of vendor records: three shapes mapped into one schema, and their classifications. The records are derived from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import vendors
from ..sources.shared import spread
from .q_columns import sql_flags
from .registry import register


def _rows(v):
    return v("v_event").join(v("v_venue").select("venue_id", "name", "city", "state", "country", "zip", "lat", "lng"), "venue_id", "left")


def _json(*pairs):
    return F.to_json(F.struct(*[c.alias(n) for n, c in pairs]))


def _performer_feed():
    """The first vendor: performers with a marked headliner in every third record, two offers, an upstream id."""
    n = F.col("event_id")
    s = F.struct
    performer = lambda name, lead, at: s(F.concat(F.lit("a"), n.cast("string"), F.lit(at)).alias("identifier"), name.alias("name"), F.array(F.col("genre")).alias("genre"), lead.alias("x-isHeadliner"))
    offer = lambda kind, url: s(F.lit(kind).alias("category"), url.alias("url"), s(F.when(n % 3 > 0, (n % 50).cast("double")).alias("minPrice"), F.lit(60.0).alias("maxPrice"), F.lit("USD").alias("priceCurrency")).alias("priceSpecification"))
    return _json(
        ("identifier", F.concat(F.lit("p"), n.cast("string"))), ("name", F.col("title")), ("x-customTitle", F.lit("Custom")), ("startDate", F.date_format("start_ts", "yyyy-MM-dd'T'20:00:00")), ("eventStatus", F.col("event_status")), ("url", F.col("source_url")), ("image", F.col("image_url")),
        ("location", s(F.col("venue_id").cast("string").alias("identifier"), F.col("name").alias("name"), s(F.col("lat").alias("latitude"), F.col("lng").alias("longitude")).alias("geo"), s(F.lit("1 Way").alias("streetAddress"), F.col("city").alias("addressLocality"), s(F.when(n % 2 == 0, "ST").alias("alternateName"), F.col("state").alias("name")).alias("addressRegion"), F.col("zip").alias("postalCode"), s(F.col("country").alias("identifier")).alias("addressCountry"), F.lit("UTC").alias("x-timezone")).alias("address"))),
        ("performer", F.array(performer(F.lit("Opener"), F.lit(False), "x"), performer(F.col("headliner"), n % 3 == 0, "y"))),
        ("offers", F.array(offer("ticketingLinkSecondary", F.lit("https://tickets.example.com/event/second")), offer("ticketingLinkPrimary", F.col("tickets_link")))),
        ("x-externalIdentifiers", F.when(n % 5 == 0, F.array(s(F.lit("other").alias("source"), n.cast("string").alias("identifier"))))),
    )


def _licensed_feed():
    n, s = F.col("event_id"), F.struct
    return _json(
        ("eventId", n), ("name", F.col("title")), ("summary", F.lit("In short")), ("primaryImage", s(F.when(n % 2 == 0, F.col("image_url")).alias("largeImageUrl"), F.lit("https://img.example.com/small.jpg").alias("smallImageUrl"))), ("labels", F.when(n % 4 == 0, F.array(F.col("genre")))), ("categories", F.array(s(F.lit(7).alias("id"), F.lit("Live").alias("name")))),
        ("location", s(F.col("name").alias("locationName"), F.col("city").alias("city"), F.col("state").alias("state"), F.col("country").alias("country"), F.col("lat").alias("latitude"), F.col("lng").alias("longitude"))), ("instances", F.when(n % 3 == 0, F.array(s(F.date_format("start_ts", "yyyy-MM-dd'T'19:00:00").alias("start"))))), ("start", F.date_format("start_ts", "yyyy-MM-dd")), ("allDay", n % 3 > 0),
        ("price", s(F.lit(5.0).alias("minPrice"), F.when(n % 2 == 0, F.lit(5.0)).alias("maxPrice"), F.lit("EUR").alias("priceCurrency"))), ("ticketUrl", F.when(n % 6 > 0, F.col("tickets_link"))), ("url", F.col("source_url")), ("links", F.array(s(F.lit("Website").alias("linkType"), F.lit("https://w.example.com").alias("linkUrl")), s(F.lit("TicketPage").alias("linkType"), F.lit("https://tickets.example.com/event/late").alias("linkUrl")))),
    )


def _generic():
    n, s = F.col("event_id"), F.struct
    nested = _json(("id", n), ("title", F.col("title")), ("date", F.date_format("start_ts", "yyyy-MM-dd")), ("artist", s(F.col("headliner").alias("name"))), ("venue", s(F.col("name").alias("name"), F.col("city").alias("city"), s(F.col("lat").alias("lat"), F.col("lng").alias("lon")).alias("geo"))), ("ticketUrl", F.col("tickets_link")), ("imageUrl", F.col("image_url")), ("price", F.lit("free")))
    flat = _json(("event_id", n), ("event_name", F.col("title")), ("start_datetime", F.date_format("start_ts", "yyyy-MM-dd HH:mm")), ("headliner", F.col("headliner")), ("venue", F.col("name")), ("city", F.col("city")), ("lat", F.col("lat")), ("lng", F.col("lng")), ("tickets", F.col("tickets_link")), ("image", F.col("image_url")), ("genre", F.col("genre")))
    return F.when(n % 2 == 0, nested).otherwise(flat)


VENDORS = (("performer_feed", _performer_feed), ("licensed_feed", _licensed_feed), ("generic", _generic))


def _mapped(v):
    rows = spread(_rows(v))
    out = None
    for vendor, make in VENDORS:
        records = rows.select(F.col("event_id").alias("key"), F.try_parse_json(make()).alias("record"))
        mapped = vendors.vendor_events(records, vendor).withColumn("vendor", F.lit(vendor))
        out = mapped if out is None else out.unionByName(mapped)
    return out


_E = "select e.*, w.name as w_name, w.city, w.state, w.country, w.zip, w.lat, w.lng from {v_event} e left join {v_venue} w using (venue_id)"
_T = "nullif(trim({0}), '')"
_FIRST = f"""select event_id as key, 'performer_feed' as vendor, 'p' || event_id::varchar as provider_event_id, coalesce({_T.format('title')}, 'Custom') as event_name, strftime(start_ts, '%Y-%m-%dT20:00:00') as start_datetime, null::boolean as all_day,
 case when headliner is not null and event_id % 3 = 0 then headliner else 'Opener' end as headliner, case when event_id % 3 = 0 and headliner is not null then 'Opener' else headliner end as supporting_artists, 'a' || event_id::varchar || case when event_id % 3 = 0 and headliner is not null then 'y' else 'x' end as provider_artist_id,
 genre as provider_genre, {_T.format('w_name')} as venue_name, case when event_id % 2 = 0 then 'ST' else state end as state, zip as zip_code, lat as latitude, venue_id::varchar as provider_venue_id,
 case when event_id % 3 > 0 then case when event_id % 50 = 60 then '60.00 USD' else printf('%.2f', (event_id % 50)::double) || '-60.00 USD' end else 'up to 60.00 USD' end as price, image_url as main_image_url, case when event_id % 5 = 0 then event_id::varchar end as upstream_id from {{e}}"""
_SECOND = f"""select event_id, 'licensed_feed', event_id::varchar, {_T.format('title')}, case when event_id % 3 = 0 then coalesce(strftime(start_ts, '%Y-%m-%dT19:00:00'), strftime(start_ts, '%Y-%m-%d')) else strftime(start_ts, '%Y-%m-%d') end, event_id % 3 > 0, null, null, null,
 case when event_id % 4 = 0 and genre is not null then genre else 'Live' end, {_T.format('w_name')}, state, null, lat, null, case when event_id % 2 = 0 then '5.00 EUR' else 'from 5.00 EUR' end, case when event_id % 2 = 0 and image_url is not null then image_url else 'https://img.example.com/small.jpg' end, null from {{e}}"""
_THIRD = f"""select event_id, 'generic', event_id::varchar, {_T.format('title')}, case when event_id % 2 = 0 then strftime(start_ts, '%Y-%m-%d') else strftime(start_ts, '%Y-%m-%d %H:%M') end, null, headliner, null, null, case when event_id % 2 > 0 then genre end, {_T.format('w_name')}, null, null, lat, null, case when event_id % 2 = 0 then 'free' end, image_url, null from {{e}}"""
_COLUMNS = ("key", "vendor", "provider_event_id", "event_name", "start_datetime", "all_day", "headliner", "supporting_artists", "provider_artist_id", "provider_genre", "venue_name", "state", "zip_code", "latitude", "provider_venue_id", "price", "main_image_url", "upstream_id", "normalization_status")
register(
    "b12_vendor_mapper",
    lambda v: _mapped(v).select(*_COLUMNS),
    f"select *, case when event_name is null or start_datetime is null then 'failed' when headliner is null or venue_name is null then 'partial' else 'normalized' end as normalization_status from ({_FIRST} union all {_SECOND} union all {_THIRD})",
    e=_E,
)
# the link that each vendor's record leads to
_LINKS = """select event_id as key, 'performer_feed' as vendor, case when l like 'https://tickets.example.com/%' then l else 'https://tickets.example.com/event/second' end as tickets_link from (select event_id, nullif(trim(tickets_link), '') as l from {v_event})
union all select event_id, 'licensed_feed', case when event_id % 6 > 0 and l like 'https://tickets.example.com/%' then l else 'https://tickets.example.com/event/late' end from (select event_id, nullif(trim(tickets_link), '') as l from {v_event})
union all select event_id, 'generic', nullif(trim(tickets_link), '') from {v_event}"""
register("b12_vendor_ticket_links", lambda v: _mapped(v).select("key", "vendor", "tickets_link"), _LINKS)

_GENRES = ("Rock", "Undefined", "Jazz", "Other", "Miscellaneous")


def _classified(v):
    n, s = F.col("event_id"), F.struct
    pick = lambda k: F.element_at(F.array(*[F.lit(g) for g in _GENRES]), ((n / k).cast("long") % len(_GENRES) + 1).cast("int"))
    segment = F.when(n % 3 == 0, s(F.lit("KZ").alias("id"), F.lit("Music").alias("name"))).when(n % 3 == 1, s(F.lit("KS").alias("id"), F.lit("Sports").alias("name")))
    one = s(segment.alias("segment"), s(pick(1).alias("name")).alias("genre"), s(pick(5).alias("name")).alias("subGenre"))
    shape = F.when(n % 4 == 0, F.to_json(s(F.array(one).alias("classifications")))).when(n % 4 == 1, F.to_json(s(one.alias("classifications")))).when(n % 4 == 2, F.to_json(one)).otherwise(F.concat(F.lit('{"classifications":[7,"x",'), F.to_json(one), F.lit("]}")))
    return spread(v("v_event")).select("event_id", F.try_parse_json(shape).alias("record"))


_G = "['" + "', '".join(_GENRES) + "']"
_SQL_CLASS = f"select event_id, case event_id % 3 when 0 then 'Music' when 1 then 'Sports' end as segment, {_G}[(event_id % 5 + 1)::int] as g, {_G}[((event_id // 5) % 5 + 1)::int] as s from {{v_event}}"
_USEFUL = "case when lower({0}) not in ('undefined', 'miscellaneous', 'other') then {0} end"
register(
    "b11_vendor_classification",
    lambda v: _classified(v).select("event_id", vendors.classification(F.col("record")).alias("c")).select("event_id", "c.segment", "c.provider_genre", "c.provider_subgenre", "c.music_category", "c.normalized_genre", "c.relevance", F.array_join("c.flags", ",").alias("flags")),
    f"""select event_id, segment, g as provider_genre, s as provider_subgenre, case when segment = 'Music' then 'Music' end as music_category, coalesce({_USEFUL.format('s')}, {_USEFUL.format('g')}) as normalized_genre, case segment when 'Music' then 94.0 when 'Sports' then 25.0 else 45.0 end::double as relevance,
 {sql_flags(("segment = 'Music'", "music_segment"), ("segment = 'Sports'", "non_music_segment"), ("segment = 'Sports'", "low_event_relevance"), ("segment is null", "segment_missing"))} as flags from {{c}}""",
    c=_SQL_CLASS,
)
_FILL = "round(((coalesce(event_name, '') <> '')::int + (headliner is not null)::int + (start_datetime is not null)::int + (venue_name is not null)::int + (city is not null)::int + (st is not null)::int + (link is not null)::int + (main_image_url is not null)::int) * 100 / 8.0, 2)::double"
_WHOLE = f"select f.*, case f.vendor when 'performer_feed' then f.state when 'licensed_feed' then e.state end as st, e.city as city, k.tickets_link as link from (select * from ({_FIRST} union all {_SECOND} union all {_THIRD})) f join {{e}} e on e.event_id = f.key join {{links}} k on k.key = f.key and k.vendor = f.vendor"
register(
    "i07_record_completeness",
    lambda v: _mapped(v).select("key", "vendor", "normalization_status", "completeness", "relevance", "dedupe_key"),
    f"""select key, vendor, case when event_name is null or start_datetime is null then 'failed' when headliner is null or venue_name is null then 'partial' else 'normalized' end as normalization_status, {_FILL} as completeness,
 case when regexp_matches(lower(coalesce(event_name, '')), 'concert|music|live|band|artist') then 90.0 else 72.0 end::double as relevance,
 sha256(concat_ws('|', vendor, provider_event_id, lower(coalesce(event_name, '')), coalesce(start_datetime, ''), lower(coalesce(venue_name, '')), lower(coalesce(city, '')), lower(coalesce(st, '')))) as dedupe_key from {{whole}}""",
    e=_E, links=_LINKS, whole=_WHOLE,
)
