"""Queries of search, markers, sources, sinks and vendor feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import markers, rollups, search
from ..sources import bodies, sheets, sinks
from .q_columns import sql_flags, sql_fold
from .registry import register
from .views import AS_OF

_NOW = lambda: F.expr(AS_OF)


def _norm(c: str) -> str:
    return f"trim(lower(regexp_replace({sql_fold(f'coalesce({c}, chr(32))')}, '[^a-zA-Z0-9]+', ' ', 'g')))"


def index(v):
    upcoming = rollups.upcoming(v("v_event"), ["venue_id"], _NOW()).select("venue_id", F.lit(True).alias("has_upcoming"))
    venues = v("v_venue").join(upcoming, "venue_id", "left")
    return search.build_index([
        search.index_entries(v("v_region"), "region", "region_id", "name", ["country"], priority=20, certified=F.col("certified")),
        search.index_entries(v("v_poi").where("publish_status = 'published' and category <> 'Concert'"), "poi", "poi_id", "name", ["category", "city", "state"], priority=F.when(F.col("certified"), 40).otherwise(80), certified=F.col("certified"), popularity=F.floor(F.col("rating") / 1000).cast("double")),
        search.index_entries(venues, "venue", "venue_id", "name", ["city", "state"], priority=60, upcoming=F.coalesce("has_upcoming", F.lit(False))),
        search.index_entries(v("v_artist").where("trim(name) <> ''"), "artist", "artist_id", "name", ["genre_text"], weight=F.floor(F.col("weight") / 10).cast("double")),
    ])


_UP = f"select distinct venue_id from {{v_event}} where start_ts >= {AS_OF}"
INDEX = f"""select 'region' as entity_type, region_id as entity_id, name, {_norm('name')} as nn, {_norm("concat_ws(' ', name, country)")} as st, 20.0::double as pr, 1.0::double as w, 0.0::double as pop, certified as cert, false as up from {{v_region}}
union all select 'poi', poi_id, name, {_norm('name')}, {_norm("concat_ws(' ', name, category, city, state)")}, case when certified then 40 else 80 end, 1.0, floor(rating / 1000), certified, false from {{v_poi}} where publish_status = 'published' and category <> 'Concert'
union all select 'venue', venue_id, name, {_norm('name')}, {_norm("concat_ws(' ', name, city, state)")}, 60, 1.0, 0.0, false, venue_id in (select venue_id from {{up}}) from {{v_venue}}
union all select 'artist', artist_id, name, {_norm('name')}, {_norm("concat_ws(' ', name, genre_text)")}, 100, floor(weight / 10), 0.0, false, false from {{v_artist}} where trim(name) <> ''"""
ASKED = ("Café household", "hall", "nation 7", "blue bolt", "music site nation", "")
_Q = ", ".join(f"({i}, '{q}')" for i, q in enumerate(ASKED))
HITS = f"""select *, round(s + case entity_type when 'region' then 70 else 0 end + case when cert then 55 else 0 end + case when up then 30 else 0 end + greatest(0.0, 100 - pr) + w * 10 + pop, 2) as score from (
select *, case when z = '' then 100.0 when nn = z then 1000.0 when starts_with(nn, z) then 800.0 when contains(nn, z) then 650.0 when contains(st, z) then 500.0 when len(list_filter(string_split(z, ' '), lambda t: not list_contains(string_split(st, ' '), t))) = 0 then 420.0 when contains(replace(st, ' ', ''), replace(z, ' ', '')) then 300.0 else 0.0 end::double as s
from (select i.*, q.n, q.query, {_norm('q.query')} as z from {{idx}} i cross join (values {_Q}) q(n, query))) where s > 0"""
register("j01_search_index", lambda v: index(v).select("entity_type", "entity_id", "normalized_name", F.md5("search_text").alias("text_md5"), "priority", "weight", "upcoming"), "select entity_type, entity_id, nn as normalized_name, md5(st) as text_md5, pr as priority, w as weight, up as upcoming from {idx}", up=_UP, idx=INDEX)
register("j04_search_batch", lambda v: search.search(index(v), list(ASKED), 15), "select query, rank, total, score, entity_type, entity_id, name from (select *, row_number() over (partition by n order by score desc, entity_type, lower(name), entity_id)::int as rank, count(*) over (partition by n) as total from {hits}) where rank <= 15", up=_UP, idx=INDEX, hits=HITS)
register("j05_suggestions", lambda v: search.suggest(index(v), ["hall", "ring"], 5), "select query, rank, entity_type || ':' || entity_id::varchar as ref, name from (select *, row_number() over (partition by n order by score desc, entity_type, lower(name), entity_id)::int as rank from {hits}) where rank <= 5", up=_UP, idx=INDEX, hits=HITS.replace(_Q, "(0, 'hall'), (1, 'ring')"))
register("c05_index_facets", lambda v: index(v).where("entity_type = 'poi' and certified").groupBy("priority").agg(F.count(F.lit(1)).alias("n")), "select pr as priority, count(*) as n from {idx} where entity_type = 'poi' and cert group by 1", up=_UP, idx=INDEX)


def _markers(v):
    at = v("v_venue").select("venue_id", "lat", "lng")
    return markers.union([
        markers.markers(v("v_event").join(at, "venue_id"), "event", "event_id", "title", F.lit("event"), F.col("start_ts"), _NOW()),
        markers.markers(v("v_poi"), "poi", "poi_id", "name", F.col("category")),
        markers.markers(v("v_venue"), "venue", "venue_id", "name", F.lit("venue")),
    ])


_STYLE = "case category " + " ".join(f"when '{a}' then '{b}'" for a, b, _ in markers.STYLES) + " else 'grey' end"
_ICON = "case category " + " ".join(f"when '{a}' then '{c}'" for a, _, c in markers.STYLES) + " else 'pin' end"
MARKERS = f"""select 'event' as kind, event_id as id, title as label, lat, lng, 'red' as color, 'star' as icon, coalesce(start_ts >= {AS_OF} - interval 12 hours, false) as upcoming from {{v_event}} join {{v_venue}} using (venue_id) where lat is not null and lng is not null
union all select 'poi', poi_id, name, lat, lng, {_STYLE}, {_ICON}, null from {{v_poi}} where lat is not null and lng is not null
union all select 'venue', venue_id, name, lat, lng, 'navy', 'stage', null from {{v_venue}} where lat is not null and lng is not null"""
register("b24_map_markers", _markers, MARKERS)
register("h02_markers_by_kind", lambda v: _markers(v).groupBy("kind", "color", "icon").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("upcoming", F.lit(False))).alias("upcoming")), "select kind, color, icon, count(*) as n, coalesce(count_if(upcoming), 0)::bigint as upcoming from {m} group by all", m=MARKERS)

# bodies that Spark derives from the events
PAGE = 1000  # ids of events that one body may hold
_LOCAL = "yyyyMMdd'T'HHmmss"


def _ics(v):
    event = F.concat(
        F.lit("BEGIN:VEVENT\r\nUID:"), F.col("event_id").cast("string"), F.lit("\r\nSUMMARY:The long\r\n  "), F.regexp_replace("title", ",", "\\\\,"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("\r\nDTSTART;VALUE=DATE:"), F.date_format("start_ts", "yyyyMMdd"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("\r\nDTSTART:"), F.date_format(F.expr("start_ts + interval 20 hours"), _LOCAL), F.lit("Z"))).otherwise(F.concat(F.lit("\r\nDTSTART;TZID=Asia/Tokyo:"), F.date_format(F.expr("start_ts + interval 20 hours"), _LOCAL))),
        F.lit("\r\nEND:VEVENT\r\n"),
    )
    rows = v("v_event").where("start_ts is not null").select("venue_id", F.floor(F.col("event_id") / PAGE).alias("page"), event.alias("e"))
    return rows.groupBy(F.col("venue_id").alias("key"), "page").agg(F.concat(F.lit("BEGIN:VCALENDAR\r\n"), F.array_join(F.collect_list("e"), ""), F.lit("END:VCALENDAR")).alias("body")).drop("page")


register("a06_ics_events", lambda v: bodies.ics_events(_ics(v)).select("key", F.col("uid").cast("long").alias("event_id"), "summary", F.col("starts").cast("string").alias("starts"), "all_day"),
         "select venue_id as key, event_id, trim('The long ' || title) as summary, (case event_id % 3 when 0 then start_ts when 1 then start_ts + interval 20 hours else start_ts + interval 11 hours end)::varchar as starts, event_id % 3 = 0 as all_day from {v_event} where start_ts is not null")


def _rss(v):
    item = F.concat(F.lit("<item><title>"), F.replace(F.col("title"), F.lit("&"), F.lit("&amp;")), F.lit("</title><link>https://x.example.com/"), F.col("event_id").cast("string"), F.lit("</link><description>"), F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("Doors open on "), F.date_format("start_ts", "MMMM d, yyyy"), F.lit(" at 8:30 pm"))).otherwise(F.lit("soon")), F.lit("</description><pubDate>Mon, 01 Jan 2001 00:00:00 GMT</pubDate></item>"))
    return v("v_event").where("start_ts is not null").groupBy(F.col("region_id").alias("key"), F.floor(F.col("event_id") / PAGE).alias("page")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("body")).drop("page")


register("a07_rss_items", lambda v: bodies.rss_items(_rss(v)).select("key", "title", "link", F.col("starts").cast("string").alias("starts"), "only_published"),
         "select region_id as key, trim(title) as title, 'https://x.example.com/' || event_id::varchar as link, (case when event_id % 4 > 0 then start_ts + interval 1230 minutes end)::varchar as starts, event_id % 4 = 0 as only_published from {v_event} where start_ts is not null and trim(title) <> ''")


register("a10_free_dates", lambda v: v("v_event").where("start_ts is not null").select("event_id", text.free_date(F.concat(F.lit("on "), F.when(F.col("event_id") % 4 == 0, F.date_format("start_ts", "M/d/yyyy")).when(F.col("event_id") % 4 == 1, F.date_format("start_ts", "MMMM d, yyyy")).when(F.col("event_id") % 4 == 2, F.date_format("start_ts", "d MMMM yyyy")).otherwise(F.date_format("start_ts", "yyyy-MM-dd")), F.lit(" in town"))).cast("string").alias("starts")),
         "select event_id, start_ts::varchar as starts from {v_event} where start_ts is not null")
register("a12_page_images", lambda v: bodies.page_images(v("v_image").select(F.col("image_id").alias("key"), F.concat(F.lit('<head><meta property="og:image" content="'), "url", F.lit('"><meta content="'), "url", F.lit('" name="twitter:image"></head>')).alias("body"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("urls")),
         "select s as source, count(*) as n, count(distinct url) as urls from {v_image} cross join (values ('og_image'), ('twitter_image')) t(s) group by 1")


def _vendor(v):
    event = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("title").alias("name"), F.struct(F.col("price").alias("minPrice")).alias("price")))
    shape = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("["), event, F.lit(","), event, F.lit("]"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"events":['), event, F.lit("]}"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"event":'), event, F.lit("}"))).otherwise(event)
    return v("v_event").select(F.col("event_id").alias("key"), F.when(F.col("event_id") % 101 == 0, "{broken").otherwise(shape).alias("body"))


register("a04_vendor_json", lambda v: bodies.json_records(_vendor(v)).select("key", F.col("position").cast("long").alias("position"), F.try_variant_get("record", "$.id", "bigint").alias("id"), F.try_variant_get("record", "$.name", "string").alias("name"), F.try_variant_get("record", "$.price.minPrice", "double").alias("price")),
         "select event_id as key, p as position, event_id as id, title as name, price from {v_event} cross join (values (0::bigint), (1::bigint)) t(p) where event_id % 101 > 0 and (p = 0 or event_id % 4 = 0)")
_SHEET = list(sheets.EVENT_FIELDS)


def _sheet(v):
    n = F.col("event_id")
    line = F.to_csv(F.struct(
        F.when(n % 11 == 0, "Sports").alias("c0"), "title", "headliner", F.date_format("start_ts", "yyyy-MM-dd").alias("c3"), F.lit("UTC").alias("c4"), "location_text", F.lit("Town").alias("c6"), F.when(n % 13 > 0, "TN").alias("c7"),
        F.when(n % 2 == 0, "calendar.example.com").alias("c8"), "tickets_link", F.when(n % 5 > 0, " 1 Way ").otherwise("").alias("c10"), F.lit("1,5").alias("c11"), F.lit(None).cast("string").alias("c12"),
        F.when(n % 7 == 0, "https://www.facebook.com/p.jpg").when(n % 7 == 1, "https://x.example.com/p.html").alias("c13"), F.when(n % 17 == 0, "https://a.example.com/1.png$https://www.instagram.com/p").alias("c14"),
    ), {"escape": '"'})
    return sheets.parse_lines(v("v_event").select("event_id", line.alias("line")), "line", _SHEET)


register("a01_event_sheet", lambda v: _sheet(v).select("event_id", F.array_join(sheets.event_sheet_errors(), ",").alias("errors")),
         "select event_id, " + sql_flags(("event_id % 11 = 0", "non_concert_category"), ("trim(title) = ''", "event_name_missing"), ("headliner is null", "headliner_missing"), ("start_ts is null", "start_date_missing"), ("event_id % 13 = 0", "state_missing"), ("event_id % 2 > 0 and coalesce(tickets_link, '') = ''", "event_or_ticket_url_missing"), ("event_id % 5 = 0", "venue_address_or_coordinates_missing"), ("event_id % 2 = 0", "event_url_not_full_url"), ("event_id % 7 = 0", "main_image_social_media_url"), ("event_id % 7 = 1", "main_image_not_direct_public_image"), ("event_id % 17 = 0", "additional_image_social_media_url"), sort=True) + " as errors from {v_event}")
register("a14_manifest", lambda v: sinks.manifest(sinks.feed_records(v("v_poi"), "poi", "poi_id", ["poi_id", "city"]).unionByName(sinks.feed_records(v("v_venue"), "venue", "venue_id", ["venue_id", "city"]))).select("kind", "records", "bytes"),
         """select kind, count(*) as records, sum(strlen(p))::bigint as bytes from (select 'poi' as kind, '{"poi_id":' || poi_id::varchar || ',"city":"' || city || '"}' as p from {v_poi} union all select 'venue', '{"venue_id":' || venue_id::varchar || ',"city":"' || city || '"}' from {v_venue}) group by 1""")
register("a16_report_rows", lambda v: rollups.metric_rows(v("v_event").groupBy("region_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("publish_status") == "published").alias("published")), ["region_id"]),
         "select region_id, 'events' as metric, count(*)::double as value from {v_event} group by 1 union all select region_id, 'published', count_if(publish_status = 'published')::double from {v_event} group by 1")
register("b25_search_results", lambda v: v("v_venue").select("venue_id", F.concat_ws(", ", text.clean("city"), text.clean("state")).alias("subtitle"), F.array_join(F.array_compact(F.array(F.when(F.col("lat").isNotNull(), "mapped"), F.when(F.col("zip").isNotNull(), "zip"))), " ").alias("badges"), F.concat(F.lit("/venues/"), F.col("venue_id").cast("string")).alias("url")),
         "select venue_id, city || ', ' || state as subtitle, concat_ws(' ', case when lat is not null then 'mapped' end, case when zip is not null then 'zip' end) as badges, '/venues/' || venue_id::varchar as url from {v_venue}")
register("b14_source_chain", lambda v: v("v_claim").groupBy("event_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "source_type", "provider"))).alias("c")).select("event_id", F.array_join("c", " > ").alias("chain"), F.size("c").cast("long").alias("n")), "select event_id, string_agg(distinct source_type || ':' || provider, ' > ' order by source_type || ':' || provider) as chain, count(distinct source_type || ':' || provider) as n from {v_claim} group by 1")
