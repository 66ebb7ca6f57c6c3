"""Queries of joins, matching, deduplication and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import genres, matching, upsert, windows
from .q_columns import sql_artist, sql_genre, sql_haversine, sql_place, sql_title
from .registry import register
from .views import AS_OF

HOST = "lower(regexp_extract(website, '^https?://(?:www[.])?([^/:]+)', 1))"
_LOW = "lower(city) || '|' || lower(state)"
KEYS = f"""select poi_id as id, unnest(range(0, 8)) as rank, unnest(['places_id', 'export_id', 'name_geo', 'website_city_state', 'phone_city_state', 'name_address', 'name_city_state', 'name_state']) as strategy,
 unnest([lower(places_id), lower(export_id), nullif(n, '') || '|' || printf('%.4f', lat) || '|' || printf('%.4f', lng), case when website is not null then {HOST} || '|' || {_LOW} end, regexp_replace(phone, '[^0-9]', '', 'g') || '|' || {_LOW}, nullif(n, '') || '|' || coalesce({sql_place('address')}, ''), nullif(n, '') || '|' || {_LOW}, nullif(n, '') || '|' || lower(state)]) as key
from (select *, {sql_place('name')} as n from {{v_poi}})"""
TITLE = sql_title("coalesce(nullif(trim(headliner), ''), title)")


def _sql_hash(*parts: str) -> str:
    return "sha256(" + " || '|' || ".join(f"coalesce({p}::varchar, '')" for p in parts) + ")"


URL = "'https://' || lower(regexp_extract(source_url, '^https://([^/]*)', 1)) || rtrim(regexp_extract(source_url, '^https://[^/]*([^?]*)', 1), '/') || '?' || regexp_extract(source_url, '(id=[0-9]+)$', 1)"
TICKET_URL = "case when coalesce(trim(tickets_link), '') = '' then '' else regexp_replace(tickets_link, '[?]fbclid=1$', '') end"
MINUTE = "strftime(start_ts, '%Y-%m-%d %H:%M')"
EVENT_KEYS = f"""select *, coalesce(strong_key, medium_key) as event_key, case when strong_key is not null then 'strong' else 'medium' end as key_confidence from (select *,
 case when source_event_id is not null and provider is not null then {_sql_hash("'provider'", 'provider', 'source_event_id')} when source_event_id is not null and source_type = 'ics' then {_sql_hash("'ics'", URL, 'source_event_id')} when source_event_id is not null and source_type = 'file_upload' then {_sql_hash("'file'", 'source_event_id', sql_title('title'), 'start_ts::date')} end as strong_key,
 {_sql_hash("'event-medium'", TITLE, MINUTE, sql_title('location_text'), TICKET_URL)} as medium_key, {_sql_hash("'event-weak'", TITLE, MINUTE)} as weak_key from {{v_event}})"""


def region_places(v):
    """Regions with a city each, and venues as places."""
    regions = v("v_region").select("region_id", "region_type", F.concat(F.lit("City "), (F.col("region_id") % 12).cast("string")).alias("city"), F.col("name").alias("state"), "country", "lat", "lng", "radius_miles")
    return v("v_venue"), regions


register("d01_events_with_children", lambda v: v("v_event").join(v("v_claim").groupBy("event_id").agg(F.count(F.lit(1)).alias("claims"), F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("types")), "event_id", "left").join(v("v_image").groupBy("event_id").agg(F.count(F.lit(1)).alias("images")), "event_id", "left").select("event_id", F.coalesce("claims", F.lit(0)).alias("claims"), "types", F.coalesce("images", F.lit(0)).alias("images")),
         "select event_id, coalesce(claims, 0) as claims, types, coalesce(images, 0) as images from {v_event} left join (select event_id, count(*) as claims, string_agg(distinct source_type, ',' order by source_type) as types from {v_claim} group by 1) using (event_id) left join (select event_id, count(*) as images from {v_image} group by 1) using (event_id)")
register("d02_events_in_city", lambda v: v("v_event").join(v("v_venue").where("city = 'City 3'"), "venue_id").select("event_id", "city", "state"), "select event_id, city, state from {v_event} join {v_venue} using (venue_id) where city = 'City 3'")
register("d03_artist_events", lambda v: v("v_artist").join(v("v_claim").select("artist_id", "event_id").distinct(), "artist_id").join(v("v_event").select("event_id", "start_ts"), "event_id").groupBy("artist_id").agg(F.count(F.lit(1)).alias("n"), F.min("start_ts").cast("string").alias("first_start")),
         "select artist_id, count(*) as n, min(start_ts)::varchar as first_start from {v_artist} join (select distinct artist_id, event_id from {v_claim}) using (artist_id) join {v_event} using (event_id) group by 1")
register("d04_source_events", lambda v: v("v_event").join(v("v_claim").where("source_id = 7"), "event_id", "left_semi").select("event_id"), "select event_id from {v_event} where event_id in (select event_id from {v_claim} where source_id = 7)")
register("d06_region_by_place", lambda v: (lambda p, r: matching.region_by_place(p, r, "venue_id"))(*region_places(v)),
         "select venue_id, coalesce(e.region_id, w.region_id) as region_id, case when e.region_id is not null then 0.95 when w.region_id is not null then 0.72 end::double as confidence from {v_venue} v left join (select 'City ' || (region_id % 12)::varchar as city, name as state, country, min(region_id) as region_id from {v_region} group by all) e on e.city = v.city and e.state = v.state and e.country = v.country left join (select name as state, country, min(region_id) as region_id from {v_region} where region_type in ('state', 'metro', 'certified') group by all) w on w.state = v.state and w.country = v.country")
register("d07_poi_upcoming", lambda v: v("v_poi").select("poi_id", (F.col("poi_id") % 100).alias("venue_id")).join(v("v_event").where(F.col("start_ts") >= F.expr(AS_OF)).groupBy("venue_id").agg(F.count(F.lit(1)).alias("n"), F.min("start_ts").cast("string").alias("next_start")), "venue_id", "left").select("poi_id", F.coalesce("n", F.lit(0)).alias("n"), "next_start"),
         f"select poi_id, coalesce(n, 0) as n, next_start from {{v_poi}} left join (select venue_id, count(*) as n, min(start_ts)::varchar as next_start from {{v_event}} where start_ts >= {AS_OF} group by 1) u on u.venue_id = poi_id % 100")
_D8 = f"select venue_id, region_id, d, r from (select venue_id, g.region_id, radius_miles as r, {sql_haversine('v.lat', 'v.lng', 'g.lat', 'g.lng', geo.METRES)} * {geo.MILES} / {geo.METRES} as d from {{v_venue}} v cross join {{v_region}} g) where d <= r qualify row_number() over (partition by venue_id order by d, region_id) = 1"
register("d08_nearest_region", lambda v: matching.nearest_region(v("v_venue"), v("v_region"), "venue_id", 90.0).select("venue_id", "region_id", F.round("distance", 6).alias("distance"), F.round("confidence", 6).alias("confidence")),
         "select venue_id, region_id, round(d, 6) as distance, round(greatest(0.5, least(0.9, 1 - 0.4 * d / r)), 6) as confidence from {near}", near=_D8)
register("d09_assigned_regions", lambda v: (lambda p, r: matching.assign_regions(p, r, "venue_id", 0.75, 90.0).select("venue_id", "region_id", "how"))(*region_places(v)),
         "with e as (select venue_id, g.region_id from v join (select 'City ' || (region_id % 12)::varchar as city, name as state, country, min(region_id) as region_id from r group by all) g using (city, state, country)) select venue_id, region_id, 'place' as how from e union all select venue_id, region_id, 'distance' from n where venue_id not in (select venue_id from e) and greatest(0.5, least(0.9, 1 - 0.4 * d / r)) >= 0.75".replace("with e as (", "").replace(" from v join", " from {v_venue} join").replace(" from r group", " from {v_region} group").replace(") select venue_id, region_id, 'place'", "@@select venue_id, region_id, 'place'").split("@@")[1].replace(" from e union", " from {placed} union").replace("from e)", "from {placed})").replace(" from n ", " from {near} "),
         placed="select venue_id, g.region_id from {v_venue} join (select 'City ' || (region_id % 12)::varchar as city, name as state, country, min(region_id) as region_id from {v_region} group by all) g using (city, state, country)", near=_D8)
register("d10_poi_pairs", lambda v: matching.poi_pairs(v("v_poi")).select("a", "b", "confidence"),
         f"select a, b, confidence from (select x.poi_id as a, y.poi_id as b, case when d <= 50 then 'medium' when d <= 100 and (x.website = y.website or x.phone = y.phone) then 'weak' end as confidence from (select x.*, y, {sql_haversine('x.lat', 'x.lng', 'y.lat', 'y.lng', geo.METRES)} as d, x from {{named}} x join {{named}} y on x.n = y.n and x.city = y.city and x.state = y.state and x.poi_id < y.poi_id)) where confidence is not null".replace("select x.*, y, ", "select ").replace(" as d, x from", " as d, x, y from"), named=f"select *, {sql_place('name')} as n from {{v_poi}} where lat is not null and trim({sql_place('name')}) <> ''")
register("d11_poi_matches", lambda v: (lambda k: matching.priority_join(v("v_poi"), "poi_id", k, v("v_poi").withColumnRenamed("poi_id", "match_id"), "match_id", k, same=True))(matching.poi_keys()),
         "select poi_id, match_id, strategy from (select l.id as poi_id, r.id as match_id, l.strategy, row_number() over (partition by l.id order by l.rank, r.id) as n from {k} l join {k} r on l.strategy = r.strategy and l.key = r.key and l.id <> r.id) where n = 1", k=KEYS)
register("d13_near_pairs", lambda v: matching.near_pairs(v("v_venue"), v("v_poi"), 60.0, "venue_id", "poi_id").select("venue_id", "poi_id", F.round("distance", 3).alias("distance")),
         f"select venue_id, poi_id, round(d, 3) as distance from (select venue_id, poi_id, {sql_haversine('v.lat', 'v.lng', 'p.lat', 'p.lng', geo.METRES)} as d from {{v_venue}} v join {{v_poi}} p on abs(v.lat - p.lat) < 0.01) where d <= 60")
_SIMILAR = "x <> '' and y <> '' and (contains(x, y) or contains(y, x) or 1 - levenshtein(x, y)::double / greatest(len(x), len(y), 1) >= 0.82)"
_NAMED = f"select poi_id, {sql_place('name')} as n, lat, lng, lower(city) as city, lower(state) as state, nullif(regexp_extract(lower(coalesce(website, '')), '^https?://(?:www[.])?([^/:?#]+)', 1), '') as domain, phone, category from {{v_poi}}"
_TIERS = f"""select id, other, min(tier) as tier from (select p.poi_id as id, o.poi_id as other, p.n as x, o.n as y, 0 as tier from {{named}} p join {{named}} o on p.poi_id <> o.poi_id and abs(p.lat - o.lat) < 0.01 and o.category <> 'Concert' where {sql_haversine('p.lat', 'p.lng', 'o.lat', 'o.lng', geo.METRES)} <= 50
union all select p.poi_id, o.poi_id, p.n, o.n, case when p.domain = o.domain then 1 else 2 end from {{named}} p join {{named}} o on p.poi_id <> o.poi_id and p.city = o.city and p.state = o.state and o.category <> 'Concert' where p.domain = o.domain or p.phone = o.phone) where {_SIMILAR} group by 1, 2"""
register("d12_similar_near_places", lambda v: matching.similar_places(v("v_poi"), v("v_poi").withColumnRenamed("poi_id", "match_id"), "poi_id", "match_id", same=True),
         "select id as poi_id, other as match_id, case tier when 0 then 'medium' else 'weak' end as confidence, case tier when 0 then 'similar_name_nearby_geo' when 1 then 'same_name_city_state_domain' else 'same_name_city_state_phone' end as strategy from {tiers} qualify row_number() over (partition by id order by other, tier) = 1",
         named=_NAMED, tiers=_TIERS)
def event_sides(v):
    rows = upsert.event_keys(v("v_event")).select("event_id", "source_type", "event_key", F.coalesce(text.clean("headliner"), F.col("title")).alias("title"), "start_ts", F.when(F.col("event_id") % 6 > 0, F.col("location_text")).otherwise("").alias("venue"))
    claims = v("v_claim").where("source_type = 'ics' and match_confidence >= 0.1").select(F.col("provider_event_id").alias("claim_key"), (F.col("event_id") - F.col("event_id") % 4 + 1).alias("event_id"))
    candidates = rows.where("source_type = 'file_upload'").select(F.col("event_id").alias("candidate_id"), F.concat(F.lit("pe-"), (F.col("event_id") % 4000).cast("string")).alias("claim_key"), "event_key", "title", "start_ts", "venue")
    return candidates, rows.where("source_type <> 'file_upload'"), claims


EVENT_MATCHES = """select c.event_id as candidate_id, coalesce(k.event_id, e.event_id, f.event_id) as event_id,
 case when k.event_id is not null then 1.0 when e.event_id is not null then 0.96 when tier = 0 then 0.86 when tier = 1 then 0.74 when tier = 2 then 0.58 else 0.0 end::double as score,
 case when k.event_id is not null then 'claim' when e.event_id is not null then 'event_key' when tier = 0 then 'title_day_venue' when tier = 1 then 'title_day' when tier = 2 then 'title_day_conflict' else 'none' end as reason
from (select * from {rows} where source_type = 'file_upload') c
left join (select provider_event_id as claim_key, min(event_id - event_id % 4 + 1) as event_id from {v_claim} where source_type = 'ics' and match_confidence >= 0.1 and provider_event_id is not null group by 1) k on k.claim_key = 'pe-' || (c.event_id % 4000)::varchar
left join (select event_key, min(event_id) as event_id from {rows} where source_type <> 'file_upload' group by 1) e on e.event_key = c.event_key
left join (select l.event_id as cid, r.event_id, case when l.w <> '' and l.w = r.w then 0 when l.w = '' or r.w = '' then 1 else 2 end as tier from {rows} l join {rows} r on l.t = r.t and l.t <> '' and l.d = r.d and l.source_type = 'file_upload' and r.source_type <> 'file_upload' qualify row_number() over (partition by l.event_id order by tier, r.event_id) = 1) f on f.cid = c.event_id"""
EVENT_ROWS = f"select event_id, source_type, event_key, {TITLE} as t, start_ts::date as d, case when event_id % 6 > 0 then {sql_title('location_text')} else '' end as w from {{keys}}"
register("d15_event_matches", lambda v: matching.match_events(*event_sides(v)), EVENT_MATCHES, keys=EVENT_KEYS, rows=EVENT_ROWS)
register("d16_url_in_registry", lambda v: v("v_event").select("event_id", text.hash_of(text.source_url("source_url")).alias("h")).join(v("v_event").groupBy(text.hash_of(text.source_url("source_url")).alias("h")).agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "h").where("n > 1 and event_id <> first_id").select("event_id", "first_id"),
         f"select event_id, first_id from (select event_id, min(event_id) over (partition by {URL}) as first_id from {{v_event}}) where event_id <> first_id")
register("d17_listed_attempts", lambda v: matching.listed(v("v_attempt"), v("v_attempt").where("attempt_id < 10").select(F.lit("email").alias("kind"), F.lower("email").alias("value")).union(v("v_attempt").where("attempt_id < 2").select(F.lit("domain"), F.lower("domain"))), "attempt_id"),
         "select attempt_id from {v_attempt} where lower(email) in (select lower(email) from {v_attempt} where attempt_id < 10) or lower(domain) in (select lower(domain) from {v_attempt} where attempt_id < 2)")
register("d18_sources_with_crawls", lambda v: v("v_crawl").groupBy("source_id").agg(F.max_by("status", F.struct("fetched_at", "crawl_id")).alias("latest_status"), F.count(F.lit(1)).alias("crawls"), F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses")),
         "select source_id, max_by(status, (fetched_at, crawl_id)) as latest_status, count(*) as crawls, string_agg(distinct status, ',' order by status) as statuses from {v_crawl} group by 1")
register("d20_events_without_claims", lambda v: v("v_event").join(v("v_claim"), "event_id", "left_anti").select("event_id"), "select event_id from {v_event} where event_id not in (select event_id from {v_claim})")
register("d21_route_stops", lambda v: v("v_claim").select("claim_id", F.when(F.col("claim_id") % 3 == 0, "event").when(F.col("claim_id") % 3 == 1, "venue").otherwise("artist").alias("stop_type"), F.when(F.col("claim_id") % 3 == 0, F.col("event_id")).when(F.col("claim_id") % 3 == 1, F.col("source_id")).otherwise(F.col("artist_id")).alias("ref_id")).join(v("v_event").select(F.lit("event").alias("stop_type"), F.col("event_id").alias("ref_id"), F.col("title").alias("label")).unionByName(v("v_venue").select(F.lit("venue").alias("stop_type"), F.col("venue_id").alias("ref_id"), F.col("name").alias("label"))).unionByName(v("v_artist").select(F.lit("artist").alias("stop_type"), F.col("artist_id").alias("ref_id"), F.col("name").alias("label"))), ["stop_type", "ref_id"], "left").select("claim_id", "stop_type", "label"),
         "select claim_id, case claim_id % 3 when 0 then 'event' when 1 then 'venue' else 'artist' end as stop_type, case claim_id % 3 when 0 then e.title when 1 then w.name else a.name end as label from {v_claim} c left join {v_event} e on e.event_id = c.event_id left join {v_venue} w on w.venue_id = c.source_id left join {v_artist} a on a.artist_id = c.artist_id")

register("e01_event_keys", lambda v: upsert.event_keys(v("v_event")).select("event_id", "source_type", "event_key", "weak_key", "key_confidence"), "select event_id, source_type, event_key, weak_key, key_confidence from {keys}", keys=EVENT_KEYS)
register("e02_claim_keys", lambda v: v("v_claim").select("claim_id", upsert.claim_key("provider", "provider_event_id", "source_type", "record_id", F.col("event_id").cast("string")).alias("claim_key")),
         f"select claim_id, case when provider_event_id is not null then {_sql_hash(chr(39) + 'provider-event' + chr(39), 'provider', 'provider_event_id')} when record_id is not null then {_sql_hash(chr(39) + 'source-record' + chr(39), 'source_type', 'record_id')} else {_sql_hash(chr(39) + 'claim' + chr(39), 'source_type', 'event_id')} end as claim_key from {{v_claim}}")


def _merge_sides(v):
    golden = v("v_event").where("event_id % 3 > 0").select("event_id", "title", "headliner", "genre", "tickets_link", F.col("relevance").alias("score"))
    incoming = v("v_event").where("event_id % 2 = 0").select("event_id", F.concat("title", F.when(F.col("event_id") % 10 == 0, " (moved)").otherwise("")).alias("title"), F.lit("Late Band").alias("headliner"), F.lit(None).cast("string").alias("genre"), F.lit("https://new.example.com/t").alias("tickets_link"), (F.col("relevance") + F.col("event_id") % 5 - 2).alias("score"))
    return golden, incoming


POLICY = {"title": "replace", "headliner": "fill", "genre": "replace", "tickets_link": "fill", "score": "raise"}
register("e04_merged_fields", lambda v: upsert.merge_fields(*_merge_sides(v), "event_id", POLICY).select("event_id", "title", "headliner", "tickets_link", F.round("score", 6).alias("score"), F.array_join("changed", ",").alias("changed"), "action"),
         """select event_id, case when i and trim(nt) <> '' then nt else title end as title, case when not g then 'Late Band' when i and headliner is null then 'Late Band' else headliner end as headliner,
 case when not g then 'https://new.example.com/t' when i and coalesce(trim(tickets_link), '') = '' then 'https://new.example.com/t' else tickets_link end as tickets_link,
 round(case when not g then ns when i and ns > relevance then ns else relevance end, 6) as score,
 case when g and i then concat_ws(',', case when trim(nt) <> '' and nt <> title then 'title' end, case when headliner is null then 'headliner' end, case when coalesce(trim(tickets_link), '') = '' then 'tickets_link' end, case when ns > relevance then 'score' end) else '' end as changed,
 case when not g then 'created' when not i then 'kept' when (trim(nt) <> '' and nt <> title) or headliner is null or coalesce(trim(tickets_link), '') = '' or ns > relevance then 'updated' else 'skipped' end as action
from (select *, event_id % 3 > 0 as g, event_id % 2 = 0 as i, title || case when event_id % 10 = 0 then ' (moved)' else '' end as nt, relevance + event_id % 5 - 2 as ns from {v_event} where event_id % 3 > 0 or event_id % 2 = 0)""")
register("e05_claim_counts", lambda v: v("v_claim").groupBy("event_id").agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("source_id").alias("sources")), "select event_id, count(*) as claims, count(distinct source_id) as sources from {v_claim} group by 1")
register("e06_duplicate_groups", lambda v: upsert.duplicate_groups(upsert.event_keys(v("v_event")).where("start_ts is not null")).select("weak_key", "event_id", "role"),
         "select weak_key, event_id, case when event_id = min(event_id) over w then 'possible_primary' else 'duplicate_candidate' end as role from {keys} where start_ts is not null window w as (partition by weak_key) qualify count(*) over w > 1", keys=EVENT_KEYS)
POI_KEY = f"select *, case when n <> '' and lat is not null and lng is not null then 'name_geo:' || n || '|lat:' || printf('%.5f', lat) || '|lng:' || printf('%.5f', lng) when places_id is not null then 'places_id:' || lower(places_id) when export_id is not null then 'export_id:' || lower(export_id) else 'name_location:' || n || '|' || lower(city) || '|' || lower(state) || '|' || coalesce({sql_place('address')}, '') end as poi_key from (select *, {sql_place('name')} as n from {{v_poi}})"
register("e08_poi_keys", lambda v: upsert.poi_key(v("v_poi")).select("poi_id", "poi_key", "poi_key_confidence"), "select poi_id, poi_key, case when poi_key like 'name_location:%' then 'weak' else 'strong' end as poi_key_confidence from {k}", k=POI_KEY)
register("e09_duplicate_report", lambda v: upsert.first_pairs(upsert.poi_key(v("v_poi")), "poi_key", "poi_id").agg(F.lit("strong").alias("confidence"), F.count(F.lit(1)).alias("n")).where("n > 0").unionByName(matching.poi_pair_counts(v("v_poi")).select("confidence", "n")),
         f"select confidence, count(*) as n from (select 'strong' as confidence from {{k}} group by poi_key having count(*) > 1 union all select confidence from (select case when d <= 50 then 'medium' when d <= 100 and (w1 = w2 or p1 = p2) then 'weak' end as confidence from (select {sql_haversine('x.lat', 'x.lng', 'y.lat', 'y.lng', geo.METRES)} as d, x.website as w1, y.website as w2, x.phone as p1, y.phone as p2 from {{k}} x join {{k}} y on x.n = y.n and x.n <> '' and x.city = y.city and x.state = y.state and x.poi_id < y.poi_id)) where confidence is not null) group by 1", k=POI_KEY)
register("e10_key_index", lambda v: upsert.key_index(matching.keyed(v("v_poi"), "poi_id", matching.poi_keys())).groupBy("strategy").agg(F.count(F.lit(1)).alias("keys"), F.sum("refs").alias("refs"), F.count_if(F.col("refs") > 1).alias("collisions")),
         "select strategy, count(*) as keys, sum(refs)::bigint as refs, count_if(refs > 1)::bigint as collisions from (select strategy, key, count(*) as refs from {k} where key is not null group by 1, 2) group by 1", k=KEYS)
register("e13_registry", lambda v: upsert.registry(v("v_attempt").withColumn("risk", F.floor("value").cast("long")), "domain", "attempt_id", "risk", "kind", "email"),
         "select domain, min(attempt_id) as first_seen, max(attempt_id) as last_seen, max(floor(value)::bigint) as risk, max_by(kind, (floor(value)::bigint, kind)) as flags, count(distinct email) as submitters, count(*) as submissions from {v_attempt} group by 1")
register("e15_artist_duplicates", lambda v: v("v_artist").select("artist_id", text.artist_name("name").alias("k")).where("k <> ''").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("artist_id").alias("first_id")).where("n > 1"), f"select {sql_artist('name')} as k, count(*) as n, min(artist_id) as first_id from {{v_artist}} where {sql_artist('name')} <> '' group by 1 having count(*) > 1")
register("e16_feed_status", lambda v: upsert.feed_status(v("v_claim"), "provider_event_id", "claim_id", v("v_claim").where("match_confidence >= 0.1").select("provider_event_id")),
         "select claim_id, case when claim_id <> first_id then 'duplicate_within_run' when k.provider_event_id is not null then 'possible_existing_event' else 'new' end as status from (select *, case when provider_event_id is not null then min(claim_id) over (partition by provider_event_id) end as first_id from {v_claim}) c left join (select distinct provider_event_id from {v_claim} where match_confidence >= 0.1 and provider_event_id is not null) k using (provider_event_id)")
register("e18_staged_dedupe", lambda v: windows.latest(v("v_event").where("source_url is not null and start_ts is not null"), ["title", "start_ts", "source_url"], [F.col("event_id")]).select("event_id"), "select min(event_id) as event_id from {v_event} where start_ts is not null group by title, start_ts, source_url")
register("e19_decisions", lambda v: upsert.decide(v("documents").select("doc_id", "n_chars"), v("labels").select("doc_id", F.when(F.col("quality") == 1, "approve").otherwise("reject").alias("decision")), "doc_id", F.col("n_chars") >= 500).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")),
         "select case when quality is null then null when quality = 1 and n_chars < 500 then 'refused' when quality = 1 then 'approve' else 'reject' end as outcome, count(*) as n from {documents} left join {labels} using (doc_id) group by 1")
# every event names its hall in its venue's town; the halls of dear events are known, and all of two runs
_FOUND = f"select event_id, source_type, (event_id // 100 % 5)::varchar as run_id, {sql_place('location_text')} as name_key, lower(trim(coalesce(city, ''))) as city, lower(trim(coalesce(state, ''))) as state, price from {{v_event}} left join {{v_venue}} using (venue_id)"


def _found(v):
    return v("v_event").join(v("v_venue").select("venue_id", "city", "state"), "venue_id", "left").select("event_id", "source_type", (F.floor(F.col("event_id") / 100) % 5).alias("run_id"), F.col("location_text").alias("name"), "city", "state", "price")


register("e22_new_candidates", lambda v: (lambda f: upsert.new_candidates(f, f.where("price > 300000 or run_id > 3"), "event_id"))(_found(v)),
         "select min(event_id) as event_id, source_type, run_id, name_key, city, state from {f} f where name_key <> '' and not exists (select 1 from {f} k where (k.price > 300000 or k.run_id > '3') and k.source_type = f.source_type and k.run_id = f.run_id and k.name_key = f.name_key and k.city = f.city and k.state = f.state) group by all", f=_FOUND)
