"""Queries of normalisation, keys, filters, unions and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import filters, genres
from .registry import register

TITLE_NOISE = ", ".join(f"'{w}'" for w in ("", *text.TITLE_NOISE))
ARTIST_NOISE = ", ".join(f"'{w}'" for w in ("", *text.ARTIST_NOISE))


def _sql_words(c: str, noise: str) -> str:
    return f"array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(replace(lower({c}), '&', ' and '), '[''`´]', '', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w not in ({noise})), ' ')"


def sql_title(c: str) -> str:
    return _sql_words(f"coalesce({c}, '')", TITLE_NOISE)


def sql_artist(c: str) -> str:
    return _sql_words(f"trim(coalesce({c}, ''))", ARTIST_NOISE)


def sql_fold(c: str) -> str:
    return f"translate({c}, '{text.ACCENTED}', '{text.PLAIN}')"


def sql_place(c: str) -> str:
    low = f"replace(lower(regexp_replace({sql_fold(f'coalesce({c}, chr(32))')}, '[^\\x00-\\x7F]', '', 'g')), '&', ' and ')"
    return f"trim(regexp_replace(regexp_replace({low}, '\\b(llc|inc|ltd|corp|co|company)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def sql_part(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


def sql_flags(*pairs: tuple[str, str], sort: bool = False) -> str:
    made = "list_filter([" + ", ".join(f"case when {cond} then '{name}' end" for cond, name in pairs) + "], lambda f: f is not null)"
    return f"array_to_string({f'list_sort(list_distinct({made}))' if sort else made}, ',')"


def sql_genre(c: str) -> str:
    low = f"lower(trim(coalesce({c}, '')))"
    exact = " ".join(f"when {low} = '{a}' then '{g}'" for a, g in genres.ALIASES)
    within = " ".join(f"when contains({low}, '{a}') then '{g}'" for a, g in genres.ALIASES)
    return f"case when {low} = '' then '{genres.UNKNOWN}' {exact} {within} else '{genres.UNKNOWN}' end"


def sql_haversine(a: str, b: str, c: str, d: str, radius: float) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"({2 * radius} * atan2(sqrt({h}), sqrt(1 - {h})))"


register("b01_dedupe_text", lambda v: v("v_event").select("event_id", text.dedupe_text("title").alias("title_key"), text.dedupe_text("location_text").alias("venue_key")),
         f"select event_id, {sql_title('title')} as title_key, {sql_title('location_text')} as venue_key from {{v_event}}")
register("b02_place_name", lambda v: v("v_poi").select("poi_id", text.place_name("name").alias("normalized_name")), f"select poi_id, {sql_place('name')} as normalized_name from {{v_poi}}")
register("b03_artist_key", lambda v: v("v_artist").select("artist_id", text.artist_name("name").alias("artist_name"), text.artist_key("name").alias("artist_key")),
         f"select artist_id, {sql_artist('name')} as artist_name, 'artist:' || substr(sha256({sql_artist('name')}), 1, 16) as artist_key from {{v_artist}}")
register("b04_search_text", lambda v: v("documents").select("doc_id", F.md5(text.search_text("text")).alias("search_md5")),
         f"select doc_id, md5(trim(lower(regexp_replace({sql_fold('text')}, '[^a-zA-Z0-9]+', ' ', 'g')))) as search_md5 from {{documents}}")
register("b05_region_key", lambda v: v("v_venue").select("venue_id", text.region_key("city", "state", "address").alias("region_key")),
         "select venue_id, case when k = '' then 'unknown' else k end as region_key from (select venue_id, trim(regexp_replace(lower(concat_ws('-', nullif(trim(city), ''), nullif(trim(state), ''), nullif(trim(address), ''))), '[^a-z0-9]+', '-', 'g'), '-') as k from {v_venue})")
register("b06_venue_key", lambda v: v("v_venue").select("venue_id", text.venue_key("name", "address", "city", "state", "zip", "country", "lat", "lng").alias("venue_key")),
         "select venue_id, sha256(" + " || '|' || ".join(sql_part(c) for c in ("name", "address", "city", "state", "zip", "country")) + " || coalesce('|' || printf('%.5f', lat) || ',' || printf('%.5f', lng), '')) as venue_key from {v_venue}")
register("b07_canonical_urls", lambda v: v("v_event").select("event_id", text.event_url("source_url").alias("event_url"), text.source_url("source_url").alias("source_url"), text.hash_of(text.event_url("tickets_link")).alias("ticket_hash")),
         """select event_id,
  'https://' || lower(regexp_extract(source_url, '^https://([^/]*)', 1)) || rtrim(regexp_extract(source_url, '^https://[^/]*([^?]*)', 1), '/') || '?' || regexp_extract(source_url, '(id=[0-9]+)$', 1) as event_url,
  'https://' || lower(regexp_extract(source_url, '^https://([^/]*)', 1)) || rtrim(regexp_extract(source_url, '^https://[^/]*([^?]*)', 1), '/') || '?' || regexp_extract(source_url, '(id=[0-9]+)$', 1) as source_url,
  sha256(case when coalesce(trim(tickets_link), '') = '' then '' else regexp_replace(tickets_link, '[?]fbclid=1$', '') end) as ticket_hash
from {v_event}""")
register("b08_image_orientation", lambda v: v("v_image").select("image_id", (F.col("width") / F.col("height")).alias("r"), "url").select("image_id", F.when(F.col("r") >= 2.2, "panoramic").when(F.col("r") >= 1.15, "landscape").when(F.col("r") >= 0.85, "square").otherwise("portrait").alias("orientation"), F.lower("url").rlike(r"\.(jpe?g|png|webp|gif)$").alias("is_direct")),
         "select image_id, case when width / height >= 2.2 then 'panoramic' when width / height >= 1.15 then 'landscape' when width / height >= 0.85 then 'square' else 'portrait' end as orientation, regexp_matches(lower(url), '\\.(jpe?g|png|webp|gif)$') as is_direct from {v_image}")
register("b10_genres", lambda v: v("v_event").select("event_id", genres.genre("genre").alias("genre_name")).withColumn("confidence", genres.genre_confidence(F.col("genre_name"))),
         f"select event_id, {sql_genre('genre')} as genre_name, case when {sql_genre('genre')} = '{genres.UNKNOWN}' then 0.3 else 0.9 end::double as confidence from {{v_event}}")
register("b10_genre_lists", lambda v: v("v_claim").join(v("v_artist"), "artist_id").groupBy("event_id").agg(F.array_sort(F.collect_set("genre_text")).alias("g")).select("event_id", F.array_join(genres.genres(F.col("g"))[1], ",").alias("genres"), F.size("g").cast("long").alias("n")),
         f"select event_id, coalesce(nullif(array_to_string(list_sort(list(distinct g) filter (g <> '{genres.UNKNOWN}')), ','), ''), '{genres.UNKNOWN}') as genres, count(distinct genre_text) as n from (select event_id, genre_text, {sql_genre('genre_text')} as g from {{v_claim}} join {{v_artist}} using (artist_id)) group by event_id")
register("b13_price_text", lambda v: v("v_claim").select("claim_id", text.price_text(F.when(F.col("quantity") > 10, F.col("quantity")), F.when(F.col("claim_id") % 3 > 0, F.col("quantity") + F.col("claim_id") % 2), F.when(F.col("claim_id") % 4 > 0, F.lit("USD"))).alias("price")),
         """select claim_id, trim(case when lo is not null and hi is not null and lo = hi then printf('%.2f', lo) when lo is not null and hi is not null then printf('%.2f', lo) || '-' || printf('%.2f', hi) when lo is not null then 'from ' || printf('%.2f', lo) when hi is not null then 'up to ' || printf('%.2f', hi) else '' end || case when (lo is not null or hi is not null) and claim_id % 4 > 0 then ' USD' else '' end) as price
from (select claim_id, case when quantity > 10 then quantity end as lo, case when claim_id % 3 > 0 then quantity + claim_id % 2 end as hi from {v_claim})""")
register("b15_lifecycle", lambda v: v("v_event").select("event_id", text.lifecycle(F.col("event_status"), F.lit("{}")).alias("lifecycle")),
         "select event_id, case when lower(event_status) like '%cancelled%' or lower(event_status) like '%canceled%' then 'cancelled' when lower(event_status) like '%postponed%' then 'postponed' when lower(event_status) like '%rescheduled%' then 'rescheduled' else 'active' end as lifecycle from {v_event}")
register("b16_supporting_artists", lambda v: v("v_event").select("event_id", F.posexplode(text.people("supporting_artists")).alias("position", "name")).withColumn("position", F.col("position").cast("long")),
         "select event_id, p - 1 as position, n[p] as name from (select event_id, n, unnest(range(1, len(n) + 1)) as p from (select event_id, list_filter(list_transform(regexp_split_to_array(coalesce(supporting_artists, ''), '[,;\\n]| \\+ | with '), lambda x: trim(x)), lambda x: x <> '') as n from {v_event}))")
register("b18_subcategory_pick", lambda v: v("v_poi").select("poi_id", F.element_at(F.create_map(*[F.lit(x) for c in ("Music Site", "Cultural", "Lodging") for x in (c, c.lower())]), F.col("category")).alias("picked")),
         "select poi_id, case when category in ('Music Site', 'Cultural', 'Lodging') then lower(category) end as picked from {v_poi}")
register("b19_registry_record", lambda v: v("v_poi").select("poi_id", F.concat(F.lit("poi_"), F.substring(F.sha2(F.concat(F.lit("n:"), text.place_name("name"), F.lit("|"), F.coalesce(text.geo_key("lat", "lng"), F.lit(""))), 256), 1, 16)).alias("canonical_id"), text.hash_of(F.col("name"), F.col("category"), F.col("address"), F.col("website")).alias("row_hash")),
         f"select poi_id, 'poi_' || substr(sha256('n:' || {sql_place('name')} || '|' || coalesce('lat:' || printf('%.5f', lat) || '|lng:' || printf('%.5f', lng), '')), 1, 16) as canonical_id, sha256(coalesce(name, '') || '|' || coalesce(category, '') || '|' || coalesce(address, '') || '|' || coalesce(website, '')) as row_hash from {{v_poi}}")
register("b21_redaction", lambda v: v("documents").select("doc_id", (F.md5(text.redact("text")) != F.md5("text")).alias("had_secret"), F.regexp_count(text.redact("text"), F.lit(r"\[redacted\]")).cast("long").alias("n_redacted")),
         r"""select doc_id, red <> text as had_secret, (len(red) - len(replace(red, '[redacted]', '')))::bigint // 10 as n_redacted
from (select doc_id, text, regexp_replace(regexp_replace(text, '(?i)\b(api[_-]?key|token|secret|password|authorization)([ \t\n\r\f\v]*[=:][ \t\n\r\f\v]*)[^ \t\n\r\f\v&,;]+', '\1\2[redacted]', 'g'), '(?i)\bbearer[ \t\n\r\f\v]+[a-z0-9._\-]+', 'Bearer [redacted]', 'g') as red from {documents})""")
register("b22_neutral_cells", lambda v: v("conversations").select("conv_id", "turn", F.md5(text.neutral_cell(F.concat(F.when(F.col("turn") % 2 == 0, F.lit(" =")).otherwise(F.lit("")), F.col("role")))).alias("cell")),
         "select conv_id, turn, md5(case when regexp_matches(c, '^[=+@]') then '''' || c else c end) as cell from (select *, trim(case when turn % 2 = 0 then ' =' else '' end || role) as c from {conversations})")
register("b26_body_hash", lambda v: v("pages").select("page_id", F.sha2("html", 256).alias("content_hash")), "select page_id, sha256(html) as content_hash from {pages}")

register("c04_hide_blocked", lambda v: filters.hide_blocked(v("v_event")).groupBy("publish_status").agg(F.count(F.lit(1)).alias("n")), "select publish_status, count(*) as n from {v_event} where image_clearance <> 'blocked' group by 1")
register("c06_preview_radius", lambda v: filters.within(v("v_venue"), 12.0, 16.0, 150.0).select("venue_id", F.round("distance", 6).alias("distance")),
         f"select venue_id, round(d, 6) as distance from (select venue_id, {sql_haversine('12.0', '16.0', 'lat', 'lng', geo.MILES)} as d from {{v_venue}} where lat is not null and lng is not null) where d <= 150")
register("c13_crawl_gate", lambda v: v("v_event").select("event_id", filters.crawl_gate(F.when(F.col("event_id") % 5 == 0, "paused").when(F.col("event_id") % 7 == 0, "blocked").otherwise("approved"), F.when(F.col("event_id") % 3 == 0, "pending").when(F.col("event_id") % 11 == 0, "quarantined").otherwise("approved")).alias("reason")),
         "select event_id, case when event_id % 5 > 0 and event_id % 7 = 0 then 'blocked' when event_id % 3 > 0 and event_id % 11 = 0 then 'quarantined' when event_id % 5 = 0 then 'status=paused' when event_id % 3 = 0 then 'review_status=pending' end as reason from {v_event}")
register("c14_url_safety", lambda v: v("pages").select("page_id", F.array_join(text.url_flags(F.when(F.col("page_id") % 5 == 0, F.lit("ftp://10.0.0.1/x")).when(F.col("page_id") % 5 == 1, F.lit("http://172.20.1.1:80/")).otherwise(F.col("url"))), ",").alias("flags")),
         "select page_id, case page_id % 5 when 0 then 'invalid_url_scheme,dangerous_url' when 1 then 'dangerous_url' else '' end as flags from {pages}")
register("c15_like_filter", lambda v: filters.like(v("v_venue"), city="city 1", state=" nation_1 ", country="").select("venue_id", "city"), "select venue_id, city from {v_venue} where lower(city) like '%city 1%' and lower(state) like '%nation_1%'".replace("'%nation_1%'", "'%nation\\_1%' escape '\\'"))
register("g10_board_page", lambda v: filters.page(v("v_event").where("start_ts is not null"), [F.col("start_ts").desc(), F.col("event_id")], 3, 25).select("event_id"),
         "select event_id from {v_event} where start_ts is not null order by start_ts desc, event_id limit 25 offset 50")
register("g11_clamped_page", lambda v: filters.page(v("v_poi"), [F.col("poi_id")], 0, 900).select("poi_id"), "select poi_id from {v_poi} order by poi_id limit 500")
register("h04_id_union", lambda v: v("v_event").join(v("v_claim").where("match_confidence > 0.08").select("event_id").union(v("v_image").where("status = 'accepted'").select("event_id")).distinct(), "event_id", "left_semi").select("event_id"),
         "select event_id from {v_event} where event_id in (select event_id from {v_claim} where match_confidence > 0.08 union select event_id from {v_image} where status = 'accepted')")
register("k01_haversine", lambda v: v("v_poi").select("poi_id", F.round(geo.haversine(F.lit(4.5), F.lit(6.0), "lat", "lng"), 3).alias("metres")),
         f"select poi_id, round({sql_haversine('4.5', '6.0', 'lat', 'lng', geo.METRES)}, 3) as metres from {{v_poi}}")
register("k05_coordinate_flags", lambda v: v("v_poi").select("poi_id", F.array_join(text.flags((F.col("lat").isNull() | F.col("lng").isNull(), "missing_geo"), ((F.abs("lat") > 90) | (F.abs("lng") > 180), "invalid_geo"), ((F.col("lat") == 0) & (F.col("lng") == 0), "zero_geo")), ",").alias("flags")),
         "select poi_id, " + sql_flags(("lat is null or lng is null", "missing_geo"), ("abs(lat) > 90 or abs(lng) > 180", "invalid_geo"), ("lat = 0 and lng = 0", "zero_geo")) + " as flags from {v_poi}")
