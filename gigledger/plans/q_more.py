"""Queries of the remaining operators: vendor mappers, taxonomy, seeds, routes, batch twins of streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import filters, genres, matching, places, rollups, scores, taxonomy, tickets, upsert, windows
from ..sources import sheets
from ..streaming import jobs
from .q_columns import sql_artist, sql_flags, sql_genre, sql_place
from .q_matching import EVENT_KEYS
from .q_scores import EV, READY, TICKET, with_venue
from .registry import register
from .views import AS_OF

_NOW = lambda: F.expr(AS_OF)

# names and domains of sources, and the keys they stand for
SOURCES = (
    ("bandsintown", "bandsintown"), ("Bands In Town", "bandsintown"), ("SKYBOX", "vivid-seats"), ("manual json", "manual_json"), ("Manual_JSON", "unknown"), ("See Tickets UK", "see-tickets"), ("see_tickets", "see-tickets"),
    ("ovation tix audience view", "ovationtix-audienceview"), ("https://www.awin1.com/x?u=1", "affiliate-networks"), ("https://go.pxf.io/c/1", "affiliate-networks"), ("https://link.dice.fm/a", "dice"), ("www.axs.com", "axs"),
    ("m.ticketmaster.com/event/1", "ticketmaster"), ("https://ticketmaster.co.uk/", "unknown"), ("https://my.24tix.com/e", "twentyfour-tix"), ("https://buytickets.at/x", "ticket-tailor"), ("tix.com", "tix-com"), ("https://evilaxs.com/", "unknown"),
    (" ", "unknown"), ("https://hall.example.com/", "unknown"),
)
_SOURCE_ROWS = ", ".join(f"({i}, '{t}', '{k}')" for i, (t, k) in enumerate(SOURCES))
register("b09_domain_taxonomy", lambda v: v("v_claim").select("claim_id", F.element_at(F.array(*[F.lit(t) for t, _ in SOURCES]), (F.col("claim_id") % len(SOURCES) + 1).cast("int")).alias("source")).select("claim_id", "source", taxonomy.source_key(F.col("source")).alias("source_key")),
         f"select claim_id, source, source_key from {{v_claim}} join (values {_SOURCE_ROWS}) s(i, source, source_key) on claim_id % {len(SOURCES)} = i")
register("b17_split_urls", lambda v: v("v_poi").select("poi_id", F.posexplode(text.urls(F.concat_ws("$", "image_url", "website"))).alias("position", "url")).withColumn("position", F.col("position").cast("long")),
         "select poi_id, p - 1 as position, u[p] as url from (select poi_id, u, unnest(range(1, len(u) + 1)) as p from (select poi_id, list_filter([image_url, website], lambda x: x is not null) as u from {v_poi}))")
# every rung of the ladder by a word that names it
PLACE_WORDS = ("Festival", "Fairgrounds", "Vinyl", "Record Shop", "Guitar Shop", "Instrument", "Museum", "Performing Arts", "Theatre", "Theater", "Hotel", "Campground", "Chamber", "Tourism", "Travel", "Club", "Arena", "Auditorium", "Corner", "")
_PLACE = "coalesce(name, '') || ' ' || list_extract([" + ", ".join(f"'{w}'" for w in PLACE_WORDS) + f"], (poi_id % {len(PLACE_WORDS)} + 1)::int)"
_RUNGS = " ".join(f"when regexp_matches(t, '{'|'.join(words)}') then {i}" for i, (words, _, _, _) in enumerate(places.SUGGESTIONS))
_RUNG_ROWS = ", ".join(f"({i}, '{c}', '{s}', {n})" for i, (_, c, s, n) in enumerate(places.SUGGESTIONS)) + ", (-1, 'Music Site', 'Venues', 0.58), (-2, 'unknown', null, 0.0)"
register("b20_category_suggestion", lambda v: v("v_poi").select("poi_id", places.suggest_category(F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.element_at(F.array(*[F.lit(w) for w in PLACE_WORDS]), (F.col("poi_id") % len(PLACE_WORDS) + 1).cast("int")))).alias("s")).select("poi_id", "s.category", "s.subcategory", "s.confidence"),
         f"select poi_id, category, subcategory, confidence::double as confidence from (select poi_id, case when trim(t) = '' then -2 {_RUNGS} else -1 end as r from (select poi_id, lower({_PLACE}) as t from {{v_poi}})) join (values {_RUNG_ROWS}) l(r, category, subcategory, confidence) using (r)")
register("b27_staged_candidates", lambda v: v("v_event").select("event_id", text.clean("title").alias("event_name"), F.array_join(text.flags((text.is_blank("title"), "missing_title"), (F.col("start_ts").isNull(), "missing_start"), (text.is_blank("location_text"), "missing_venue")), ",").alias("errors")).withColumn("review", F.when(F.col("errors") == "", "pending_review").otherwise("needs_fix")),
         "select event_id, nullif(trim(title), '') as event_name, e as errors, case when e = '' then 'pending_review' else 'needs_fix' end as review from (select *, " + sql_flags(("trim(title) = ''", "missing_title"), ("start_ts is null", "missing_start")) + " as e from {v_event})")
register("c10_quality_bucket_filter", lambda v: scores.event_readiness(with_venue(v)).where(F.array_contains("blockers", "missing_venue_location") & F.lower("title").contains("urgent")).select("event_id"),
         "select event_id from {ready} where contains(blockers, 'missing_venue_location') and contains(lower(title), 'urgent')", ev=EV, ready=READY)
register("c16_suspicious_queue", lambda v: filters.suspicious(scores.risk(v("v_attempt"), {"authorization_missing": F.col("was_invalid"), "submitted_too_fast": F.col("value") < 1}).withColumn("status", F.when(F.col("attempt_id") % 9 == 0, "quarantined").otherwise("open"))).select("attempt_id", "risk_level", "status"),
         "select attempt_id, case when was_invalid then 'blocked' when value < 1 then 'high' else 'low' end as risk_level, case when attempt_id % 9 = 0 then 'quarantined' else 'open' end as status from {v_attempt} where was_invalid or value < 1 or attempt_id % 9 = 0")
register("d05_review_rows_with_candidates", lambda v: v("v_claim").select("claim_id", F.concat(F.when(F.col("source_type") == "api", "api:").otherwise("extracted:"), F.col("event_id").cast("string")).alias("k")).join(v("v_poi").select(F.concat(F.when(F.col("poi_id") % 2 == 0, "api:").otherwise("extracted:"), F.col("poi_id").cast("string")).alias("k"), "poi_id"), "k", "left").select("claim_id", "poi_id"),
         "select claim_id, poi_id from {v_claim} c left join {v_poi} p on p.poi_id = c.event_id and (p.poi_id % 2 = 0) = (c.source_type = 'api')")
# known paths at, above and below the submitted ones
_KNOWN = "case event_id % 4 when 0 then '/e' when 1 then '/e/7' when 2 then '/e/' || (event_id % 700)::varchar || '/more/deep' else '/events' end"
register("d16_prefix_matches", lambda v: matching.path_matches(v("v_event"), v("v_event").where("source_type = 'ics' and event_id % 9 > 0").select("event_id", F.concat(F.regexp_extract("source_url", "^https://[^/]*", 0), F.when(F.col("event_id") % 4 == 0, "/e").when(F.col("event_id") % 4 == 1, "/e/7/?x=1").when(F.col("event_id") % 4 == 2, F.concat(F.lit("/e/"), (F.col("event_id") % 700).cast("string"), F.lit("/more/deep"))).otherwise("/events")).alias("source_url")), "event_id", "source_url"),
         f"""select e.event_id, min(k.event_id) as known_id from (select event_id, lower(regexp_extract(source_url, '^https://([^/]*)', 1)) as h, rtrim(regexp_extract(source_url, '^https://[^/]*([^?]*)', 1), '/') as p from {{v_event}}) e
join (select event_id, lower(regexp_extract(source_url, '^https://([^/]*)', 1)) as h, {_KNOWN} as p from {{v_event}} where source_type = 'ics' and event_id % 9 > 0) k on e.h = k.h and (e.p = k.p or starts_with(e.p, k.p || '/') or starts_with(k.p, e.p || '/')) group by 1""")
register("d19_record_lineage", lambda v: v("v_claim").select("claim_id", "event_id", "provider").join(v("v_event").select("event_id", "publish_status"), "event_id", "left").join(v("v_image").groupBy("event_id").agg(F.count(F.lit(1)).alias("images")), "event_id", "left").select("claim_id", "provider", "publish_status", F.coalesce("images", F.lit(0)).alias("images")),
         "select claim_id, provider, publish_status, coalesce(images, 0) as images from (select c.claim_id, c.provider, e.publish_status, i.images from {v_claim} c left join {v_event} e using (event_id) left join (select event_id, count(*) as images from {v_image} group by 1) i using (event_id))")


register("e11_poi_import", lambda v: (lambda p: p.withColumn("n", F.row_number().over(Window.partitionBy("poi_key").orderBy("poi_id"))).select("poi_id", F.when(F.col("category") == "Concert", "skipped").when(F.col("poi_key_confidence") == "weak", "weak_key").when(F.col("n") > 1, "duplicate").otherwise("created").alias("action")))(upsert.poi_key(v("v_poi"))).groupBy("action").agg(F.count(F.lit(1)).alias("n")),
         f"select case when category = 'Concert' then 'skipped' when k like 'name_location:%' then 'weak_key' when n > 1 then 'duplicate' else 'created' end as action, count(*) as n from (select *, row_number() over (partition by k order by poi_id) as n from (select poi_id, category, case when {sql_place('name')} <> '' and lat is not null and lng is not null then 'name_geo:' || {sql_place('name')} || printf('%.5f', lat) || '|' || printf('%.5f', lng) when places_id is not null then 'places_id:' || places_id when export_id is not null then 'export_id:' || export_id else 'name_location:' || {sql_place('name')} || '|' || city || '|' || state || '|' || coalesce(address, '') end as k from {{v_poi}})) group by 1")
register("e20_safe_update", lambda v: upsert.merge_fields(v("v_poi").select("poi_id", "phone", "website", "category"), v("v_poi").where("poi_id % 2 = 0").select("poi_id", F.lit("555-0000").alias("phone"), F.lit("").alias("website"), F.lit("Cultural").alias("category")), "poi_id", {"phone": "fill", "website": "replace", "category": "keep"}).select("poi_id", "phone", "website", "category", "action"),
         "select poi_id, case when poi_id % 2 = 0 and phone is null then '555-0000' else phone end as phone, website, category, case when poi_id % 2 > 0 then 'kept' when phone is null then 'updated' else 'skipped' end as action from {v_poi}")
register("e24_send_to_review", lambda v: v("v_event").where((F.col("dedupe_confidence") == "weak") & (F.col("duplicate_status") == "none")).select("event_id", F.lit("duplicate_candidate").alias("duplicate_status")), "select event_id, 'duplicate_candidate' as duplicate_status from {v_event} where dedupe_confidence = 'weak' and duplicate_status = 'none'")
register("e25_region_upsert", lambda v: upsert.merge_fields(v("v_region").where("region_id < 20").select("region_key", "name", "radius_miles"), v("v_region").where("region_id > 10").select("region_key", F.upper("name").alias("name"), (F.col("radius_miles") + 5).alias("radius_miles")), "region_key", {"name": "fill", "radius_miles": "raise"}).select("region_key", "name", "radius_miles", "action"),
         "select region_key, case when region_id >= 20 then upper(name) else name end as name, case when region_id > 10 then radius_miles + 5 else radius_miles end as radius_miles, case when region_id >= 20 then 'created' when region_id > 10 then 'updated' else 'kept' end as action from {v_region}")
register("f11_region_coverage", lambda v: v("v_claim").join(v("v_event").select("event_id", "region_id"), "event_id").groupBy("region_id").agg(F.countDistinct("source_id").alias("sources"), F.count_if(F.col("source_type") == "ics").alias("ics_claims")), "select region_id, count(distinct source_id) as sources, count_if(source_type = 'ics')::bigint as ics_claims from {v_claim} join {v_event} using (event_id) group by 1".replace("count_if(source_type", "count_if(c.source_type").replace("from {v_claim} join {v_event} using (event_id)", "from {v_claim} c join {v_event} e on e.event_id = c.event_id"))
register("f18_preview_summary", lambda v: rollups.metric_rows(rollups.preview_counts(filters.publishable(with_venue(v))), []),
         f"""select * from (unpivot (select count(*)::double as total_approved_events, count_if(coalesce(trim(image_url), '') = '')::double as events_missing_images, count_if(coalesce(trim(tickets_link), '') = '')::double as events_missing_ticket_links, count_if(coalesce(trim(venue_address), '') = '')::double as events_missing_venue_address,
 count_if(venue_lat is null or venue_lng is null)::double as events_missing_coordinates, count_if(contains(tickets_link, 'fbclid='))::double as events_with_suspicious_tracking, count_if(coalesce(trim(venue_name), '') = '')::double as events_without_venue_profile, count_if(duplicate_status = 'duplicate_candidate')::double as duplicate_candidate_events,
 count_if(dedupe_confidence = 'weak')::double as weak_dedupe_events, count_if(claim_count > 1)::double as events_with_multiple_source_claims, count_if(claim_count <= 1)::double as events_with_single_source_claim, count_if(image_url is not null and image_status in ('accepted', 'selected_pending_approval'))::double as events_with_selected_image,
 count_if(image_status = 'selected_pending_approval' or image_clearance = 'needs_review')::double as events_needing_image_approval, count_if(image_clearance = 'blocked')::double as events_with_blocked_image, count_if(coalesce(trim(headliner), '') = '')::double as events_missing_headliner, count_if(coalesce(trim(genre), '') = '')::double as events_missing_genre,
 {", ".join(f"count_if({TICKET} = '{c}')::double as ticket_{c}" for c in tickets.CATEGORIES)} from {{ev}} where publish_status in ('approved', 'published')) on columns(*) into name metric value value)""", ev=EV)
register("f20_research_summary", lambda v: rollups.metric_rows(v("pages").select(text.url_host("url").alias("h"), F.sha2("html", 256).alias("s")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("h").alias("hosts"), F.countDistinct("s").alias("bodies")), []),
         "select 'rows' as metric, count(*)::double as value from {pages} union all select 'hosts', count(distinct lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1))) from {pages} union all select 'bodies', count(distinct sha256(html)) from {pages}")
def _audited(v):
    rows = scores.risk(v("v_attempt"), {"rate_limit_exceeded": F.col("user_id") % 11 == 0, "authorization_missing": F.col("was_invalid"), "submitted_too_fast": F.col("value") < 1})
    return rows.withColumn("status", F.when(F.col("kind") == "view", "quarantined").otherwise("open"))


register("f23_audit_rollup", lambda v: rollups.metric_rows(rollups.audit_counts(_audited(v), v("v_crawl")), []),
         """select * from (unpivot (select count_if(l in ('high', 'blocked') or kind = 'view')::double as suspicious_submissions, count_if(l = 'blocked')::double as blocked_submissions, count_if(user_id % 11 = 0)::double as rate_limit_hits, count_if(was_invalid)::double as unauthorised_submissions, count_if(value < 1)::double as fast_submissions,
 (select count_if(contains(error, 'timeout'))::double from {v_crawl}) as crawl_timeouts, (select count_if(status = 'failed')::double from {v_crawl}) as failed_crawls, (select count_if(status = 'unsupported')::double from {v_crawl}) as unsupported_crawls
 from (select *, case when s >= 80 then 'blocked' when s >= 50 then 'high' when s >= 20 then 'medium' else 'low' end as l from (select *, case when user_id % 11 = 0 then 80 else 0 end + case when was_invalid then 80 else 0 end + case when value < 1 then 50 else 0 end as s from {v_attempt}))) on columns(*) into name metric value value)""")
register("f25_rescue_summary", lambda v: scores.image_score(v("v_image")).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("blocked")).alias("usable"), F.count_if("generic").alias("generic")), "select role, count(*) as n, count_if(not (clearance = 'blocked' or status = 'rejected' or url like '%logo%' or width < 720 or least(width, height) < 400))::bigint as usable, count_if(url like '%logo%')::bigint as generic from {v_image} group by 1")
register("f27_provider_pipeline", lambda v: v("v_claim").groupBy("provider", "source_type").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("event_id").alias("events"), F.round(F.avg("match_confidence"), 6).alias("confidence")), "select provider, source_type, count(*) as records, count(distinct event_id) as events, round(avg(match_confidence), 6) as confidence from {v_claim} group by 1, 2")
register("i19_source_rows", lambda v: v("v_attempt").select("attempt_id", F.when(F.col("attempt_id") % 4 > 0, "Org").alias("organization"), F.when(F.col("attempt_id") % 3 > 0, F.concat(F.lit("https://"), "domain")).otherwise(" ").alias("url"), F.when(F.col("attempt_id") % 5 > 0, F.col("email")).alias("email"), F.when(F.col("attempt_id") % 2 > 0, "Yes").otherwise("no").alias("confirmed"), F.when(F.col("attempt_id") % 7 == 0, "Sports").alias("category")).select("attempt_id", F.array_join(sheets.source_sheet_errors(category="category"), ",").alias("errors")),
         "select attempt_id, " + sql_flags(("attempt_id % 4 = 0", "organization_name_missing"), ("attempt_id % 3 = 0", "calendar_url_missing"), ("attempt_id % 5 = 0", "contact_email_missing"), ("attempt_id % 2 = 0", "authorization_missing"), ("attempt_id % 7 = 0", "expected_category_not_concert"), sort=True) + " as errors from {v_attempt}")
register("i21_preflight", lambda v: v("v_crawl").select("crawl_id", F.when(F.col("error").contains("timeout"), "timeout").when(F.col("status") == "failed", "unreachable").when(F.col("status") == "unsupported", "wrong_type").otherwise("ok").alias("preflight")), "select crawl_id, case when contains(error, 'timeout') then 'timeout' when status = 'failed' then 'unreachable' when status = 'unsupported' then 'wrong_type' else 'ok' end as preflight from {v_crawl}")
register("l01_rate_windows", lambda v: jobs.rate_counts(v("v_attempt").withColumn("created_at", F.col("created_at").cast("timestamp")), "ip_hash", slide="1 hour").select("ip_hash", F.unix_timestamp("window_start").alias("window_start"), "n"), "select ip_hash, (epoch(date_trunc('hour', created_at)))::bigint as window_start, count(*) as n from {v_attempt} group by 1, 2")
register("l04_running_health", lambda v: jobs.source_health_batch(v("v_crawl")), "select source_id, crawl_id, count(*) over w as runs, (count_if(status = 'success') over w)::bigint as ok, (sum(candidates) over w)::bigint as candidates, candidates = 0 and coalesce(sum(candidates) over (partition by source_id order by crawl_id rows between unbounded preceding and 1 preceding), 0) > 0 as dropped from {v_crawl} window w as (partition by source_id order by crawl_id)")
register("l05_sessions", lambda v: jobs.sessions(v("v_attempt").withColumn("created_at", F.col("created_at").cast("timestamp")), "user_id", gap="6 hours").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest")),
         "select user_id, count(*) as sessions, max(n) as longest from (select user_id, s, count(*) as n from (select *, sum(new) over (partition by user_id order by created_at, attempt_id) as s from (select *, case when created_at - lag(created_at) over (partition by user_id order by created_at, attempt_id) < interval 6 hours then 0 else 1 end as new from {v_attempt})) group by 1, 2) group by 1")
register("l06_late_attempts", lambda v: jobs.late_rows(v("v_attempt").select("attempt_id", "created_at", F.col("user_id").alias("shard"), (F.col("attempt_id") % 97 * 100000 + F.col("attempt_id")).alias("arrival")), "created_at", "2 days").groupBy("shard").agg(F.count(F.lit(1)).alias("late")),
         "select user_id as shard, count(*) as late from (select *, max(created_at) over (partition by user_id order by attempt_id % 97 * 100000 + attempt_id rows between unbounded preceding and 1 preceding) as m from {v_attempt}) where created_at < m - interval 2 days group by 1")
