"""Queries of the feeds, the review board, place buckets and the image screen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import filters, genres, images, places, review, rollups, tickets
from .q_columns import sql_flags, sql_genre, sql_haversine
from .q_extra import CAND, _candidates
from .q_scores import BLANK, TICKET
from .registry import register
from .views import AS_OF

_NOW = lambda: F.expr(AS_OF)


def _together(**frames):
    """Rows of several filters, each marked with its name."""
    return reduce(lambda a, b: a.unionByName(b), [rows.withColumn("wish", F.lit(name)) for name, rows in frames.items()])


def _unpivot(counts: dict[str, str], source: str) -> str:
    return "select * from (unpivot (select " + ", ".join(f"count_if({c})::double as {n}" for n, c in counts.items()) + f" from {source}) on columns(*) into name metric value value)"


# ---- feeds
def _feed_rows(v):
    place = v("v_venue").select("venue_id", "city", "state", "country")
    rows = v("v_event").join(place, "venue_id", "left").withColumn("normalized_genre", genres.genre("genre"))
    return rows.withColumns({"normalized_genres": F.when(F.col("event_id") % 20 == 0, F.array(F.lit("Rock"), F.lit("Jazz"))), "music_category": F.when(F.col("event_id") % 50 == 1, F.lit("Jazz"))})


_OPEN = "publish_status in ('approved', 'published') and duplicate_status not in ('duplicate_candidate', 'merged', 'rejected')"
_FEED = "select e.*, w.city, w.state, w.country from {v_event} e left join {v_venue} w on w.venue_id = e.venue_id"
register("c01_event_feed", lambda v: _together(
    dates=filters.event_feed(v("v_event"), start="1997-01-01", end="2001-06-01").select("event_id", "venue_id", "publish_status"),
    genre=filters.event_feed(_feed_rows(v), genre="Jazz").select("event_id", "venue_id", "publish_status"),
    place=filters.event_feed(_feed_rows(v), include_cancelled=True, include_needs_approval=False, country="ASIA", city="City 3").select("event_id", "venue_id", "publish_status")),
    f"""select event_id, venue_id, publish_status, 'dates' as wish from {{f}} where {_OPEN} and not regexp_matches(lower(event_status), 'cancell?ed') and start_ts >= timestamp '1997-01-01' and start_ts < timestamp '2001-06-01'
union all select event_id, venue_id, publish_status, 'genre' from {{f}} where {_OPEN} and not regexp_matches(lower(event_status), 'cancell?ed') and (coalesce(genre, '') = 'Jazz' or coalesce({sql_genre('genre')}, '') = 'Jazz' or event_id % 20 = 0 or event_id % 50 = 1)
union all select event_id, venue_id, publish_status, 'place' from {{f}} where {_OPEN} and image_status <> 'selected_pending_approval' and image_clearance <> 'needs_approval' and country = 'ASIA' and city = 'City 3'""", f=_FEED)


def _upcoming(v):
    """Upcoming events of the venue that has the place's number."""
    return rollups.upcoming(filters.event_feed(v("v_event"), include_cancelled=True), ["venue_id"], _NOW()).withColumnRenamed("venue_id", "poi_id")


_POIS = f"select p.*, coalesce(u.upcoming, 0) as upcoming from {{v_poi}} p left join (select venue_id, count(*) as upcoming from {{v_event}} where {_OPEN} and start_ts >= {AS_OF} group by 1) u on u.venue_id = p.poi_id where publish_status in ('approved', 'published') and lower(category) <> 'concert'"
register("c02_poi_feed", lambda v: _together(
    all=filters.poi_feed(v("v_poi"), _upcoming(v)).select("poi_id", "category", "upcoming"),
    busy=filters.poi_feed(v("v_poi"), _upcoming(v), has_upcoming=True, category="Cultural").select("poi_id", "category", "upcoming"),
    place=filters.poi_feed(v("v_poi"), _upcoming(v), subcategory="building", city="City 1", country="ASIA").select("poi_id", "category", "upcoming")),
    "select poi_id, category, upcoming, 'all' as wish from {p} union all select poi_id, category, upcoming, 'busy' from {p} where upcoming > 0 and category = 'Cultural' union all select poi_id, category, upcoming, 'place' from {p} where subcategory = 'building' and city = 'City 1' and country = 'ASIA'", p=_POIS)


# ---- review board
def review_rows(v):
    """Events, vendor records, extracted candidates and itineraries as rows of one board."""
    venue = v("v_venue").select("venue_id", F.col("name").alias("venue_name"), "address", "city", "state", "lat", "lng")
    publishable = F.col("publish_status").isin("approved", "published")
    events = v("v_event").join(venue, "venue_id", "left").select(
        F.lit("normalized_event").alias("record_type"), F.lit("Event").alias("record_label"), F.col("event_id").alias("id"), "title", "venue_name", "address", "city", "state", F.col("supporting_artists").alias("description"), "genre",
        F.coalesce("provider", "source_type").alias("source_label"), "provider", "source_type", "start_ts", "lat", "lng", F.col("publish_status").alias("review_status"), "image_status", tickets.assess(F.col("tickets_link")).getField("category").alias("ticket_status"), "duplicate_status",
        F.when(publishable, "ready").otherwise("blocked").alias("app_feed_readiness"), (F.col("publish_status") == "needs_review").alias("needs_review"), publishable.alias("app_feed_ready"), F.array("source_type", "dedupe_confidence").alias("source_badges"),
        text.flags((text.is_blank("address"), "Missing address"), (F.col("lat").isNull(), "Missing coordinates")).alias("venue_badges"), text.flags((text.is_blank("image_url"), "missing image"), (text.is_blank("tickets_link"), "missing ticket link")).alias("quality_flags"))
    claims = v("v_claim").where("source_type <> 'file_upload'")
    kind = F.col("source_type") == "api"
    waits = F.col("match_confidence") < 0.05
    others = claims.select(
        F.when(kind, "api_feed_record").otherwise("extracted_candidate").alias("record_type"), F.when(kind, "Vendor record").otherwise("Extracted").alias("record_label"), F.col("claim_id").alias("id"), F.col("record_id").alias("title"), F.col("provider").alias("source_label"), "provider", "source_type",
        F.col("seen_at").alias("start_ts"), F.when(waits, "needs_review").otherwise("approved").alias("review_status"), waits.alias("needs_review"), F.array("provider").alias("source_badges"), text.flags((F.col("provider_event_id").isNull(), "missing provider id")).alias("quality_flags"))
    stops = v("v_poi").where("category = 'Concert'").select(
        F.lit("itinerary").alias("record_type"), F.lit("Itinerary").alias("record_label"), F.col("poi_id").alias("id"), F.col("name").alias("title"), "address", "city", "state", "lat", "lng", F.col("publish_status").alias("review_status"), (F.col("publish_status") == "draft").alias("needs_review"))
    return review.review_rows(events, others, stops)


_R = lambda c: f"trim(coalesce({c}, ''))"
_T = TICKET.replace("tickets_link", "e.tickets_link")
REVIEW = f"""select 'normalized_event:' || event_id::varchar as row_key, 'normalized_event' as record_type, 'Event' as record_label, event_id as id, {_R('title')} as title, {_R('w.name')} as venue_name, {_R('w.address')} as address, {_R('w.city')} as city, {_R('w.state')} as state, {_R('supporting_artists')} as description, {_R('genre')} as genre,
 coalesce(provider, source_type) as source_label, {_R('provider')} as provider, source_type, start_ts, w.lat as lat, w.lng as lng, publish_status as review_status, image_status, {_T} as ticket_status, duplicate_status, case when publish_status in ('approved', 'published') then 'ready' else 'blocked' end as app_feed_readiness,
 publish_status = 'needs_review' as needs_review, publish_status in ('approved', 'published') as app_feed_ready, source_type || ',' || dedupe_confidence as source_badges, {sql_flags((BLANK.format('w.address'), 'Missing address'), ('w.lat is null', 'Missing coordinates'))} as venue_badges,
 {sql_flags((BLANK.format('image_url'), 'missing image'), (BLANK.format('tickets_link'), 'missing ticket link'))} as quality_flags from {{v_event}} e left join {{v_venue}} w on w.venue_id = e.venue_id
union all select case when source_type = 'api' then 'api_feed_record' else 'extracted_candidate' end || ':' || claim_id::varchar, case when source_type = 'api' then 'api_feed_record' else 'extracted_candidate' end, case when source_type = 'api' then 'Vendor record' else 'Extracted' end, claim_id, {_R('record_id')}, '', '', '', '', '', '', provider, provider, source_type, seen_at, null, null,
 case when match_confidence < 0.05 then 'needs_review' else 'approved' end, '', '', '', '', match_confidence < 0.05, false, provider, '', case when provider_event_id is null then 'missing provider id' else '' end from {{v_claim}} where source_type <> 'file_upload'
union all select 'itinerary:' || poi_id::varchar, 'itinerary', 'Itinerary', poi_id, {_R('name')}, '', {_R('address')}, city, state, '', '', '', '', '', null, lat, lng, publish_status, '', '', '', '', publish_status = 'draft', false, '', '', '' from {{v_poi}} where category = 'Concert'"""
register("h01_review_union", lambda v: review_rows(v).withColumns({c: F.array_join(c, ",") for c in review.LISTS} | {"start_ts": F.col("start_ts").cast("string")}), "select * replace (start_ts::varchar as start_ts) from {r}", r=REVIEW)
register("f14_review_tabs", lambda v: rollups.metric_rows(rollups.review_tabs(review_rows(v)), []),
         _unpivot({'"all"': "true", "normalized": "record_type = 'normalized_event'", "api": "record_type = 'api_feed_record'", "extracted": "record_type = 'extracted_candidate'", "needs_review": "needs_review", "ready_for_app": "app_feed_ready"}, "{r}"), r=REVIEW)
_AROUND = f"coalesce({sql_haversine('12.0', '16.0', 'lat', 'lng', geo.MILES)} <= 300, false)"
register("c03_review_board", lambda v: _together(**{n: r.select("row_key", "title") for n, r in {
    "text": filters.review_board(review_rows(v), tab="normalized", search=" Jazz fusion ", location="city 1", date_from="1996-02-01", date_to="1997-12-31", provider="FEED_", source_type="weak"),
    "flags": filters.review_board(review_rows(v), tab="needs_review", search="missing image", venue_status="missing_address", quality_issue="Ticket", review_status="needs", image_status="MISS", duplicate_status="none", genre=" "),
    "near": filters.review_board(review_rows(v), tab="ready_for_app", around=(12.0, 16.0, 300.0), state="nation_", ticket_status="direct", app_feed_readiness="ready"),
    "records": filters.review_board(review_rows(v), tab="api", search="rec-1", provider="feed_a", quality_issue="provider id"),
    "stops": filters.review_board(review_rows(v), around=(12.0, 16.0, 300.0), city=" "),
}.items()}),
    f"""select row_key, title, 'text' as wish from {{r}} where record_type = 'normalized_event' and contains(lower(genre), 'jazz fusion') and contains(lower(concat_ws(' ', venue_name, address, city, state)), 'city 1') and start_ts >= timestamp '1996-02-01' and start_ts < timestamp '1998-01-01' and (contains(provider, 'feed_') or contains(source_label, 'feed_')) and (contains(source_type, 'weak') or contains(source_badges, 'weak'))
union all select row_key, title, 'flags' from {{r}} where needs_review and contains(quality_flags, 'missing image') and contains(venue_badges, 'Missing address') and contains(quality_flags, 'ticket') and contains(review_status, 'needs') and contains(image_status, 'miss') and contains(duplicate_status, 'none')
union all select row_key, title, 'near' from {{r}} where app_feed_ready and coalesce({sql_haversine('12.0', '16.0', 'lat', 'lng', geo.MILES)} <= 300, true) and contains(lower(state), 'nation_') and contains(ticket_status, 'direct') and contains(app_feed_readiness, 'ready')
union all select row_key, title, 'records' from {{r}} where record_type = 'api_feed_record' and contains(title, 'rec-1') and provider = 'feed_a' and contains(quality_flags, 'provider id')
union all select row_key, title, 'stops' from {{r}} where {_AROUND}""", r=REVIEW)


# ---- place candidates
def _bucketed(v):
    """Place candidates with links to social pages and web pages among their images, and some without a category."""
    n = F.col("poi_id") % 13
    changed = {"image_url": F.when(n == 0, "https://www.facebook.com/band").when(n == 1, "https://site.example.com/page").otherwise(F.col("image_url")), "category": F.when(F.col("poi_id") % 17 == 0, "").otherwise(F.col("category"))}
    rows = _candidates(lambda what: v(what).withColumns(changed)).withColumns({
        "review_status": F.when(F.col("poi_id") % 4 == 0, "pending_review").when(F.col("poi_id") % 4 == 1, "needs_research").when(F.col("poi_id") % 4 == 2, "rejected"),
        "match_status": F.element_at(F.array(*[F.lit(m) for m in MATCHES]), (F.col("poi_id") % len(MATCHES) + 1).cast("int")),
    })
    return filters.poi_buckets(places.candidate_quality(rows))


MATCHES = ("matched_existing", "possible_duplicate", "new_candidate", "event_venue_only", "approved_created")
_MATCH = lambda m: f"poi_id % {len(MATCHES)} = {MATCHES.index(m)}"
BUCKETS = {
    "pending_review": "poi_id % 4 = 0", "matched_existing": _MATCH("matched_existing"), "possible_duplicate": _MATCH("possible_duplicate"), "new_candidate": _MATCH("new_candidate"), "needs_research": "poi_id % 4 = 1",
    "missing_coordinates": "(lat is null or lng is null)", "missing_image": "image_url is null", "bad_social_image": "(image_url is not null and (poi_id % 13 < 2 or image_url like '%logo%'))", "missing_category": "category = ''",
    "weak_music_signal": "signal < 55", "event_venue_only": _MATCH("event_venue_only"), "approved_created": _MATCH("approved_created"), "rejected": "poi_id % 4 = 2",
}
_CHANGED = "(select * replace (case when poi_id % 13 < 2 then 'https://x' else image_url end as image_url, case when poi_id % 17 = 0 then '' else category end as category) from {v_poi})"
BUCKETED = CAND.replace("{v_poi}", _CHANGED)
register("c08_poi_buckets", lambda v: _bucketed(v).select("poi_id", *BUCKETS), "select poi_id, " + ", ".join(f"coalesce({c}, false) as {n}" for n, c in BUCKETS.items()) + " from {c}", c=BUCKETED)
register("f16_poi_bucket_counts", lambda v: rollups.metric_rows(rollups.conditional_counts(_bucketed(v), [], {n: F.col(n) for n in BUCKETS}), []), _unpivot(BUCKETS, "{c}"), c=BUCKETED)


# ---- images
def _owned(v):
    rows = v("v_picture").withColumn("qa_flags", F.filter(F.split("qa_text", ","), lambda f: f != ""))
    return images.with_owners(rows, v("v_picture_event"), v("v_picture_venue"))


REASONS = sql_flags(
    ("p.status = 'rejected'", "candidate rejected"), ("p.clearance = 'rejected'", "clearance rejected"), ("not is_accessible", "image inaccessible"), ("not is_direct", "not direct image asset"), ("is_social", "social media URL"),
    ("evidence_only", "source evidence only"), ("not can_be_final", "not eligible as final image"), ("generic_score >= 70", "generic provider image"), ("text_score >= 90", "text graphic"), ("poster_score >= 70", "poster or flyer score"), ("admat_score >= 70", "admat score"),
    ("p.role = 'logo'", "logo or social screenshot"), ("is_poster", "poster or flyer"), ("has_text", "text-heavy image"), ("has_watermark", "watermark suspected"), ("has_logo", "logo detected"), ("is_stock", "stock placeholder"),
    ("is_food", "unrelated food or drink image"), ("is_unrelated_place", "unrelated place image"), ("is_generic_crowd and not shows_artist and not shows_live", "generic crowd without music signal"), ("width < 720 or (width is not null and least(width, height) < 400)", "severe low resolution"),
)
_ARTIST = "(role in ('artist_live', 'artist_press') or coalesce(rescue_source = 'provider_artist_image', false))"
OWNED = f"""select p.*, {REASONS} as reasons, coalesce(e.selected_image_id = p.image_id, false) as of_event, coalesce(e.selected_image_id = p.image_id or w.selected_image_id = p.image_id, false) as selected,
 coalesce(e.selected_image_id = p.image_id and e.image_status in ('selected_pending_approval', 'venue_fallback') and e.image_clearance = 'needs_approval', false) or coalesce(w.selected_image_id = p.image_id and w.image_status in ('selected_pending_approval', 'venue_fallback') and w.image_clearance = 'needs_approval', false) as pending,
 coalesce(e.selected_image_id = p.image_id and e.image_status in ('accepted', 'venue_fallback') and e.image_clearance = 'approved', false) or coalesce(w.selected_image_id = p.image_id and w.image_status in ('accepted', 'venue_fallback') and w.image_clearance in ('approved', 'licensed'), false) as cleared,
 case when e.event_id is not null then {BLANK.format('e.selected_url')} when w.venue_id is not null then {BLANK.format('w.selected_url')} else false end as no_owner_image, e.event_id is not null and not a.artist as no_artist
from {{v_picture}} p left join (select event_id, bool_or{_ARTIST} as artist from {{v_picture}} group by 1) a on a.event_id = p.event_id left join {{v_picture_event}} e on e.event_id = p.event_id left join {{v_picture_venue}} w on w.venue_id = p.venue_id"""
WISHES = {
    "stock_placeholder_candidate": "is_stock", "text_detected": "has_text", "watermark_detected": "has_watermark", "poster_or_flyer": "is_poster", "missing_dimensions": "(width is null or height is null)", "low_resolution": "contains(qa_text, 'low resolution image')",
    "needs_approval": "clearance = 'needs_approval'", "selected": "selected", "selected_pending_approval": "pending", "selected_and_cleared": "cleared", "selected_but_needs_approval": "pending", "hard_blocked": "reasons <> ''", "missing_image": "no_owner_image",
    "source_evidence_only": "evidence_only", "can_be_final_image": "can_be_final", "selected_by_rescue": "coalesce(selected_reason, '') like '%photo_rescue%'", "missing_artist_image": "no_artist",
}
register("c09_image_filter", lambda v: _together(**{n: r.select("image_id", "width") for n, r in {
    "named": filters.images(_owned(v), status="accepted", role="event_provider", clearance="needs_approval", source_type="api", source_provider="feed_a", rescue_source="provider_artist_image"),
    "flagged": filters.images(_owned(v), {"can_be_final_image": True, "text_detected": True, "hard_blocked": True, "selected": False}, quality_flag="poster_flyer_admat"),
    "free": filters.images(_owned(v), {"hard_blocked": False}),
}.items()}),
    """select image_id, width, 'named' as wish from {o} where status = 'accepted' and role = 'event_provider' and clearance = 'needs_approval' and source_type = 'api' and source_provider = 'feed_a' and rescue_source = 'provider_artist_image'
union all select image_id, width, 'flagged' from {o} where can_be_final and has_text and reasons <> '' and not selected and contains(qa_text, 'poster_flyer_admat') union all select image_id, width, 'free' from {o} where reasons = ''""", o=OWNED)
register("c09_image_wishes", lambda v: rollups.metric_rows(rollups.conditional_counts(_owned(v), [], filters.image_wishes()), []), _unpivot(WISHES, "{o}"), o=OWNED)
register("i08_blocking_reasons", lambda v: v("v_picture").select("image_id", "event_id", F.array_join(images.blocking_reasons(), ",").alias("reasons"), F.array_join(images.blocking_reasons(override=True), ",").alias("final_reasons")),
         f"select image_id, event_id, {REASONS} as reasons, {sql_flags(('p.status = ' + repr('rejected'), 'candidate rejected'), ('p.clearance = ' + repr('rejected'), 'clearance rejected'), ('not is_accessible', 'image inaccessible'), ('not is_direct', 'not direct image asset'), ('is_social', 'social media URL'))} as final_reasons from {{v_picture}} p")
FOUND = f"""select event_id, bool_or(reasons <> '') as hard, bool_or(is_stock) as stock, bool_or(has_text) as texts, bool_or(has_watermark) as marks, bool_or(is_poster) as poster, bool_or(of_event and coalesce(selected_reason, '') like '%photo_rescue%') as rescued,
 bool_or(generic_score >= 70 or contains(qa_text, 'generic_provider_image')) as generic, bool_or(poster_score >= 70 or admat_score >= 70 or contains(qa_text, 'poster_flyer_admat')) as admat, bool_or(evidence_only or coalesce(rescue_source = 'social_graphic_reference', false)) as evidence,
 bool_or{_ARTIST} as artist, bool_or(status = 'accepted' and clearance <> 'rejected' and is_accessible and is_direct and not is_social and {_ARTIST}) as accepted_artist, bool_or(of_event and status = 'accepted' and source_type in ('manual', 'upload')) as manual,
 bool_or(of_event and (is_stock or is_poster or generic_score >= 70 or coalesce(rescue_source = 'social_graphic_reference', false) or evidence_only)) as weak, bool_and(evidence_only or reasons <> '') as only_evidence,
 max(case when of_event then array_to_string(string_split(reasons, ',')[1:3], ',') end) as first_reasons from {{o}} group by 1"""
register("f17_image_qa_counts", lambda v: rollups.metric_rows(images.quality_counts(v("v_picture_event"), images.of_events(_owned(v)), v("v_picture_venue")), []),
         "select * from (unpivot (select " + ", ".join(f"count_if({c})::double as {n}" for n, c in {
             "events_with_selected_image": "s", "events_with_selected_image_pending_approval": "s and image_clearance = 'needs_approval'", "events_with_selected_cleared_image": "s and image_clearance = 'approved'", "events_missing_usable_image": "not s", "events_using_venue_fallback": "image_status = 'venue_fallback'",
             "events_using_provider_image_pending_approval": "s and image_clearance = 'needs_approval' and image_role = 'event_provider'", "events_with_hard_blocked_image_candidates": "hard", "events_with_provider_stock_candidate": "stock", "events_needing_image_approval": "image_clearance = 'needs_approval' or image_status = 'selected_pending_approval'",
             "events_with_text_heavy_image_candidates": "texts", "events_with_watermark_candidates": "marks", "events_with_poster_flyer_candidates": "poster", "events_with_accepted_artist_images": "image_status in ('accepted', 'selected_pending_approval') and image_role = 'artist_live'", "events_with_accepted_venue_fallback_images": "image_status = 'venue_fallback'",
             "events_selected_by_photo_rescue": "rescued", "events_with_generic_provider_image_blocked": "generic", "events_with_poster_flyer_admat_blocked": "admat", "events_with_social_graphic_evidence": "evidence", "events_with_artist_image_candidates": "artist",
         }.items()) + f", (select count_if(image_clearance = 'needs_approval')::double from {{v_picture_venue}}) as venues_needing_image_approval from (select e.*, f.*, not ({BLANK.format('e.selected_url')}) as s from {{v_picture_event}} e left join {{found}} f on f.event_id = e.event_id)) on columns(*) into name metric value value)", o=OWNED, found=FOUND)
_REASON = """case when publish_status in ('rejected', 'stale') or lower(event_status) = 'cancelled' then 'event_rejected_expired_or_stale' when coalesce(manual, false) then 'manual_accepted_image_exists' when coalesce(accepted_artist, false) then 'accepted_artist_image_exists'
 when coalesce(trim(tickets_link), '') = '' then 'missing_ticket_url' when tickets_link like '%facebook%' then 'ticket_link_not_usable:unresolved' when coalesce(selected_url, '') = '' then 'missing_selected_image' when image_status = 'missing' then 'selected_image_status:missing'
 when coalesce(first_reasons, '') <> '' then 'selected_image_blocked:' || first_reasons when coalesce(weak, false) then 'selected_provider_image_weak' when coalesce(only_evidence, false) then 'only_evidence_or_blocked_images' else 'usable_image_exists' end"""
register("i12_page_fallback", lambda v: images.page_fallback(v("v_picture_event"), images.of_events(_owned(v))),
         f"select event_id, starts_with(reason, 'missing_selected') or starts_with(reason, 'selected_') or starts_with(reason, 'only_') as fetch, reason from (select e.event_id, {_REASON} as reason from {{v_picture_event}} e left join {{found}} f on f.event_id = e.event_id)", o=OWNED, found=FOUND)
