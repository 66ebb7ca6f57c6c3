"""Queries of readiness, quality, tickets, images, trust and risk."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import genres, images, rollups, scores, tickets
from ..operators.rollups import source_metrics
from .q_columns import sql_flags, sql_genre
from .registry import register
from .views import AS_OF

_AS_OF = lambda: F.expr(AS_OF)


def with_venue(v):
    """Events with the columns of their venue."""
    venue = v("v_venue").select("venue_id", F.col("name").alias("venue_name"), F.col("address").alias("venue_address"), F.col("lat").alias("venue_lat"), F.col("lng").alias("venue_lng"))
    return v("v_event").join(venue, "venue_id", "left")


EV = "select e.*, w.name as venue_name, w.address as venue_address, w.lat as venue_lat, w.lng as venue_lng from {v_event} e left join {v_venue} w on e.venue_id = w.venue_id"
BLANK = "coalesce(trim({0}), '') = ''"
DEAD = "regexp_matches(lower(coalesce(event_status, '')), 'cancell?ed|postponed')"
PENDING = "(image_clearance = 'needs_review' or image_status = 'selected_pending_approval')"
BLOCKERS = (
    (BLANK.format("title"), "missing_title"),
    ("start_ts is null", "missing_start"),
    (BLANK.format("venue_name"), "missing_venue"),
    ("coalesce(trim(venue_address), '') = '' and (venue_lat is null or venue_lng is null)", "missing_venue_location"),
    (BLANK.format("tickets_link"), "missing_ticket_link"),
    ("image_clearance = 'blocked' or image_status = 'rejected'", "image_hard_blocked"),
    ("duplicate_status in ('duplicate_candidate', 'merged', 'rejected')", "duplicate_excluded"),
    (DEAD, "not_active"),
)
HINTS = (
    (BLANK.format("image_url"), "missing_image"),
    (PENDING, "image_needs_approval"),
    ("coalesce(claim_count, 0) <= 0", "missing_source_claim"),
    ("coalesce(trim(provider), '') = '' and coalesce(trim(source_type), '') = ''", "missing_source_trust_signal"),
)
N_BAD = " + ".join(f"case when {c} then 1 else 0 end" for c, _ in (*BLOCKERS, *HINTS))
READY = f"select *, round_even((12 - ({N_BAD})) * 100 / 12.0, 0)::bigint as readiness, {sql_flags(*BLOCKERS)} as blockers, {sql_flags(*HINTS)} as hints from {{ev}}"
# the given links are blank, a social page, a home page or an event page of a ticket host
TICKET = "case when coalesce(trim(tickets_link), '') = '' then 'blank' when tickets_link like '%facebook%' then 'unresolved' else 'direct' end"
BAD_TICKET = "(tickets_link like '%facebook%')"
FEED_READY = f"(publish_status in ('approved', 'published') and readiness >= 80 and blockers = '' and not {PENDING})"
DUP = "duplicate_status not in ('', 'none', 'unique', 'resolved', 'kept_separate')"
POINTS = f"""(case when not {BLANK.format('title')} then 8 else 0 end + case when start_ts is not null then 8 else 0 end + case when not {BLANK.format('venue_name')} then 8 else 0 end
 + case when venue_lat is not null or not {BLANK.format('venue_address')} then 7 else 0 end + case when not {BLANK.format('tickets_link')} then 7 else 0 end
 + case when not {BLANK.format('tickets_link')} and not {BAD_TICKET} then 8 else 0 end + case when image_url is not null and image_status in ('accepted', 'selected_pending_approval') then 9 else 0 end
 + case when image_url is not null and image_clearance <> 'blocked' then 8 else 0 end + case when image_url is not null and not {PENDING} then 7 else 0 end
 + case when headliner is not null then 7 else 0 end + case when relevance >= 50 then 7 else 0 end + case when not {DUP} then 7 else 0 end + case when claim_count > 0 then 4 else 0 end + case when {FEED_READY} then 5 else 0 end)"""

# The quality buckets.
BUCKETS = (
    "missing_image", "selected_image_pending_approval", "generic_provider_image_blocked", "poster_flyer_admat_blocked", "social_graphic_evidence_only", "missing_ticket_link", "bad_generic_ticket_link", "missing_venue", "missing_coordinates",
    "duplicate_candidate", "weak_dedupe_confidence", "low_music_relevance", "missing_artist_headliner", "missing_genre", "not_app_feed_ready", "recently_updated", "multiple_source_claims",
)
register("i01_event_readiness", lambda v: scores.event_readiness(with_venue(v)).select("event_id", "readiness", F.array_join("blockers", ",").alias("blockers"), F.array_join("hints", ",").alias("hints")), "select event_id, readiness, blockers, hints from {ready}", ev=EV, ready=READY)
register("i02_poi_readiness", lambda v: scores.poi_readiness(v("v_poi")).select("poi_id", "readiness", F.array_join("blockers", ",").alias("blockers"), F.array_join("hints", ",").alias("hints")),
         "select poi_id, round_even((8 - n) * 100 / 8.0, 0)::bigint as readiness, blockers, hints from (select poi_id, "
         + " + ".join(f"case when {c} then 1 else 0 end" for c in ("trim(name) = ''", "(lat is null or lng is null) and address is null", "coalesce(quality_control, '') <> ''", "subcategory is null", "website is null and places_id is null", "image_url is null or image_url like '%logo%'"))
         + " as n, " + sql_flags(("trim(name) = ''", "missing_name"), ("(lat is null or lng is null) and address is null", "missing_location"), ("coalesce(quality_control, '') <> ''", "possible_duplicate"))
         + " as blockers, " + sql_flags(("subcategory is null", "missing_subcategory"), ("website is null and places_id is null", "missing_website_or_source_url"), ("image_url is null or image_url like '%logo%'", "missing_image")) + " as hints from {v_poi})")
register("i03_event_quality", lambda v: scores.event_quality(scores.event_readiness(with_venue(v))).select("event_id", "quality", "feed_ready"), f"select event_id, {POINTS}::bigint as quality, coalesce({FEED_READY}, false) as feed_ready from {{ready}}", ev=EV, ready=READY)
register("f15_quality_buckets", lambda v: rollups.zero_filled(scores.event_quality(scores.event_readiness(with_venue(v))).select(F.explode("quality_flags").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), list(BUCKETS), "bucket", "n"),
         f"""select b as bucket, coalesce(n, 0) as n from (values {", ".join(f"('{x}')" for x in BUCKETS)}) k(b) left join (select bucket, count(*) as n from (select unnest(list_distinct(string_split(concat_ws(',', nullif(blockers, ''), nullif(hints, ''), nullif({sql_flags((BAD_TICKET, 'bad_generic_ticket_link'), ('venue_lat is null', 'missing_coordinates'), (DUP, 'duplicate_candidate'), ("dedupe_confidence in ('weak', 'medium')", 'weak_dedupe_confidence'), ('relevance < 50', 'low_music_relevance'), ('headliner is null', 'missing_artist_headliner'), ('genre is null', 'missing_genre'), (f'coalesce(not {FEED_READY}, true)', 'not_app_feed_ready'), ('claim_count > 1', 'multiple_source_claims'))}, '')), ','))) as bucket from {{ready}}) where bucket <> '' group by 1) f on f.bucket = b""", ev=EV, ready=READY)
# links of every class, and what the operator has to say of them
LINKS = (
    ("", "blank", False, 0, "", "api_backfill_required"),
    ("no url at all", "suspicious", False, 5, "malformed ticket URL", "reject_malformed"),
    ("https://www.awin1.com/cread.php?id=1&utm_source=x", "redirect_or_handoff", False, 32, "affiliate/tracking domain,tracking parameter", "resolve_affiliate_handoff"),
    ("https://www.eventbrite.com/checkout-external?eid=1", "platform_generic_or_app", False, 18, "session/cart-like ticket URL", "reject_checkout_external"),
    ("https://link.dice.fm/x", "platform_generic_or_app", False, 18, "", "reject_generic_app_handoff"),
    ("https://www.ticketmaster.com/artist/1", "platform_generic_or_app", False, 20, "", "reject_generic_platform_page"),
    ("https://www.ticketmaster.com/event/1", "platform_event", True, 84, "", "keep_platform_event"),
    ("https://www.eventbrite.com/e/1?aff=oddt", "platform_event", True, 72, "affiliate/tracking parameter", "keep_platform_event"),
    ("https://dice.fm/event/1", "platform_event", True, 78, "", "keep_platform_event"),
    ("https://dice.fm/partners", "platform_generic_or_app", False, 20, "", "reject_generic_platform_page"),
    ("https://www.axs.com/events/1", "platform_event", True, 82, "", "keep_platform_event"),
    ("https://shop.tixr.com/", "platform_generic_or_app", False, 24, "", "reject_generic_platform_page"),
    ("https://bit.ly/tickets1", "redirect_or_handoff", True, 68, "", "keep_redirect_or_handoff"),
    ("https://seetickets.us/e/1", "redirect_or_handoff", True, 68, "", "keep_redirect_or_handoff"),
    ("https://tinyurl.com/abc", "unresolved", False, 28, "", "api_backfill_required"),
    ("https://shop.example.com/cart?id=1", "suspicious", False, 12, "session/cart-like ticket URL", "reject_session_or_cart_url"),
    ("https://www.boxoffice.example.com/1?fbclid=2", "direct", True, 80, "click tracking parameter", "keep_direct"),
    ("https://hall.example.com/calendar", "non_ticket", False, 30, "", "reject_non_ticket"),
    ("https://band.example.com/1", "unresolved", False, 42, "", "api_backfill_required"),
    ("https://band.example.com/1?utm_medium=m", "unresolved", False, 30, "tracking parameter", "api_backfill_required"),
)
_LINK_ROWS = ", ".join(f"({i}, '{c}', {str(u).lower()}, {n}, '{f}', '{r}')" for i, (_, c, u, n, f, r) in enumerate(LINKS))


def _links(v):
    """Every claim with a link of its own."""
    return v("v_claim").withColumn("link", F.element_at(F.array(*[F.lit(u) for u, *_ in LINKS]), (F.col("claim_id") % len(LINKS) + 1).cast("int")))


register("i05_ticket_links", lambda v: _links(v).select("claim_id", tickets.assess(F.col("link")).alias("a")).select("claim_id", "a.category", "a.usable", F.col("a.score").cast("long").alias("score"), F.array_join("a.flags", ",").alias("flags"), "a.repair"),
         f"select claim_id, category, usable, score::bigint as score, flags, repair from {{v_claim}} join (values {_LINK_ROWS}) l(i, category, usable, score, flags, repair) on claim_id % {len(LINKS)} = i")
register("i05_best_ticket_link", lambda v: tickets.best_links(v("v_event"), "venue_id", "tickets_link", "event_id").select("venue_id", "category", "tickets_link"),
         f"select venue_id, category, tickets_link from (select venue_id, tickets_link, {TICKET} as category, row_number() over (partition by venue_id order by case {TICKET} when 'direct' then 0 when 'blank' then 2 else 1 end, event_id, tickets_link nulls last) as n from {{v_event}}) where n = 1")
register("i05_link_audit", lambda v: _links(v).select("provider", tickets.assess(F.col("link")).getField("category").alias("category")).groupBy("provider", "category").agg(F.count(F.lit(1)).alias("n")), f"select provider, category, count(*) as n from {{v_claim}} join (values {_LINK_ROWS}) l(i, category, usable, score, flags, repair) on claim_id % {len(LINKS)} = i group by 1, 2")
register("i06_music_relevance", lambda v: genres.relevance(v("v_event").join(v("v_venue").select("venue_id", F.col("venue_id").alias("known")), "venue_id", "left").select("event_id", F.when(F.col("event_id") % 4 == 0, "Music").when(F.col("event_id") % 9 == 0, "sports").alias("segment"), F.col("genre").alias("category_text"), "provider", "headliner", (F.col("claim_count") > 0).alias("has_artist"), F.lit("Music Site").alias("venue_category"), F.col("known").isNotNull().alias("has_venue"), F.col("tickets_link").isNotNull().alias("has_ticket"))).select("event_id", "relevance"),
         "select event_id, greatest(0.0, least(100.0, 50.0 + case when event_id % 4 = 0 then 24 when event_id % 9 = 0 then -35 else 0 end + case when headliner is not null then 10 else -8 end + case when claim_count > 0 then 8 else 0 end + 8 + case when tickets_link is not null then 4 else 0 end - case when w.venue_id is null then 5 else 0 end))::double as relevance from {v_event} e left join {v_venue} w using (venue_id)")

IMG = """select *, url like '%logo%' as generic, clearance = 'blocked' or status = 'rejected' or url like '%logo%' or width < 720 or least(width, height) < 400 as blocked,
 round(greatest(0.0, least(100.0, case role when 'headliner' then 100.0 when 'event' then 72.0 when 'venue_live' then 56.0 when 'venue_exterior' then 42.0 when 'promo' then 88.0 else 24.0 end::double * 0.28::double
 + case when width >= 1200 and height >= 600 then 100.0 when width >= 720 then 70.0 when width >= 320 then 40.0 else 10.0 end::double * 0.24::double
 + case when role in ('headliner', 'event') then 90.0 when role like 'venue%' then 60.0 else 30.0 end::double * 0.2::double + 80.0::double * 0.16::double
 + case clearance when 'approved' then 100.0 when 'needs_review' then 50.0 else 0.0 end::double * 0.12::double - case when url like '%logo%' then 45.0 else 0.0 end + 6.0)), 2)::double as image_score from {v_image}"""
_PICK = "select * from (select *, row_number() over (partition by event_id order by case when status = 'accepted' and not blocked then 0 when not blocked and role in ('headliner', 'event') then 1 when not blocked and role in ('venue_live', 'venue_exterior') then 2 else 3 end, image_score desc, image_id) as n from {img}) where n = 1"
register("i10_image_selection", lambda v: images.select_images(v("v_event").select("event_id"), scores.image_score(v("v_image"))).select("event_id", "image_id", "selection"),
         "select e.event_id, case when p.tier < 3 then image_id end as image_id, case when p.event_id is null then 'missing' when p.tier = 3 then 'needs_review' when p.tier = 2 then 'venue_fallback' when clearance = 'approved' then 'accepted' else 'selected_pending_approval' end as selection from {v_event} e left join (select *, case when status = 'accepted' and not blocked then 0 when not blocked and role in ('headliner', 'event') then 1 when not blocked and role in ('venue_live', 'venue_exterior') then 2 else 3 end as tier from {pick}) p using (event_id)", img=IMG, pick=_PICK)
register("g02_best_image", lambda v: scores.image_score(v("v_image")).withColumn("n", F.row_number().over(Window.partitionBy("event_id").orderBy((F.col("status") != "accepted").cast("int"), "priority", F.col("image_score").desc(), "image_id"))).where("n = 1").select("event_id", "image_id"),
         "select event_id, image_id from (select *, row_number() over (partition by event_id order by (status <> 'accepted')::int, priority, image_score desc, image_id) as n from {img}) where n = 1", img=IMG)

SRC = "select c.source_id, e.*, coalesce(i.generic, 0) as generic from (select distinct source_id, event_id from {v_claim}) c join {ev} e on e.event_id = c.event_id left join (select event_id, count_if(url like '%logo%')::bigint as generic from {v_image} group by 1) i on i.event_id = e.event_id"
COUNTS = f"""count(*) as event_count, count_if({BLANK.format('tickets_link')})::bigint as missing_ticket_count, count_if({BAD_TICKET})::bigint as bad_ticket_count, count_if({BLANK.format('image_url')})::bigint as missing_image_count,
 count_if(image_status in ('selected_pending_approval', 'needs_approval') or image_clearance = 'needs_approval')::bigint as pending_image_count, count_if(venue_id is null and {BLANK.format('location_text')})::bigint as missing_venue_count, count_if(venue_lat is null or venue_lng is null)::bigint as missing_geo_count,
 count_if(publish_status in ('approved', 'published'))::bigint as ready_count, count_if(publish_status in ('rejected', 'stale', 'archived', 'unpublished'))::bigint as blocked_count, 0::bigint as correction_count, count_if(duplicate_status not in ('', 'none', 'unique', 'resolved'))::bigint as duplicate_count, sum(generic)::bigint as generic_image_count, sum(claim_count)::bigint as claim_count, round_even(count_if(duplicate_status not in ('', 'none', 'unique', 'resolved')) / count(*), 4)::double as duplicate_rate"""
METRICS = f"""select s.*, coalesce(c.success_count, 0) as success_count, coalesce(c.failure_count, 0) as failure_count, coalesce(c.unsupported_count, 0) as unsupported_count, c.last_success_at, s.blocked_count as rejected_count
from (select source_id, {COUNTS} from {{src}} group by 1) s left join (select source_id, count_if(status = 'success')::bigint as success_count, count_if(status = 'failed')::bigint as failure_count, count_if(status = 'unsupported')::bigint as unsupported_count, max(case when status = 'success' then fetched_at end) as last_success_at from {{v_crawl}} group by 1) c on c.source_id = s.source_id"""


def with_generic(v, events):
    """Events with how many of their image candidates are generic graphics."""
    generic = scores.image_score(v("v_image")).groupBy("event_id").agg(F.count_if("generic").alias("generic_images"))
    return events.join(generic, "event_id", "left")


def sources(v):
    """Metrics of every source that claims an event."""
    claimed = v("v_claim").select("source_id", "event_id").distinct()
    return source_metrics(with_generic(v, with_venue(v)), claimed, v("v_crawl"))


_SHOWN = ("event_count", "success_count", "failure_count", "unsupported_count", "duplicate_count", "duplicate_rate", "missing_ticket_count", "bad_ticket_count", "missing_image_count", "generic_image_count", "pending_image_count", "missing_venue_count", "missing_geo_count", "ready_count", "blocked_count", "correction_count", "claim_count")
register("f05_source_metrics", lambda v: sources(v).select("source_id", *_SHOWN, F.col("last_success_at").cast("string").alias("last_success_at")), f"select source_id, {', '.join(_SHOWN)}, last_success_at::varchar as last_success_at from {{m}}", m=METRICS, src=SRC, ev=EV)
register("f06_provider_rollup", lambda v: (lambda e, c: e.join(c, "provider", "full").select("provider", F.greatest(F.coalesce("event_count", F.lit(0)), F.coalesce("records", F.lit(0))).alias("event_count"), *[F.greatest(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))).alias(a) for a, b in (("missing_ticket_count", "no_id"), ("duplicate_count", "doubtful"), ("ready_count", "confident"))], *[F.coalesce(a, F.lit(0)).alias(a) for a in ("missing_image_count", "missing_geo_count", "bad_ticket_count", "generic_image_count")]))(rollups.event_metrics(with_generic(v, with_venue(v)).where("provider is not null"), ["provider"]), v("v_claim").groupBy("provider").agg(F.countDistinct("event_id").alias("records"), F.count_if(F.col("provider_event_id").isNull()).alias("no_id"), F.count_if(F.col("match_confidence") < 0.02).alias("doubtful"), F.count_if(F.col("match_confidence") >= 0.08).alias("confident"))),
         f"select coalesce(e.provider, c.provider) as provider, greatest(coalesce(event_count, 0), coalesce(records, 0)) as event_count, greatest(coalesce(missing_ticket_count, 0), coalesce(no_id, 0)) as missing_ticket_count, greatest(coalesce(duplicate_count, 0), coalesce(doubtful, 0)) as duplicate_count, greatest(coalesce(ready_count, 0), coalesce(confident, 0)) as ready_count, coalesce(missing_image_count, 0) as missing_image_count, coalesce(missing_geo_count, 0) as missing_geo_count, coalesce(bad_ticket_count, 0) as bad_ticket_count, coalesce(generic_image_count, 0) as generic_image_count from (select provider, {COUNTS} from {{egen}} where provider is not null group by 1) e full join (select provider, count(distinct event_id) as records, count_if(provider_event_id is null)::bigint as no_id, count_if(match_confidence < 0.02)::bigint as doubtful, count_if(match_confidence >= 0.08)::bigint as confident from {{v_claim}} group by 1) c on e.provider = c.provider",
         egen="select e.*, coalesce(i.generic, 0) as generic from {ev} e left join (select event_id, count_if(url like '%logo%')::bigint as generic from {v_image} group by 1) i on i.event_id = e.event_id", ev=EV)
_LOSS = "100.0 - least(25.0, failure_count * 12.0) - least(18.0, unsupported_count * 8.0) - least(22.0, duplicate_rate * 35.0) - least(18.0, rejected_count * 4.0) - least(18.0, missing_ticket_count / e * 22.0) - least(16.0, missing_image_count / e * 20.0) - least(10.0, missing_geo_count / e * 14.0) - least(16.0, bad_ticket_count / e * 20.0) - least(12.0, generic_image_count * 4.0) - least(8.0, pending_image_count * 2.0) - least(12.0, missing_venue_count / e * 18.0) - least(10.0, blocked_count * 3.0) - least(8.0, correction_count * 1.5) + case when claim_count > event_count then 3.0 else 0.0 end + least(8.0, ready_count / e * 10.0) + least(6.0, success_count * 2.0) + least(5.0, greatest(0.0, event_count - missing_image_count) / e * 5.0) + least(5.0, greatest(0.0, event_count - missing_ticket_count) / e * 5.0)"
TRUST = f"select *, round_even(greatest(0.0, least(100.0, {_LOSS} - case when last_success_at is null then 8.0 else 0.0 end + case when last_success_at >= {AS_OF} - interval 45 days then 3.0 else 0.0 end)), 1)::double as t from (select *, greatest(event_count, 1)::double as e from {{m}})"
register("i15_source_trust", lambda v: scores.trust(sources(v), _AS_OF()).select("source_id", F.round("trust", 0).alias("trust"), "trust_grade"),
         f"select source_id, round(t, 0) as trust, case when t >= 90 then 'excellent' when t >= 75 then 'good' when t >= 60 then 'fair' when t >= 40 then 'poor' else 'blocked' end as trust_grade from (select source_id, round_even(greatest(0.0, least(100.0, {_LOSS} - case when last_success_at is null then 8.0 else 0.0 end + case when last_success_at >= {AS_OF} - interval 45 days then 3.0 else 0.0 end)), 1)::double as t from (select *, greatest(event_count, 1)::double as e from {{m}}))", m=METRICS, src=SRC, ev=EV)
register("i15_recommendations", lambda v: sources(v).select("source_id", F.array_join(scores.recommendations(3), "; ").alias("advice")),
         "select source_id, coalesce(nullif(array_to_string(list_filter([case when failure_count > 0 then 'fix extraction failures' end, case when unsupported_count > 0 then 'classify unsupported formats' end, case when duplicate_rate >= 0.25 then 'look into duplicates' end, case when missing_ticket_count > 0 then 'repair ticket links' end, case when missing_image_count > 0 then 'find images' end, case when missing_geo_count > 0 then 'add coordinates' end, case when ready_count = 0 and event_count > 0 then 'review blockers' end], lambda x: x is not null)[1:3], '; '), ''), 'keep monitoring') as advice from {m}", m=METRICS, src=SRC, ev=EV)
register("f08_grades", lambda v: scores.trust(sources(v), _AS_OF()).groupBy("trust_grade").agg(F.count(F.lit(1)).alias("n")),
         f"select case when t >= 90 then 'excellent' when t >= 75 then 'good' when t >= 60 then 'fair' when t >= 40 then 'poor' else 'blocked' end as trust_grade, count(*) as n from (select source_id, round_even(greatest(0.0, least(100.0, {_LOSS} - case when last_success_at is null then 8.0 else 0.0 end + case when last_success_at >= {AS_OF} - interval 45 days then 3.0 else 0.0 end)), 1)::double as t from (select *, greatest(event_count, 1)::double as e from {{m}})) group by 1", m=METRICS, src=SRC, ev=EV)
_CRAWLED = "select source_id, count(*) as n, count_if(status = 'success')::bigint as ok, count_if(status = 'failed')::bigint as bad, count_if(status = 'unsupported')::bigint as uns, max_by(status, crawl_id) as latest, max_by(candidates, crawl_id) as last_n, avg(candidates) as mean_n from {v_crawl} group by 1"
register("i16_source_health", lambda v: v("v_crawl").groupBy("source_id").agg(F.count_if(F.col("status") == "success").alias("ok_count"), F.count_if(F.col("status") == "failed").alias("failed_count"), F.max_by("status", "crawl_id").alias("latest"), F.max_by("candidates", "crawl_id").alias("last_events"), F.avg("candidates").alias("average_events")).select("*", F.when(F.col("source_id") % 11 == 0, "paused").otherwise("active").alias("status"), (F.col("source_id") % 7 > 0).alias("has_profile"), F.lit(0).alias("unsupported_count"), (F.col("latest") == "failed").alias("last_failed"), (F.col("ok_count") > 0).alias("last_ok"), F.lit(0.0).alias("duplicate_rate"), F.lit(0.0).alias("missing_ticket_rate"), F.lit(0.0).alias("missing_image_rate")).select("source_id", scores.health().alias("health")),
         "select source_id, case when source_id % 11 = 0 then 'paused' when source_id % 7 = 0 then 'watch' when bad >= 3 and (ok = 0 or latest = 'failed') then 'failing' when latest = 'failed' and ok = 0 then 'watch' when latest = 'failed' then 'needs_review' when last_n = 0 and mean_n > 0 then 'watch' else 'healthy' end as health from {crawled}", crawled=_CRAWLED)
# site names and what each adds to a page's URL or body
SITES = (("", ""), ("/feed.ics", ""), ("", "<rss version=2>"), ("/eventbrite.com/e", ""), ("", "<i class=tribe-events>"), ("", "<link href=/wp-content/x>"), ("", "<script type=application/ld+json>"), ("/tourism", ""), ("/calendar", ""))
register("i17_platform_type", lambda v: v("pages").select("page_id", F.concat("url", F.element_at(F.array(*[F.lit(u) for u, _ in SITES]), (F.col("page_id") % len(SITES) + 1).cast("int"))).alias("url"), F.concat("html", F.element_at(F.array(*[F.lit(h) for _, h in SITES]), (F.col("page_id") % len(SITES) + 1).cast("int"))).alias("html")).select("page_id", scores.platform_type("url", F.lit("text/html"), "html", F.col("page_id") % 31 == 0).alias("platform")),
         f"""select page_id, case when page_id % 31 = 0 then 'unsupported' when regexp_matches(u, '\\.ics($|[?#])') or contains(h, 'begin:vcalendar') then 'ics' when regexp_matches(h, '<rss[ >]|<feed[ >]') then 'rss_atom' when contains(u, 'eventbrite.') then 'eventbrite_page' when contains(h, 'the-events-calendar') or contains(h, 'tribe-events') then 'the_events_calendar'
 when contains(h, 'wp-content') or contains(h, 'wp-json') then 'wordpress_events' when contains(h, 'application/ld+json') then 'json_ld' when contains(u, 'tourism') or contains(regexp_extract(u, '^[a-z]+://([^/?#]*)', 1), 'visit') then 'tourism_board_calendar' when contains(u, 'calendar') or contains(u, 'events') then 'venue_calendar' when contains(h, '<html') or contains(h, '<article') or contains(h, '<div') then 'static_html' else 'unknown' end as platform
from (select page_id, lower(url || list_extract([{", ".join(f"'{u}'" for u, _ in SITES)}], (page_id % {len(SITES)} + 1)::int)) as u, lower(html || list_extract([{", ".join(f"'{h}'" for _, h in SITES)}], (page_id % {len(SITES)} + 1)::int)) as h from {{pages}})""")
register("i18_submission_risk", lambda v: scores.risk(v("v_attempt"), {"honeypot_filled": F.col("attempt_id") % 50 == 0, "submitted_too_fast": F.col("value") < 1, "authorization_missing": F.col("was_invalid"), "social_media_profile_url": F.col("kind") == "view", "trusted_submitter_or_domain": F.col("user_id") % 10 == 0}).select("attempt_id", "risk_score", "risk_level", F.array_join("risk_flags", ",").alias("risk_flags")),
         "select attempt_id, s as risk_score, case when s >= 80 then 'blocked' when s >= 50 then 'high' when s >= 20 then 'medium' else 'low' end as risk_level, f as risk_flags from (select attempt_id, greatest(0, case when attempt_id % 50 = 0 then 85 else 0 end + case when value < 1 then 50 else 0 end + case when was_invalid then 80 else 0 end + case when kind = 'view' then 35 else 0 end - case when user_id % 10 = 0 then 20 else 0 end)::bigint as s, " + sql_flags(("attempt_id % 50 = 0", "honeypot_filled"), ("value < 1", "submitted_too_fast"), ("was_invalid", "authorization_missing"), ("kind = 'view'", "social_media_profile_url"), ("user_id % 10 = 0", "trusted_submitter_or_domain"), sort=True) + " as f from {v_attempt})")
register("f02_genre_share", lambda v: v("v_event").select(genres.genre("genre").alias("genre_name"), "relevance").groupBy("genre_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("relevance"), 3).alias("mean_relevance")), f"select {sql_genre('genre')} as genre_name, count(*) as n, round(avg(relevance), 3) as mean_relevance from {{v_event}} group by 1")
