"""Queries of vendor records, review tabs and region snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import filters, rollups, scores, tickets
from .q_scores import BLANK, LINKS, _LINK_ROWS, _links, with_venue
from .registry import register
from .views import AS_OF

_NOW = lambda: F.expr(AS_OF)


def records(v):
    """Claims as vendor records, with states and flags that follow from their own columns."""
    # a row each: filters on the class do not compute it again
    c = _links(v).select("*", F.explode_outer(F.array(tickets.link_class(F.col("link")))).alias("a"))
    m = F.col("match_confidence")
    review = F.when(m < 0.02, "pending_review").when(m < 0.04, "held").when(m < 0.06, "needs_enrichment").when(m < 0.08, "approved").otherwise("rejected")
    return c.select(
        "claim_id", F.col("provider").alias("provider_key"), review.alias("review_status"), F.when(F.col("provider_event_id").isNull(), "new").otherwise("possible").alias("duplicate_status"),
        F.when(F.col("record_id").isNotNull(), F.col("source_type")).alias("upstream_event_source"), (F.col("seen_at") + F.expr("interval 1000 days")).alias("compliance_expires_at"),
        F.col("a.category").alias("ticket_link_classification"), F.col("a.repair").alias("ticket_link_repair_strategy"), F.col("quantity").cast("double").alias("event_relevance_score"), F.when(F.col("tax") > 0.01, F.col("tax") * 1000).cast("double").alias("photo_quality_score"),
        text.flags((F.col("a.category") == "blank", "missing ticket link"), (F.col("quantity") > 40, "missing venue city"), (F.col("tax") < 0.02, "missing image")).alias("quality_flags"),
        text.flags((F.col("a.repair").startswith("reject"), "ticket repair: reject"), (F.col("record_id").isNull(), "unknown upstream source"), (F.col("quantity") < 2, "api backfill required")).alias("provenance_flags"),
    )


RECORDS = f"""select claim_id, provider as provider_key, case when match_confidence < 0.02 then 'pending_review' when match_confidence < 0.04 then 'held' when match_confidence < 0.06 then 'needs_enrichment' when match_confidence < 0.08 then 'approved' else 'rejected' end as review_status,
 case when provider_event_id is null then 'new' else 'possible' end as duplicate_status, record_id is null as no_upstream, seen_at + interval 1000 days as expires, category, repair, quantity, tax from {{v_claim}} join (values {_LINK_ROWS}) l(i, category, usable, score, flags, repair) on claim_id % {len(LINKS)} = i"""
register("f03_api_quality_counts", lambda v: rollups.metric_rows(rollups.api_quality_counts(records(v), _NOW()), []),
         f"""select * from (unpivot (select count_if(review_status = 'pending_review')::double as pending, count_if(review_status = 'held')::double as held, count_if(review_status = 'needs_enrichment')::double as needs_enrichment, count_if(expires <= {AS_OF} + interval 24 hours)::double as expiring_soon, count_if(review_status = 'rejected')::double as rejected,
 count_if(no_upstream)::double as unknown_upstream_source, count_if(quantity < 2 or repair = 'api_backfill_required')::double as api_backfill_required, count_if(repair like 'reject%')::double as suspicious_provenance, {", ".join(f"count_if(category = '{c}')::double as ticket_{c}" for c in tickets.CATEGORIES)} from {{r}}) on columns(*) into name metric value value)""", r=RECORDS)
register("f04_feed_run_counters", lambda v: rollups.run_counts(records(v), "provider_key"),
         "select provider_key, count_if(review_status = 'approved')::bigint as approved_count, count_if(review_status = 'held')::bigint as held_count, count_if(review_status = 'rejected')::bigint as rejected_count, count_if(duplicate_status <> 'new')::bigint as duplicate_candidate_count from {r} group by 1", r=RECORDS)
register("c07_record_filter", lambda v: filters.api_records(records(v), _NOW(), provider_key="feed_a", review_status="held", duplicate_status="possible", ticket_link_repair_strategy="api_backfill_required", missing_ticket_link=True, missing_image=True, unknown_upstream_source=True, api_backfill_required=True, expiring_soon=True, least_relevance=5.0, least_photo_quality=0.0).select("claim_id").unionByName(filters.api_records(records(v), _NOW(), missing_venue=True, provenance_flag="ticket repair: reject", quality_issue="missing image", ticket_link_classification="non_ticket").select("claim_id")),
         f"select claim_id from {{r}} where provider_key = 'feed_a' and review_status = 'held' and duplicate_status = 'possible' and repair = 'api_backfill_required' and category = 'blank' and tax < 0.02 and no_upstream and expires <= {AS_OF} + interval 24 hours and quantity >= 5 union all select claim_id from {{r}} where quantity > 40 and repair like 'reject%' and tax < 0.02 and category = 'non_ticket'", r=RECORDS)


_EVENT_ISSUES = ("missing_image_count", "pending_image_approval_count", "bad_ticket_count", "duplicate_event_candidate_count")


def _snapshot(v):
    """counts per region of events, places and sources; a source belongs to the region its number falls into."""
    link = tickets.assess(F.col("tickets_link")).getField("category")
    events = v("v_event").groupBy("region_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.count_if(F.col("publish_status").isin("approved", "published")).alias("app_feed_event_count"), F.count_if(text.is_blank("image_url")).alias("missing_image_count"),
        F.count_if(F.col("image_status") == "selected_pending_approval").alias("pending_image_approval_count"), F.count_if(text.is_blank("tickets_link") | (link == "unresolved")).alias("bad_ticket_count"), F.count_if(F.col("duplicate_status") == "duplicate_candidate").alias("duplicate_event_candidate_count"))
    pois = v("v_poi").join(v("v_region").select("region_id", F.col("name").alias("state")), "state").groupBy("region_id").agg(F.count(F.lit(1)).alias("poi_count"), F.count_if(F.col("publish_status").isin("approved", "published") & (F.col("category") != "Concert")).alias("app_feed_poi_count"), F.count_if(F.col("quality_control").isNotNull()).alias("poi_duplicate_candidate_count"))
    crawled = v("v_crawl").groupBy("source_id").agg(F.bool_or(F.col("status").isin("failed", "unsupported")).alias("bad"))
    of_sources = crawled.groupBy((F.col("source_id") % 25).alias("region_id")).agg(F.count(F.lit(1)).alias("source_count"), F.count_if("bad").alias("extraction_failure_count"))
    out = v("v_region").select("region_id").join(events, "region_id", "left").join(pois, "region_id", "left").join(of_sources, "region_id", "left").na.fill(0)
    issues = sum((F.col(c) for c in (*_EVENT_ISSUES, "poi_duplicate_candidate_count", "extraction_failure_count")), F.lit(0))
    return out.withColumn("quality_score", scores.count_score(issues, F.col("event_count") + F.col("poi_count") + F.col("source_count")))


register("f10_region_snapshot", _snapshot,
         f"""select *, case when event_count + poi_count + source_count = 0 then 100 else greatest(0, least(100, 100 - round_even((missing_image_count + pending_image_approval_count + bad_ticket_count + duplicate_event_candidate_count + poi_duplicate_candidate_count + extraction_failure_count) / (event_count + poi_count + source_count) * 100, 0))) end::bigint as quality_score from (
select g.region_id, coalesce(event_count, 0) as event_count, coalesce(app_feed_event_count, 0) as app_feed_event_count, coalesce(missing_image_count, 0) as missing_image_count, coalesce(pending_image_approval_count, 0) as pending_image_approval_count, coalesce(bad_ticket_count, 0) as bad_ticket_count, coalesce(duplicate_event_candidate_count, 0) as duplicate_event_candidate_count,
 coalesce(poi_count, 0) as poi_count, coalesce(app_feed_poi_count, 0) as app_feed_poi_count, coalesce(poi_duplicate_candidate_count, 0) as poi_duplicate_candidate_count, coalesce(source_count, 0) as source_count, coalesce(extraction_failure_count, 0) as extraction_failure_count
from {{v_region}} g left join (select region_id, count(*) as event_count, count_if(publish_status in ('approved', 'published'))::bigint as app_feed_event_count, count_if({BLANK.format('image_url')})::bigint as missing_image_count, count_if(image_status = 'selected_pending_approval')::bigint as pending_image_approval_count, count_if({BLANK.format('tickets_link')} or tickets_link like '%facebook%')::bigint as bad_ticket_count, count_if(duplicate_status = 'duplicate_candidate')::bigint as duplicate_event_candidate_count from {{v_event}} group by 1) e on e.region_id = g.region_id
left join (select r.region_id, count(*) as poi_count, count_if(publish_status in ('approved', 'published') and category <> 'Concert')::bigint as app_feed_poi_count, count_if(quality_control is not null)::bigint as poi_duplicate_candidate_count from {{v_poi}} p join {{v_region}} r on r.name = p.state group by 1) p on p.region_id = g.region_id
left join (select source_id % 25 as region_id, count(*) as source_count, count_if(bad)::bigint as extraction_failure_count from (select source_id, bool_or(status in ('failed', 'unsupported')) as bad from {{v_crawl}} group by 1) group by 1) s on s.region_id = g.region_id)""")
register("f21_feed_summary", lambda v: rollups.metric_rows(rollups.beside(filters.event_feed(v("v_event")).agg(F.count(F.lit(1)).alias("event_feed_record_count"), F.count_if(text.is_blank("image_url")).alias("events_needing_images"), F.count_if(F.col("image_status") == "selected_pending_approval").alias("events_pending_image_approval"), F.countDistinct(F.when(F.col("start_ts") >= _NOW(), F.col("venue_id"))).alias("venues_with_upcoming_events")), filters.poi_feed(v("v_poi")).agg(F.count(F.lit(1)).alias("publishable_pois")), v("v_event").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("duplicate_status").isin(*filters.DUPLICATE_EXCLUDED)).alias("duplicate_candidates_excluded"), F.count_if(F.lower("event_status").rlike("cancell?ed")).alias("cancelled_events_excluded")), v("v_poi").agg(F.count(F.lit(1)).alias("pois"))).select("event_feed_record_count", "events_needing_images", "events_pending_image_approval", "venues_with_upcoming_events", "publishable_pois", "duplicate_candidates_excluded", "cancelled_events_excluded", (F.col("events") + F.col("pois") - F.col("event_feed_record_count") - F.col("publishable_pois")).alias("records_blocked_from_publishing"), (F.col("pois") - F.col("publishable_pois")).alias("pois_blocked_from_app_feed")), []),
         f"""select * from (unpivot (select n::double as event_feed_record_count, i::double as events_needing_images, a::double as events_pending_image_approval, w::double as venues_with_upcoming_events, p::double as publishable_pois, d::double as duplicate_candidates_excluded, c::double as cancelled_events_excluded, (en + pn - n - p)::double as records_blocked_from_publishing, (pn - p)::double as pois_blocked_from_app_feed
from (select count(*) as n, count_if({BLANK.format('image_url')}) as i, count_if(image_status = 'selected_pending_approval') as a, count(distinct case when start_ts >= {AS_OF} then venue_id end) as w from {{v_event}} where publish_status in ('approved', 'published') and not regexp_matches(lower(event_status), 'cancell?ed') and duplicate_status not in ('duplicate_candidate', 'merged', 'rejected')),
 (select count_if(publish_status in ('approved', 'published') and lower(category) <> 'concert') as p, count(*) as pn from {{v_poi}}), (select count(*) as en, count_if(duplicate_status in ('duplicate_candidate', 'merged', 'rejected')) as d, count_if(regexp_matches(lower(event_status), 'cancell?ed')) as c from {{v_event}})) on columns(*) into name metric value value)""")
