"""Queries of rollups, rankings and look-back windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, rollups, scores, windows
from .q_scores import EV, READY, with_venue
from .registry import register
from .views import AS_OF

_NOW = lambda: F.expr(AS_OF)
_S = "cast({0} as string)"


def _text(c: str):
    return F.col(c).cast("string").alias(c)


register("f01_upcoming_by_venue", lambda v: v("v_venue").select("venue_id", "name").join(rollups.upcoming(v("v_event"), ["venue_id"], _NOW()), "venue_id", "left").select("venue_id", "name", F.coalesce("upcoming", F.lit(0)).alias("upcoming"), _text("next_start")),
         f"select w.venue_id, any_value(w.name) as name, count(e.event_id) as upcoming, min(e.start_ts)::varchar as next_start from {{v_venue}} w left join {{v_event}} e on e.venue_id = w.venue_id and e.start_ts >= {AS_OF} group by 1")
register("f01_upcoming_by_artist", lambda v: rollups.upcoming(v("v_event").join(v("v_claim").select("event_id", "artist_id").distinct(), "event_id"), ["artist_id"], _NOW()).select("artist_id", "upcoming", _text("next_start")),
         f"select artist_id, count(*) as upcoming, min(start_ts)::varchar as next_start from {{v_event}} join (select distinct event_id, artist_id from {{v_claim}}) using (event_id) where start_ts >= {AS_OF} group by 1")
register("f02_events_by_provider", lambda v: v("v_event").where("publish_status = 'approved'").groupingSets([[F.col("provider")], [F.col("source_type")]], "provider", "source_type").agg(F.grouping_id().cast("long").alias("g"), F.count(F.lit(1)).alias("n")),
         "select provider, source_type, grouping(provider, source_type)::bigint as g, count(*) as n from {v_event} where publish_status = 'approved' group by grouping sets ((provider), (source_type))")
register("f07_region_rollup", lambda v: v("v_event").groupBy("region_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("publish_status") == "published").alias("published"), F.max("start_ts").cast("string").alias("last_start"), F.max_by("event_id", F.struct("start_ts", "event_id")).alias("latest_event")),
         "select region_id, count(*) as events, count_if(publish_status = 'published')::bigint as published, max(start_ts)::varchar as last_start, max_by(event_id, (coalesce(start_ts, timestamp '1000-01-01'), event_id)) as latest_event from {v_event} group by 1")
register("f12_crawl_performance", lambda v: v("v_crawl").groupBy("source_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "success").alias("ok"), F.sum("candidates").alias("c"), F.sum("created").alias("k"), F.sum("duplicates").alias("d")).select("source_id", "runs", "ok", F.round(F.col("c") / F.col("runs"), 4).alias("average_yield"), F.round(F.col("d") / F.greatest("c", F.lit(1)), 4).alias("duplicate_rate"), F.round(F.col("k") / F.greatest("c", F.lit(1)), 4).alias("created_rate")),
         "select source_id, runs, ok, round(c / runs, 4) as average_yield, round(d / greatest(c, 1), 4) as duplicate_rate, round(k / greatest(c, 1), 4) as created_rate from (select source_id, count(*) as runs, count_if(status = 'success')::bigint as ok, sum(candidates)::bigint as c, sum(created)::bigint as k, sum(duplicates)::bigint as d from {v_crawl} group by 1)")
register("f13_facets", lambda v: v("v_poi").rollup("category", "subcategory").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.count_if("certified").alias("certified")),
         "select category, subcategory, grouping(category, subcategory)::bigint as level, count(*) as n, count_if(certified)::bigint as certified from {v_poi} group by rollup(category, subcategory)")
register("f13_date_ranges", lambda v: rollups.metric_rows(rollups.conditional_counts(v("v_event"), [], {f"next_{d}": (F.col("start_ts") >= _NOW()) & (F.col("start_ts") < _NOW() + F.expr(f"interval {d} days")) for d in (7, 30, 90)}), []),
         "".join(("" if d == 7 else " union all ") + f"select 'next_{d}' as metric, count_if(start_ts >= {AS_OF} and start_ts < {AS_OF} + interval {d} days)::double as value from {{v_event}}" for d in (7, 30, 90)))
register("f22_top_and_weak_sources", lambda v: (lambda t: windows.top(t.select(F.lit("top").alias("kind"), "*"), ["kind"], [F.col("n").desc(), F.col("source_id")], 5).unionByName(windows.top(t.select(F.lit("weak").alias("kind"), "*"), ["kind"], [F.col("n"), F.col("source_id")], 5)))(v("v_claim").groupBy("source_id").agg(F.countDistinct("event_id").alias("n"))),
         "with t as (select source_id, count(distinct event_id) as n from c group by 1) select * from (select 'top' as kind, source_id, n, row_number() over (order by n desc, source_id)::int as rank from t) where rank <= 5 union all select * from (select 'weak' as kind, source_id, n, row_number() over (order by n, source_id)::int as rank from t) where rank <= 5".replace("with t as (select source_id, count(distinct event_id) as n from c group by 1) ", "").replace(" t)", " {t})"),
         t="select source_id, count(distinct event_id) as n from {v_claim} group by 1")
register("f24_status_counts", lambda v: rollups.zero_filled(v("v_crawl").groupBy("status").agg(F.count(F.lit(1)).alias("n")), ["queued", "failed", "success", "unsupported"], "status", "n"),
         "select s as status, count(c.crawl_id) as n from (values ('queued'), ('failed'), ('success'), ('unsupported')) l(s) left join {v_crawl} c on c.status = s group by 1")
register("f26_batch_risk", lambda v: v("v_attempt").groupBy((F.col("attempt_id") / 100).cast("long").alias("batch")).agg(F.sum(F.when(F.col("value") > 50, 10).otherwise(1)).alias("s"), F.avg(F.col("was_invalid").cast("int")).alias("bad")).select("batch", (F.col("s") + F.when(F.col("bad") >= 0.2, 35).otherwise(0)).alias("score"), F.round("bad", 4).alias("invalid_share")),
         "select attempt_id // 100 as batch, (sum(case when value > 50 then 10 else 1 end) + case when avg(was_invalid::int) >= 0.2 then 35 else 0 end)::bigint as score, round(avg(was_invalid::int), 4) as invalid_share from {v_attempt} group by 1")
register("f28_venue_feed", lambda v: windows.renumber(filters.event_feed(v("v_event")).where("start_ts is not null"), ["venue_id"], [F.col("start_ts"), F.col("event_id")], "position").select("venue_id", "position", "event_id"),
         "select venue_id, row_number() over (partition by venue_id order by start_ts, event_id) as position, event_id from {v_event} where publish_status in ('approved', 'published') and not regexp_matches(lower(event_status), 'cancell?ed') and duplicate_status not in ('duplicate_candidate', 'merged', 'rejected') and start_ts is not null")

register("g01_latest_crawl", lambda v: windows.latest(v("v_crawl"), ["source_id"], [F.col("fetched_at").desc(), F.col("crawl_id").desc()]).select("source_id", "crawl_id", "status"),
         "select source_id, crawl_id, status from (select *, row_number() over (partition by source_id order by fetched_at desc, crawl_id desc) as n from {v_crawl}) where n = 1")
register("g04_top_places_per_region", lambda v: windows.top(v("v_poi"), ["state"], [F.col("rating").desc(), F.col("poi_id")], 4).select("state", "rank", "poi_id"), "select state, rank, poi_id from (select state, poi_id, row_number() over (partition by state order by rating desc, poi_id)::int as rank from {v_poi}) where rank <= 4")
register("g06_renumber", lambda v: windows.renumber(v("v_claim"), ["event_id"], [F.col("seen_at"), F.col("claim_id")], "position").select("event_id", "claim_id", "position"), "select event_id, claim_id, row_number() over (partition by event_id order by seen_at, claim_id) as position from {v_claim}")
register("g07_first_seen", lambda v: windows.renumber(v("v_claim").where("provider_event_id is not null"), ["provider", "provider_event_id"], [F.col("claim_id")], "n").select("claim_id", F.when(F.col("n") == 1, "new").otherwise("duplicate_within_run").alias("status")),
         "select claim_id, case when row_number() over (partition by provider, provider_event_id order by claim_id) = 1 then 'new' else 'duplicate_within_run' end as status from {v_claim} where provider_event_id is not null")
register("g13_yield_drops", lambda v: windows.yield_drops(v("v_crawl"), "source_id", "crawl_id", "candidates").select("source_id", "crawl_id", F.round("prior_average", 6).alias("prior_average")),
         "select source_id, crawl_id, round(p, 6) as prior_average from (select *, avg(candidates) over (partition by source_id order by crawl_id rows between unbounded preceding and 1 preceding) as p from {v_crawl}) where candidates = 0 and p > 0")
register("g14_next_due", lambda v: windows.latest(v("v_claim"), ["source_id"], [F.col("seen_at").desc(), F.col("claim_id")]).select("source_id", windows.next_due(F.col("seen_at"), F.when(F.col("source_id") % 4 == 0, "manual").when(F.col("source_id") % 4 == 1, "daily").otherwise("monthly"), _NOW()).cast("string").alias("due")),
         "select source_id, (case source_id % 4 when 0 then null when 1 then max(seen_at) + interval 1 day else max(seen_at) + interval 30 days end)::varchar as due from {v_claim} group by 1")
