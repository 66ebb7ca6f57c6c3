"""Queries of published records, exports and what changed between two of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, published, rollups
from ..sources import snapshots
from ..sources.shared import shared_folder
from .registry import register
from .views import AS_OF


def _event_rows(v, events):
    venue = v("v_venue").select("venue_id", F.col("name").alias("venue_name"), F.col("address").alias("venue_address"), F.col("city").alias("venue_city"), F.col("state").alias("venue_state"), F.col("zip").alias("venue_zip"), F.col("country").alias("venue_country"), F.col("lat").alias("venue_lat"), F.col("lng").alias("venue_lng"))
    return events.withColumn("normalized_genres", F.when(F.col("event_id") % 20 == 0, F.array(F.lit("Rock"), F.lit("Jazz")))).join(venue, "venue_id", "left")


_PLACED = "select e.*, w.name as venue_name, w.address as venue_address, w.city as venue_city, w.state as venue_state, w.zip as venue_zip, w.country as venue_country, w.lat as venue_lat, w.lng as venue_lng from {v_event} e left join {v_venue} w using (venue_id)"
_OPEN = "publish_status in ('approved', 'published') and duplicate_status not in ('duplicate_candidate', 'merged', 'rejected')"
_T = "coalesce(trim({0}::varchar), '')"
_NAMES = "list_filter(list_transform(regexp_split_to_array(coalesce(supporting_artists, ''), '[,;\\n]| \\+ | with '), lambda x: trim(x)), lambda x: x <> '')"


def _projected(v):
    rows = _event_rows(v, filters.event_feed(v("v_event")))
    r = rows.select("event_id", published.event_record(rows).alias("r"))
    joined = lambda c: F.array_join(c, "|")
    return r.select(
        "event_id", F.col("r.event_id").alias("app_id"), "r.category", "r.title", "r.headliner", joined("r.supporting_artists").alias("supporting"), "r.genre", F.col("r.start_datetime").alias("starts"), "r.lifecycle_status", F.to_json("r.venue", {"ignoreNullFields": "false"}).alias("venue"),
        F.col("r.image.url").alias("image"), "r.image.needs_approval", F.col("r.tickets.url").alias("ticket"), F.col("r.links.event_url").alias("link"), F.col("r.source.primary_provider").alias("provider"), joined("r.source.ingestion_providers").alias("providers"), "r.source.source_claim_count", joined("r.quality.flags").alias("flags"),
    )


register(
    "b23_event_projection",
    lambda v: _projected(v).withColumn("venue", F.regexp_replace("venue", r',"latitude".*', "}")),
    f"""select event_id, 'event-' || event_id::varchar as app_id, 'Concert' as category, trim(title) as title, {_T.format('headliner')} as headliner, array_to_string({_NAMES}, '|') as supporting, case when event_id % 20 = 0 then 'Rock' else coalesce(genre, '') end as genre,
 coalesce(strftime(start_ts, '%Y-%m-%dT%H:%M:%S+00:00'), '') as starts, event_status as lifecycle_status,
 json_object('venue_id', venue_id::varchar, 'poi_id', '', 'name', case when {_T.format('venue_name')} <> '' then trim(venue_name) else location_text end, 'address', {_T.format('venue_address')}, 'city', {_T.format('venue_city')}, 'state', {_T.format('venue_state')}, 'zip_code', {_T.format('venue_zip')}, 'country', {_T.format('venue_country')})::varchar as venue,
 coalesce(image_url, '') as image, image_status = 'selected_pending_approval' or image_clearance = 'needs_review' as needs_approval, {_T.format('tickets_link')} as ticket, source_url as link, coalesce(provider, source_type) as provider,
 case when provider is null or provider = source_type then source_type else provider || '|' || source_type end as providers, claim_count::bigint as source_claim_count, '' as flags
from {{placed}} where {_OPEN} and not regexp_matches(lower(event_status), 'cancell?ed')""",
    placed=_PLACED,
)


def _published(v, events: DataFrame, pois: DataFrame) -> DataFrame:
    """All three kinds of records from states of events and places; venues carry their upcoming events."""
    open_events, open_pois = _event_rows(v, filters.event_feed(events)), filters.poi_feed(pois)
    upcoming = rollups.upcoming(filters.event_feed(events), ["venue_id"], F.expr(AS_OF))
    venues = v("v_venue").join(upcoming, "venue_id")
    parts = [snapshots.records(open_events, "event", "event_id", published.event_record(open_events)), snapshots.records(open_pois, "poi", "poi_id", published.poi_record(open_pois)), snapshots.records(venues, "venue", "venue_id", published.venue_record(venues))]
    return reduce(DataFrame.unionByName, parts)


def _versions(v):
    """(former, current): before, some events had not come in yet, some had another title, cancelled ones were scheduled and some places were drafts or had another phone."""
    events, pois = v("v_event"), v("v_poi")
    n, p = F.col("event_id"), F.col("poi_id")
    was = events.where(n % 7 > 0).withColumns({"title": F.when(n % 5 == 0, F.concat(F.lit("Old "), "title")).otherwise(F.col("title")), "event_status": F.lit("scheduled")})
    then = pois.withColumns({"publish_status": F.when(p % 9 == 0, "draft").when(p % 9 == 1, "published").otherwise(F.col("publish_status")), "website": F.when(p % 6 == 0, "https://old.example.com/").otherwise(F.col("website"))})
    return _published(v, was, then), _published(v, events, pois)


_CHANGES = f"""with_change as (select 'event' as kind, event_id::varchar as id, case when not old then 'new' when not live then 'withdrawn' when event_id % 5 = 0 or event_status <> 'scheduled' then 'changed' else 'unchanged' end as change
 from (select *, event_id % 7 > 0 as old, not regexp_matches(lower(event_status), 'cancell?ed') as live from {{v_event}} where {_OPEN}) where old or live
union all select 'poi', poi_id::varchar, case when not old then 'new' when not live then 'withdrawn' when poi_id % 6 = 0 then 'changed' else 'unchanged' end
 from (select *, publish_status in ('approved', 'published') as live, case poi_id % 9 when 0 then false when 1 then true else publish_status in ('approved', 'published') end as old from {{v_poi}} where lower(category) <> 'concert') where old or live
union all select 'venue', venue_id::varchar, case when o.venue_id is null then 'new' when c.venue_id is null then 'withdrawn' when o.n <> c.n or o.s <> c.s then 'changed' else 'unchanged' end
 from (select venue_id, count(*) as n, min(start_ts) as s from {{v_event}} where {_OPEN} and event_id % 7 > 0 and start_ts >= {AS_OF} group by 1) o
 full join (select venue_id, count(*) as n, min(start_ts) as s from {{v_event}} where {_OPEN} and not regexp_matches(lower(event_status), 'cancell?ed') and start_ts >= {AS_OF} group by 1) c using (venue_id) where venue_id in (select venue_id from {{v_venue}}))"""
_CHANGES = _CHANGES[len("with_change as (") : -1]
register(
    "a13_feed_export",
    lambda v: (lambda a, b: snapshots.changes(a, b).select("kind", "id", "change"))(*_versions(v)),
    "select kind, id, change from {c}",
    c=_CHANGES,
)


def _exports(v):
    """Two exports of everything, one of each type between them, and one that fails; then the latest of each type with its changes against the first."""
    former, current = _versions(v)
    spark = current.sparkSession
    folder = shared_folder(spark, "exports")
    snapshots.export(former, folder, "full", "x1", "2001-01-01 00:00:00", "first")
    for i, kind in enumerate(("events", "pois", "venues")):
        snapshots.export(former, folder, kind, f"x2-{kind}", f"2001-01-01 0{i + 1}:00:00", "second")
    snapshots.export(current.drop("hash"), folder, "pois", "x3", "2001-01-02 00:00:00", "third")
    then = snapshots.snapshot(spark, folder, "full")
    for kind in ("full", "events"):
        snapshots.export(current, folder, kind, f"x4-{kind}", "2001-01-03 00:00:00", "fourth")
    diff = snapshots.changes(then, snapshots.snapshot(spark, folder, "full")).groupBy("kind").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("new", "changed", "withdrawn")])
    exports = snapshots.read_manifest(spark, folder)
    failures = exports.where("status = 'failure'").count()
    newest = snapshots.latest(exports)
    return newest.join(diff, "kind", "left").withColumn("failures", F.lit(failures).cast("long")).select("export_type", "export_id", "kind", "records", F.col("generated_at").cast("string").alias("generated_at"), *[F.when(F.col("export_type") == "full", F.col(c)).alias(c) for c in ("new", "changed", "withdrawn")], "failures")


register(
    "a17_latest_export",
    _exports,
    """select export_type, export_id, kind, case when export_id like 'x4%' then n_now else n_then end::bigint as records, made as generated_at, case when export_type = 'full' then n_new end::bigint as new, case when export_type = 'full' then n_changed end::bigint as changed, case when export_type = 'full' then n_gone end::bigint as withdrawn, 1::bigint as failures
from (values ('full', 'x4-full', 'event', '2001-01-03 00:00:00'), ('full', 'x4-full', 'poi', '2001-01-03 00:00:00'), ('full', 'x4-full', 'venue', '2001-01-03 00:00:00'), ('events', 'x4-events', 'event', '2001-01-03 00:00:00'), ('pois', 'x2-pois', 'poi', '2001-01-01 02:00:00'), ('venues', 'x2-venues', 'venue', '2001-01-01 03:00:00')) t(export_type, export_id, kind, made)
join (select kind, count_if(change <> 'withdrawn') as n_now, count_if(change <> 'new') as n_then, count_if(change = 'new') as n_new, count_if(change = 'changed') as n_changed, count_if(change = 'withdrawn') as n_gone from {c} group by 1) using (kind)""",
    c=_CHANGES,
)
