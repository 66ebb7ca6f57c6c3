"""Queries of sequences that may span tasks: look-backs and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import routes
from ..operators.filters import rate_flags
from ..operators.sweep import LookBack, look_backs
from .q_columns import sql_flags, sql_haversine
from .registry import register

HOUR, DAY = 3600, 86400
COUNTS = (
    LookBack("email_day", "email", DAY), LookBack("ip_hour", "ip_hash", HOUR), LookBack("domain_day", "domain", DAY),
    LookBack("route_hour", "kind", HOUR), LookBack("agent_hour", "agent", HOUR), LookBack("global_hour", None, HOUR),
)
UNRELATED = (LookBack("other_domains", "email", DAY, value="domain"), LookBack("invalid_hour", "ip_hash", HOUR, condition="was_invalid"))


def _attempts(v):
    return v("v_attempt").withColumn("agent", F.when(F.col("user_id") % 13 > 0, F.concat(F.lit("ua"), (F.col("user_id") % 13).cast("string"))))


_ATTEMPTS = "select *, case when user_id % 13 > 0 then 'ua' || (user_id % 13)::varchar end as agent from {v_attempt}"


def _sql_count(m: LookBack) -> str:
    by = f"partition by {m.key}" if m.key else ""
    n = f"count(*) over ({by} order by created_at range between interval {m.seconds} seconds preceding and current row) - 1"
    return (f"case when {m.key} is null then 0 else {n} end" if m.key else n) + f" as {m.name}"


register("g08_look_back_counts", lambda v: look_backs(_attempts(v), "attempt_id", "created_at", list(COUNTS)), "select attempt_id, " + ", ".join(map(_sql_count, COUNTS)) + " from {a}", a=_ATTEMPTS)
_OTHERS = "select a.attempt_id, count(distinct b.domain) as other_domains from {a} a join {a} b on b.email = a.email and b.domain <> a.domain and b.created_at <= a.created_at and b.created_at >= a.created_at - interval 1 day group by 1"
_UNRELATED = f"""select attempt_id, coalesce(other_domains, 0)::bigint as other_domains,
 ((count_if(was_invalid) over (partition by ip_hash order by created_at range between interval {HOUR} seconds preceding and current row)) - was_invalid::int)::bigint as invalid_hour from {{a}} left join {{o}} using (attempt_id)"""
register("g09_unrelated_domains", lambda v: look_backs(_attempts(v), "attempt_id", "created_at", list(UNRELATED)), _UNRELATED, a=_ATTEMPTS, o=_OTHERS)
# limits low enough that every flag occurs in the given attempts
LIMITS = {"email_day": 1, "ip_hour": 2, "domain_day": 12, "route_hour": 4, "agent_hour": 4, "global_hour": 8}
register(
    "g08_rate_flags",
    lambda v: look_backs(_attempts(v), "attempt_id", "created_at", [*COUNTS, *UNRELATED]).select("attempt_id", F.array_join(rate_flags(LIMITS), ",").alias("flags")),
    "select attempt_id, " + sql_flags(
        ("email_day >= 1", "rate_limit_email_day_exceeded"), ("ip_hour >= 2", "rate_limit_ip_hour_exceeded"), ("domain_day >= 12", "rate_limit_domain_day_exceeded"), ("route_hour >= 4", "rate_limit_route_hour_exceeded"), ("agent_hour >= 4", "rate_limit_user_agent_hour_exceeded"),
        ("global_hour >= 8", "rate_limit_global_hour_exceeded"), ("email_day >= 5 or ip_hour >= 8 or domain_day >= 10", "too_many_recent_submissions"), ("other_domains >= 3", "same_email_many_unrelated_domains"), ("invalid_hour >= 3", "repeated_failed_or_invalid_submissions"),
    ) + " as flags from (select attempt_id, " + ", ".join(map(_sql_count, COUNTS)) + " from {a}) join {u} using (attempt_id)",
    a=_ATTEMPTS, o=_OTHERS, u=_UNRELATED,
)


def _stops(v):
    """Every claim is a stop at its source's place; one route has half of all stops."""
    route = F.when(F.col("claim_id") % 2 == 0, 0).otherwise(F.col("source_id"))
    place = v("v_venue").select(F.col("venue_id").alias("source_id"), "lat", "lng", F.col("name").alias("title"))
    claims = v("v_claim").groupBy("claim_id").agg(*[F.min(c).alias(c) for c in ("seen_at", "source_id", "artist_id")])  # ids of stops are unique
    return claims.join(place, "source_id", "left").select(
        route.alias("route_id"), "seen_at", "claim_id", (F.col("artist_id") % 50).alias("poi_id"), "lat", "lng", "title", F.col("lat").isNotNull().alias("located"),
        F.when(F.col("claim_id") % 40 == 2, "https://x.example.com/LOGO.png").when(F.col("claim_id") % 5 > 0, "https://x.example.com/s.jpg").alias("image_url"), (F.col("claim_id") % 111 == 1).alias("event_excluded"),
    )


_STOPS = "select case when claim_id % 2 = 0 then 0 else source_id end as route_id, seen_at, claim_id, artist_id % 50 as poi_id, lat, lng, w.name as title, case when claim_id % 40 = 2 then 'https://x.example.com/LOGO.png' when claim_id % 5 > 0 then 'https://x.example.com/s.jpg' end as image_url, claim_id % 111 = 1 as event_excluded from (select claim_id, min(seen_at) as seen_at, min(source_id) as source_id, min(artist_id) as artist_id from {v_claim} group by 1) c left join {v_venue} w on w.venue_id = c.source_id"
_PLACED = f"""select *, round({sql_haversine('lat', 'lng', 'b', 'd', geo.MILES)}, 1) as miles
from (select *, row_number() over w as ordinal, lead(claim_id) over w as to_stop, lead(lat) over w as b, lead(lng) over w as d from {{s}} window w as (partition by route_id order by seen_at, claim_id, poi_id))"""
register(
    "g05_route_segments",
    lambda v: routes.segments(_stops(v), "route_id", ["seen_at", "claim_id"]).select("route_id", "segment_order", F.col("claim_id").alias("from_stop"), "to_stop", F.round("miles", 0).alias("miles"), (F.col("walk_minutes").isNotNull()).alias("walkable")),
    "select route_id, ordinal as segment_order, claim_id as from_stop, to_stop, round(miles, 0) as miles, coalesce(miles <= 3, false) as walkable from {p} where to_stop is not null",
    s=_STOPS, p=_PLACED,
)


def _routes(v):
    n = F.col("route_id")
    known = v("v_venue").select(F.col("venue_id").alias("route_id")).unionByName(v("v_region").where("region_id = 0").select(F.lit(0).cast("long").alias("route_id"))).distinct()
    return known.select("route_id", F.when(n % 9 > 0, "Tour").alias("title"), F.when(n % 4 == 3, "draft").otherwise("published").alias("status"), F.lit("https://x.example.com/h.jpg").alias("hero_image_url"), F.lit("regional").alias("route_type"), n.alias("region_id"), F.lit(None).cast("long").alias("artist_id"))


# a gate that a part of the routes passes: their stops cost nothing here
def _clean_stops(v):
    return _stops(v).withColumns({"located": F.lit(True), "image_url": F.when(F.col("claim_id") % 40 == 2, F.lit("https://x.example.com/s.jpg")).otherwise(F.coalesce("image_url", F.lit("https://x.example.com/t.jpg"))), "event_excluded": (F.col("route_id") % 5 == 2) & (F.col("claim_id") % 3 == 0), "poi_id": F.col("claim_id")})


_GATE = """select r.route_id from (select distinct venue_id as route_id from {v_venue} union select 0) r join (select route_id, count(*) as n, count_if(route_id % 5 = 2 and claim_id % 3 = 0) as bad from {s} group by 1) c using (route_id)
where r.route_id % 4 <> 3 and 100 - case when r.route_id % 9 = 0 then 25 else 0 end - case when n < 2 then 25 else 0 end - 20 * bad >= 70"""
register(
    "f29_route_feed",
    lambda v: routes.route_feed(_routes(v), _clean_stops(v), ["seen_at", "claim_id"]).select("route_id", "kind", "ordinal", "stop_id", "to_stop", "title", "image_url", F.round("miles", 0).alias("miles")),
    """select route_id, 'stop' as kind, ordinal, claim_id as stop_id, null::bigint as to_stop, title, case when claim_id % 5 > 0 or claim_id % 40 = 2 then 'https://x.example.com/s.jpg' else 'https://x.example.com/t.jpg' end as image_url, null::double as miles from {p} where route_id in (select route_id from {gate})
union all select route_id, 'segment', ordinal, claim_id, to_stop, null, null, round(miles, 0) from {p} where to_stop is not null and route_id in (select route_id from {gate})""",
    s=_STOPS, p=_PLACED, gate=_GATE,
)
