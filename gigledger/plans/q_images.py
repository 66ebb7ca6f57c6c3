"""Queries of image candidates: their scores, their reuse and where they come from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import images
from .q_columns import sql_flags
from .registry import register

_ROLE = "case role " + " ".join(f"when '{n}' then {p}" for n, p in images.ROLE_POINTS) + f" else {images.OTHER_ROLE} end"
_SOURCE = "case source_type " + " ".join(f"when '{n}' then {p}" for n, p in images.PROVENANCE) + f" else {images.OTHER_SOURCE} end"
_LOW = "(width < 720 or least(width, height) < 400)"
_TECHNICAL = f"""greatest(0, 100 - case when not is_direct then 40 else 0 end - case when is_social then 45 else 0 end - case when not is_accessible then 55 else 0 end
 - case when width is null then 12 when {_LOW} then 35 when width < 1200 then 10 else 0 end - case when width / height >= 2.2 or width / height < 0.85 then 8 else 0 end)"""
_SUBJECT = "greatest(0, least(100, 40 + case when shows_live then 30 else 0 end + case when shows_artist then 26 else 0 end - case when is_food then 24 else 0 end - case when is_unrelated_place then 36 else 0 end - case when is_generic_crowd then 22 else 0 end))"
_PROVENANCE = f"case when clearance = 'rejected' then 0 else least(100, {_SOURCE} + case when clearance = 'approved' then 8 else 0 end) end"
_APPROVAL = "case when status = 'rejected' or clearance = 'rejected' then 0 when status = 'accepted' then 96 when clearance = 'approved' then 86 when clearance = 'needs_approval' then 74 else 50 end"
_LESS = "case when has_text then 14 else 0 end + case when has_watermark then 22 else 0 end + case when is_poster then 45 else 0 end + case when is_stock then 50 else 0 end + case when generic_score >= 70 then 45 else 0 end + case when not can_be_final then 55 else 0 end"
_FLAGS = sql_flags(
    ("not is_direct", "not direct image asset"), ("is_social", "social media image URL"), ("not is_accessible", "broken or inaccessible image"), ("width is null", "missing dimensions"), (_LOW, "low resolution image"), (f"not {_LOW} and width < 1200", "below preferred 1200px width"),
    ("width / height < 0.85", "portrait image"), ("width / height >= 2.2", "panoramic image"), ("is_food", "food or drink image"), ("is_unrelated_place", "unrelated place image"), ("is_generic_crowd", "generic crowd image"), ("has_text", "text-heavy image candidate"), ("has_watermark", "watermark suspected"),
    ("is_poster", "poster/flyer detected"), ("is_stock", "stock_placeholder_candidate"), ("generic_score >= 70", "generic_provider_image"), ("not can_be_final", "not_final_image_eligible"), ("clearance = 'needs_approval'", "needs image approval"), sort=True,
)
register(
    "i08_image_scores",
    lambda v: images.candidate_scores(v("v_picture")).select("image_id", *[F.col(f"{c}_score").cast("long").alias(f"{c}_score") for c in ("role", "technical", "subject", "provenance", "approval")], "image_score", F.array_join("score_flags", ",").alias("flags")),
    f"""select image_id, r::bigint as role_score, t::bigint as technical_score, s::bigint as subject_score, p::bigint as provenance_score, a::bigint as approval_score, flags,
 round(case when clearance = 'rejected' then 0.0 else greatest(0.0, least(100.0, r::double * 0.28::double + t::double * 0.24::double + s::double * 0.2::double + p::double * 0.16::double + a::double * 0.12::double - less::double)) end, 2)::double as image_score
from (select image_id, clearance, {_ROLE} as r, {_TECHNICAL} as t, {_SUBJECT} as s, {_PROVENANCE} as p, {_APPROVAL} as a, {_LESS} as less, {_FLAGS} as flags from {{v_picture}})""",
)

# pictures of a venue's roles that one venue alone shows, and others
_USES = "select image_id, event_id, case when image_id % 4 = 0 then null else venue_id end as venue_id, case when image_id % 5 = 0 then 'venue_live' else role end as role, case when image_id % 5 = 0 then 'https://V.example.com/' || venue_id::varchar || '.jpg' when image_id % 3 = 0 then url || '?w=' || image_id::varchar else 'https://own.example.com/' || image_id::varchar || '#x' end as url from {v_image}"
_SHOWN = "select u.*, lower(trim(regexp_replace(u.url, '[?#].*$', ''))) as picture, e.venue_id as event_venue, lower(trim(coalesce(nullif(e.headliner, ''), e.title))) as who from {u} u left join (select *, case when event_id % 5 = 0 then null else venue_id end as vid from {v_event}) e on e.event_id = u.event_id"


def _uses(v):
    n = F.col("image_id")
    of_venue = F.concat(F.lit("https://V.example.com/"), F.col("venue_id").cast("string"), F.lit(".jpg"))
    url = F.when(n % 5 == 0, of_venue).when(n % 3 == 0, F.concat("url", F.lit("?w="), n.cast("string"))).otherwise(F.concat(F.lit("https://own.example.com/"), n.cast("string"), F.lit("#x")))
    return v("v_image").select("image_id", "event_id", F.when(n % 4 > 0, F.col("venue_id")).alias("venue_id"), F.when(n % 5 == 0, "venue_live").otherwise(F.col("role")).alias("role"), url.alias("url"))


register(
    "i09_image_reuse",
    lambda v: images.reuse_reasons(_uses(v), v("v_event")).where("size(reasons) > 0").select("image_id", "reused_events", F.array_join("reasons", ",").alias("reasons")),
    """select image_id, reused_events, reasons from (select image_id, reused_events, case when role in ('venue_live', 'venue_exterior') and coalesce(n_venues, 0) = 1 then '' else concat_ws(',', case when n_who > 1 then 'reused across different headliners' end, case when reused_events >= 3 then 'reused across three or more events' end) end as reasons
from {s} s join (select picture, count(distinct event_id) as reused_events, count(distinct who) as n_who from {s} group by 1) c using (picture) left join (select picture, count(distinct v) as n_venues from (select picture, unnest([venue_id, event_venue]) as v from {s}) where v is not null group by 1) w using (picture)) where reasons <> ''""",
    u=_USES, s=_SHOWN,
)


def _parts(v):
    none = lambda kind: F.lit(None).cast(kind)
    event = F.concat(F.lit("event:"), F.col("event_id").cast("string"))
    return [
        v("v_event").select(event.alias("owner"), F.col("image_url").alias("url"), F.lit("Event").alias("role"), F.lit("provider").alias("source_type"), F.lit("candidate").alias("status"), F.col("image_clearance").alias("clearance"), none("int").alias("width"), none("int").alias("height"), F.lit(50).alias("priority")),
        v("v_image").select(event.alias("owner"), F.concat("url", F.lit("?v=1")).alias("url"), "role", F.lit("ticket_page").alias("source_type"), "status", "clearance", "width", "height", (F.col("priority") + 30).cast("int").alias("priority")),
        v("v_poi").select(F.concat(F.lit("poi:"), F.col("poi_id").cast("string")).alias("owner"), F.col("image_url").alias("url"), F.lit("exterior").alias("role"), F.lit("venue").alias("source_type"), none("string").alias("status"), F.lit("unknown").alias("clearance"), none("int").alias("width"), none("int").alias("height"), F.lit(180).alias("priority")),
    ]


_GATHERED = """select 'event:' || event_id::varchar as owner, image_url as url, 'event_provider' as role, 'provider' as source_type, 'candidate' as status, image_clearance as clearance, null::int as width, null::int as height, 50 as priority from {v_event}
union all select 'event:' || event_id::varchar, url || '?v=1', case role when 'headliner' then 'artist_live' when 'event' then 'event_provider' when 'promo' then 'artist_press' when 'other' then 'unknown' else role end, 'ticket_page', status, clearance, width, height, (priority + 30)::int from {v_image}
union all select 'poi:' || poi_id::varchar, image_url, 'venue_exterior', 'venue', null, 'unknown', null, null, 180 from {v_poi}"""
_BEST = """select * from (select *, lower(trim(regexp_replace(url, '[?#].*$', ''))) as picture, count(*) over w as n, row_number() over (w order by priority, source_type, url, role, status nulls first, clearance nulls first, width nulls first, height nulls first) as k from {g} where coalesce(trim(url), '') <> '' window w as (partition by owner, lower(trim(regexp_replace(url, '[?#].*$', ''))))) where k = 1"""
register(
    "e23_image_candidates",
    lambda v: images.gathered_candidates(_parts(v)),
    f"""select owner, picture, url, role, source_type, priority, n, round(case when clearance = 'rejected' then 0.0 else greatest(0.0, least(100.0, r::double * 0.28::double + t::double * 0.24::double + 40.0::double * 0.2::double + p::double * 0.16::double + a::double * 0.12::double + case when priority <= 40 then 6 when priority >= 160 then -18 else 0 end)) end, 2)::double as image_score
from (select *, {_ROLE} as r, greatest(0, 100 - case when width is null then 12 when {_LOW} then 35 when width < 1200 then 10 else 0 end - case when width / height >= 2.2 or width / height < 0.85 then 8 else 0 end) as t, {_PROVENANCE} as p,
 case when coalesce(status, '') = 'rejected' or clearance = 'rejected' then 0 when coalesce(status, '') = 'accepted' then 96 when clearance = 'approved' then 86 when clearance in ('needs_approval', 'unknown') then 74 else 50 end as a from {{best}})""",
    g=_GATHERED, best=_BEST,
)
