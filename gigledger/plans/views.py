"""Domain views over the given tables, in SQL that Spark and DuckDB both read.

Braces name tables or other views. Spark gets DataFrames for them, DuckDB gets common table
expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The clock of every query.
AS_OF = "timestamp '2001-01-01 00:00:00'"

VIEWS = {
    "v_region": """
select cast(n_nationkey as bigint) as region_id, lower(n_name) as region_key, n_name as name, r_name as country,
       case n_nationkey % 4 when 0 then 'state' when 1 then 'metro' when 2 then 'certified' else 'city' end as region_type,
       cast(n_nationkey * 1.5 as double) as lat, cast(n_nationkey * 2.0 as double) as lng,
       cast(10 + n_nationkey % 5 * 20 as double) as radius_miles, n_nationkey % 3 = 0 as certified
from {nation} join {region} on n_regionkey = r_regionkey""",
    "v_venue": """
select s_suppkey as venue_id,
       case when s_suppkey % 23 = 0 then ' ' else 'The Hall & Stage No. ' || cast(s_suppkey % 37 as varchar(9)) end as name,
       case when s_suppkey % 5 = 0 then null when s_suppkey % 5 = 1 then '' else cast(s_suppkey % 90 as varchar(9)) || ' Music Way' end as address,
       'City ' || cast(s_suppkey % 12 as varchar(9)) as city, n_name as state, r_name as country,
       case when s_suppkey % 4 = 0 then null else cast(38000 + s_suppkey % 50 as varchar(9)) end as zip,
       case when s_suppkey % 7 = 0 then null else cast(s_nationkey * 1.5 + s_suppkey % 50 * 0.0004 as double) end as lat,
       case when s_suppkey % 7 = 0 then null else cast(s_nationkey * 2.0 + s_suppkey % 30 * 0.0004 as double) end as lng,
       s_acctbal as balance
from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    "v_poi": """
select c_custkey as poi_id,
       case when c_custkey % 41 = 0 then '' else 'Café ' || c_mktsegment || ' No. ' || cast(c_custkey % 19 as varchar(9)) || case when c_custkey % 3 = 0 then ', LLC' else '' end end as name,
       case c_custkey % 6 when 0 then 'Music Site' when 1 then 'Cultural' when 2 then 'Food & Bev' when 3 then 'Lodging' when 4 then 'Concert' else 'Shopping' end as category,
       case when c_custkey % 8 = 0 then null else lower(c_mktsegment) end as subcategory,
       case when c_custkey % 9 = 0 then null else cast(c_nationkey * 1.5 + c_custkey % 4 * 0.0003 as double) end as lat,
       case when c_custkey % 9 = 0 then null else cast(c_nationkey * 2.0 + c_custkey % 3 * 0.0002 as double) end as lng,
       case when c_custkey % 10 = 0 then null else cast(c_custkey % 120 as varchar(9)) || ' Main Street' end as address,
       'City ' || cast(c_custkey % 4 as varchar(9)) as city, n_name as state, r_name as country,
       case when c_custkey % 3 = 0 then null else 'https://www.site' || cast(c_custkey % 80 as varchar(9)) || '.example.com/' end as website,
       case when c_custkey % 5 = 0 then null else '555-' || cast(1000 + c_custkey % 300 as varchar(9)) end as phone,
       case when c_custkey % 4 = 0 then 'pl-' || cast(c_custkey % 250 as varchar(9)) end as places_id,
       case when c_custkey % 7 = 0 then 'ex-' || cast(c_custkey as varchar(20)) end as export_id,
       case when c_custkey % 6 = 5 then null when c_custkey % 6 = 4 then 'https://cdn.example.com/logo.png' else 'https://cdn.example.com/p' || cast(c_custkey as varchar(20)) || '.jpg' end as image_url,
       case when c_custkey % 29 = 0 then 'Possible Duplicate' else null end as quality_control,
       c_custkey % 11 = 0 as certified, c_acctbal as rating,
       case c_custkey % 4 when 0 then 'draft' when 1 then 'published' when 2 then 'approved' else 'published' end as publish_status
from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    "v_event": """
select o_orderkey as event_id,
       case when o_orderkey % 53 = 0 then ' ' else 'The ' || substr(o_orderpriority, 3) || ' Night & Show #' || cast(o_custkey % 40 as varchar(9)) end as title,
       case when o_orderkey % 4 = 0 then null else 'Band ' || cast(o_custkey % 60 as varchar(9)) end as headliner,
       case o_orderkey % 3 when 0 then null when 1 then 'Ann, Ben; Cy + Dee' else 'Guests with Eve' end as supporting_artists,
       case o_orderkey % 7 when 0 then 'alternative rock band' when 1 then 'trap' when 2 then 'Jazz Fusion' when 3 then 'blues' when 4 then 'Deep House' when 5 then 'polka' else null end as genre,
       case when o_orderkey % 61 = 0 then null else o_orderdate end as start_ts,
       o_custkey % 100 as venue_id,
       cast(o_custkey % 25 as bigint) as region_id,
       'Hall ' || cast(o_custkey % 100 as varchar(9)) as location_text,
       case o_orderkey % 3 when 0 then 'ics' when 1 then 'api' else 'file_upload' end as source_type,
       case o_orderkey % 5 when 0 then 'feed_a' when 1 then 'feed_b' when 2 then 'ics' else null end as provider,
       case when o_orderkey % 6 = 0 then null else 'ev-' || cast(o_orderkey % 9000 as varchar(9)) end as source_event_id,
       'https://Calendar' || cast(o_custkey % 30 as varchar(9)) || '.Example.com/e/' || cast(o_orderkey % 700 as varchar(9)) || '/?utm_source=x&id=' || cast(o_orderkey % 13 as varchar(9)) as source_url,
       case o_orderkey % 8 when 0 then null when 1 then '' when 2 then 'https://www.facebook.com/events/1' when 3 then 'https://tickets.example.com/' else 'https://tickets.example.com/event/' || cast(o_orderkey as varchar(20)) || '?fbclid=1' end as tickets_link,
       case when o_orderkey % 9 = 0 then null else 'https://img.example.com/' || cast(o_custkey % 500 as varchar(9)) || '.jpg' end as image_url,
       case o_orderkey % 6 when 0 then 'missing' when 1 then 'rejected' when 2 then 'selected_pending_approval' else 'accepted' end as image_status,
       case o_orderkey % 10 when 0 then 'blocked' when 1 then 'needs_review' else 'approved' end as image_clearance,
       case o_orderstatus when 'F' then 'published' when 'O' then 'approved' else 'needs_review' end as publish_status,
       case when o_orderkey % 19 = 0 then 'duplicate_candidate' when o_orderkey % 37 = 0 then 'merged' else 'none' end as duplicate_status,
       case when o_orderkey % 31 = 0 then 'Event Canceled' when o_orderkey % 29 = 0 then 'postponed' when o_orderkey % 43 = 0 then 'was RESCHEDULED' else 'scheduled' end as event_status,
       case o_orderkey % 3 when 0 then 'strong' when 1 then 'medium' else 'weak' end as dedupe_confidence,
       cast(o_totalprice / 5000.0 as double) as relevance, o_totalprice as price, o_orderkey % 4 as claim_count
from {orders}""",
    "v_claim": """
select l_orderkey * 10 + l_linenumber as claim_id, l_orderkey as event_id, l_suppkey as source_id, l_partkey as artist_id,
       case l_returnflag when 'A' then 'api' when 'N' then 'ics' else 'file_upload' end as source_type,
       case l_linestatus when 'F' then 'feed_a' else 'feed_b' end as provider,
       case when l_linenumber % 3 = 0 then null else 'pe-' || cast(l_orderkey % 4000 as varchar(9)) end as provider_event_id,
       case when l_linenumber % 2 = 0 then 'rec-' || cast(l_partkey as varchar(20)) end as record_id,
       l_shipdate as seen_at, l_discount as match_confidence, l_quantity as quantity, l_extendedprice as amount, l_tax as tax
from {lineitem}""",
    "v_artist": """
select p_partkey as artist_id, case when p_partkey % 17 = 0 then '' else 'The ' || p_name || ' & Co' end as name,
       p_type as genre_text, p_brand as label, p_size as weight, p_retailprice as fee,
       case when p_partkey % 3 = 0 then 'sp-' || cast(p_partkey % 500 as varchar(9)) end as external_id
from {part}""",
    "v_image": """
select l_orderkey * 10 + l_linenumber as image_id, l_orderkey as event_id, l_suppkey % 100 as venue_id,
       'https://img.example.com/' || cast(l_partkey % 700 as varchar(9)) || case when l_linenumber = 7 then '-logo.png' else '.jpg' end as url,
       case l_linenumber when 1 then 'headliner' when 2 then 'event' when 3 then 'venue_live' when 4 then 'venue_exterior' when 5 then 'promo' else 'other' end as role,
       case when l_discount < 0.02 then 'accepted' when l_discount < 0.05 then 'candidate' when l_discount < 0.08 then 'needs_review' else 'rejected' end as status,
       case when l_tax < 0.02 then 'approved' when l_tax < 0.06 then 'needs_review' else 'blocked' end as clearance,
       cast(l_quantity * 40 as int) as width, cast(300 + l_linenumber * 100 as int) as height, l_suppkey % 5 * 10 as priority, l_extendedprice as amount
from {lineitem}""",
    "v_picture": """
select image_id, event_id, venue_id, url, case role when 'headliner' then 'artist_live' when 'event' then 'event_provider' when 'promo' then 'artist_press' when 'other' then 'logo' else role end as role, status,
       case clearance when 'needs_review' then 'needs_approval' when 'blocked' then 'rejected' else clearance end as clearance, case when event_id % 29 = 0 then null else width end as width, height,
       case event_id % 4 when 0 then 'api' when 1 then 'manual' when 2 then 'upload' else 'crawl' end as source_type, case event_id % 2 when 0 then 'feed_a' else 'feed_b' end as source_provider,
       case event_id % 5 when 0 then 'provider_artist_image' when 1 then 'social_graphic_reference' end as rescue_source,
       case event_id % 6 when 0 then 'photo_rescue:artist' when 1 then 'by hand' end as selected_reason,
       case event_id % 9 when 0 then 'low resolution image,generic_provider_image' when 1 then 'poster_flyer_admat' else '' end as qa_text,
       event_id % 31 > 0 as is_accessible, event_id % 37 > 0 as is_direct, event_id % 41 = 0 as is_social, event_id % 7 = 0 as evidence_only, event_id % 7 > 0 and image_id % 43 > 0 as can_be_final,
       cast(event_id % 89 as double) as generic_score, cast(event_id % 97 as double) as text_score, cast(event_id % 83 as double) as poster_score, cast(event_id % 79 as double) as admat_score,
       image_id % 13 = 0 as is_stock, image_id % 17 = 0 as has_text, image_id % 19 = 0 as has_watermark, image_id % 23 = 0 as is_poster, event_id % 59 = 0 as has_logo,
       event_id % 61 = 0 as is_food, event_id % 67 = 0 as is_unrelated_place, event_id % 3 = 0 as is_generic_crowd, event_id % 2 = 0 as shows_artist, event_id % 5 = 0 as shows_live, cast(null as boolean) as shows_venue
from {v_image}""",
    "v_picture_event": """
select e.event_id, e.tickets_link, e.publish_status, case when e.event_id % 31 = 0 then 'Cancelled' else e.event_status end as event_status, s.selected_image_id,
       case e.image_status when 'rejected' then 'venue_fallback' else e.image_status end as image_status, case e.image_clearance when 'needs_review' then 'needs_approval' else e.image_clearance end as image_clearance,
       case e.event_id % 4 when 1 then 'event_provider' when 2 then 'artist_live' else 'venue_live' end as image_role, case when s.selected_image_id is not null then e.image_url end as selected_url
from {v_event} e left join (select event_id, min(image_id) as selected_image_id from {v_image} where status <> 'rejected' group by event_id) s on s.event_id = e.event_id""",
    "v_picture_venue": """
select w.venue_id, s.selected_image_id, case w.venue_id % 3 when 0 then 'venue_fallback' when 1 then 'accepted' else 'selected_pending_approval' end as image_status,
       case w.venue_id % 4 when 0 then 'needs_approval' when 1 then 'licensed' else 'approved' end as image_clearance, case when w.venue_id % 5 > 0 then w.name end as selected_url
from {v_venue} w left join (select venue_id, max(image_id) as selected_image_id from {v_image} group by venue_id) s on s.venue_id = w.venue_id""",
    "v_attempt": """
select event_id as attempt_id, ts as created_at, user_id, 'u' || cast(user_id as varchar(9)) || '@Mail' || cast(user_id % 9 as varchar(9)) || '.example.com' as email,
       'site' || cast(event_id % 23 as varchar(9)) || '.example.com' as domain, 'ip' || cast(user_id % 40 as varchar(9)) as ip_hash,
       event_type as kind, event_type = 'error' as was_invalid, value
from {events}""",
    "v_crawl": """
select event_id as crawl_id, user_id as source_id, ts as fetched_at,
       case event_type when 'error' then 'failed' when 'view' then 'unsupported' else 'success' end as status,
       case when event_type = 'error' then 0 when value < 2 then 0 else cast(floor(value) as bigint) % 20 end as candidates,
       cast(floor(value) as bigint) % 7 as created, cast(floor(value) as bigint) % 5 as duplicates,
       case event_type when 'error' then 'HTTP 500 timeout' else null end as error
from {events}""",
}
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a domain view as a DataFrame."""
    if name in _TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    return spark.sql(sql.replace("varchar(9)", "string").replace("varchar(20)", "string"), **{n: view(spark, sf_dir, n) for n in _needs(sql)})


def duck(sql: str, **defined: str) -> str:
    """DuckDB form of a query whose braces name tables, views or the given definitions."""
    known, order = VIEWS | defined, []

    def visit(text: str) -> None:
        for n in _needs(text):
            if n in known and n not in order:
                visit(known[n])
                order.append(n)

    visit(sql)
    bare = lambda t: re.sub(r"\{(\w+)\}", r"\1", t)
    made = ",\n".join(f"{n} as ({bare(known[n])})" for n in order)
    return (f"with {made}\n" if made else "") + bare(sql)
