"""Queries of registries and profiles: search seeds, venues by key, and what an export holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import rollups, search, upsert
from .q_columns import sql_place
from .registry import register


def _seeds(v):
    """Seeds of places and regions into a table that knows a part of them, some shown in the app, and one that nothing comes for."""
    n = F.col("poi_id")
    pois = v("v_poi").withColumn("subcategory", F.when(n % 12 == 0, "Venues").when(n % 12 == 1, "Music Festivals").when(n % 12 == 2, "Airport lounge").when(n % 12 == 3, "Stadiums").otherwise(F.col("subcategory")))
    regions = v("v_region").withColumn("launch_status", F.when(F.col("region_id") % 4 == 0, "launched").when(F.col("region_id") % 4 == 1, "draft"))
    seeds = search.poi_seeds(pois).unionByName(search.region_seeds(regions))
    known = search.poi_seeds(pois.where(n % 3 == 0)).withColumns({"app": n_of_key() % 2 == 0, "name": F.lit("Old"), "priority": F.lit(99)})
    gone = known.where("seed_key = 'poi:3'").withColumn("seed_key", F.lit("poi:gone"))
    return search.upsert_seeds(known.unionByName(gone), seeds)


def n_of_key():
    return F.regexp_extract("seed_key", "([0-9]+)$", 1).cast("long")


_SUB = "case poi_id % 12 when 0 then 'venues' when 1 then 'music festivals' when 2 then 'airport lounge' when 3 then 'stadiums' else coalesce(subcategory, '') end"
_KIND = f"case when poi_id % 12 = 1 then 'festival' when poi_id % 12 = 2 then 'airport' when poi_id % 12 = 3 then 'stadium' when category = 'Music Site' and {_SUB} = 'venues' then 'venue' else 'poi' end"
_SEEDS = f"""select 'poi:' || poi_id::varchar as seed_key, name, k as seed_type, case when k = 'venue' then 30 else 60 end as priority, case when k = 'venue' then 1.5 else 1.0 end::double as weight, rating::double as popularity, poi_id % 3 = 0 and poi_id % 2 = 0 as app, case when poi_id % 3 = 0 then 'updated' else 'created' end as action from (select *, {_KIND} as k from {{v_poi}})
union all select 'region:' || region_key, name, case when region_type in ('city', 'metro', 'state') then region_type else 'unknown' end, case when certified then 10 else 20 end, case when certified then 3.0 else 2.0 end, case when certified then 100.0 else 50.0 end, region_id % 4 = 0, 'created' from {{v_region}}
union all select 'poi:gone', 'Old', (select {_KIND} from {{v_poi}} where poi_id = 3), 99, 1.0, (select rating::double from {{v_poi}} where poi_id = 3), false, 'kept'"""
register("e21_search_seeds", lambda v: _seeds(v).select("seed_key", "name", "seed_type", "priority", "weight", "popularity", "app", "action"), _SEEDS)
register("e21_seed_counts", lambda v: _seeds(v).groupBy("action").agg(F.count(F.lit(1)).alias("n")), "select action, count(*) as n from {s} group by 1", s=_SEEDS)


# what a place export holds
_FIELDS = ("name", "address", "phone", "website", "image_url", "zip")


def _profile(v):
    rows = v("v_poi").withColumn("zip", F.lit(None).cast("string"))
    place = lambda c: ~F.coalesce(F.lower(F.col("category")) == "concert", F.lit(False)) & c
    given = {f"{c}_{'present' if there else 'missing'}": place(~text.is_blank(c) if there else text.is_blank(c)) for c in _FIELDS for there in (True, False)}
    given["event_rows"] = F.lower(F.col("category")) == "concert"
    given["coordinates_missing"] = place(F.col("lat").isNull() | F.col("lng").isNull())
    return rollups.export_profile(
        rows, {"category": (None, F.col("category")), "subcategory": (F.col("category"), F.col("subcategory")), "source": (None, F.col("publish_status")), "record": (None, F.col("website"))}, given, {"record": 25}
    )


_COUNT = " union all ".join(
    ["select 'category' as section, '' as within, category as value, count(*) as n from {v_poi} group by 3", "select 'subcategory', category, coalesce(subcategory, 'blank'), count(*) from {v_poi} group by 2, 3", "select 'source', '', publish_status, count(*) from {v_poi} group by 3"]
    + ["select * from (select 'record', '', coalesce(website, 'blank') as w, count(*) as n from {v_poi} group by 3 order by n desc, w limit 25)"]
    + [f"select 'flags', '', '{c}_{name}', count(*) from {{v_poi}} where category <> 'Concert' and coalesce(trim({c}::varchar), '') {op} '' having count(*) > 0" for c in _FIELDS if c != "zip" for name, op in (("present", "<>"), ("missing", "="))]
    + ["select 'flags', '', 'zip_missing', count(*) from {v_poi} where category <> 'Concert'", "select 'flags', '', 'event_rows', count(*) from {v_poi} where category = 'Concert' having count(*) > 0", "select 'flags', '', 'coordinates_missing', count(*) from {v_poi} where category <> 'Concert' and lat is null having count(*) > 0"]
)
register("f19_completeness", _profile, _COUNT)


_KEY = f"{sql_place('name')} || '|' || lower(city) || '|' || lower(state)"
register(
    "e12_venue_upsert",
    lambda v: upsert.fold_latest(v("v_venue").withColumn("k", F.concat_ws("|", text.place_name("name"), F.lower("city"), F.lower("state"))).where("trim(name) <> ''"), "k", ["venue_id"], ["name", "address", "zip"]),
    f"select {_KEY} as k, max_by(name, venue_id) filter (trim(name) <> '') as name, max_by(address, venue_id) filter (trim(address) <> '') as address, max_by(zip, venue_id) filter (zip is not null) as zip from {{v_venue}} where trim(name) <> '' group by 1",
)
