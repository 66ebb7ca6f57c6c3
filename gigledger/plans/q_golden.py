"""Queries of golden tables: what a batch does to them, decided groups, and the table merged on read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import upsert
from ..sources.golden import GoldenTable
from ..sources.shared import shared_folder
from .q_matching import EVENT_KEYS, EVENT_MATCHES, EVENT_ROWS, event_sides
from .registry import register
from .views import VIEWS

ACTION_POLICY = {"genre": "fill", "image_url": "fill", "tickets_link": "replace", "relevance": "raise"}


def _actions(v):
    """Uploaded events as candidates, those of other sources as golden rows."""
    candidates, events, claims = event_sides(v)
    fields = v("v_event").select("event_id", text.lifecycle(F.col("event_status"), F.lit("")).alias("lifecycle"), *ACTION_POLICY)
    candidates = candidates.join(fields.withColumnRenamed("event_id", "candidate_id"), "candidate_id")
    return upsert.upsert_actions(candidates, events.join(fields.drop("lifecycle"), "event_id"), claims, ACTION_POLICY)


_TAKES = {
    "fill": "coalesce(trim(o_{c}::varchar), '') = '' and coalesce(trim({c}::varchar), '') <> ''",
    "replace": "coalesce(trim({c}::varchar), '') <> '' and {c} is distinct from o_{c}",
    "raise": "{c} is not null and (o_{c} is null or {c} > o_{c})",
}
_CHANGED = ", ".join("case when " + _TAKES[r].format(c=c) + f" then '{c}' end" for c, r in ACTION_POLICY.items())
_OLD = ", ".join(f"case when follows is not null then f.{c} else g.{c} end as o_{c}" for c in ACTION_POLICY)
_OWN = ", ".join(f"c.{c}" for c in ACTION_POLICY)
register(
    "e03_upsert_actions",
    lambda v: _actions(v).select("candidate_id", "event_id", "follows", "score", "reason", "action", F.array_join("changed", ",").alias("changed"), "event_key"),
    f"""select candidate_id, event_id, follows, score, reason,
 case when score > 0 and score < 0.7 then 'duplicate_candidate' when cancelled then 'cancelled' when score = 0 then 'created' when changed <> '' then 'updated' else 'skipped' end as action, changed,
 case when score > 0 and score < 0.7 then sha256(event_key || '|' || candidate_id::varchar) else event_key end as event_key
from (select candidate_id, event_id, follows, score, reason, cancelled, event_key, case when score >= 0.7 then concat_ws(',', {_CHANGED}) else '' end as changed
from (select m.candidate_id, m.event_id, follows, case when follows is not null then 0.96 else m.score end as score, case when follows is not null then 'event_key' else m.reason end as reason, regexp_matches(lower(c.event_status), 'cancell?ed') as cancelled, m.event_key, {_OWN}, {_OLD}
from (select *, case when event_id is null and candidate_id <> first_id then first_id end as follows from (select m.*, r.event_key, min(case when m.event_id is null then candidate_id end) over (partition by r.event_key) as first_id from {{m}} m join {{rows}} r on r.event_id = m.candidate_id)) m
join {{v_event}} c on c.event_id = m.candidate_id left join {{v_event}} f on f.event_id = m.follows left join {{v_event}} g on g.event_id = m.event_id))""",
    keys=EVENT_KEYS, rows=EVENT_ROWS, m=EVENT_MATCHES.replace("is not null group by 1) k", "is not null and event_id - event_id % 4 + 1 in (select event_id from {rows} where source_type <> 'file_upload') group by 1) k"),
)

_DECISION = "case primary_id % 3 when 0 then 'merge' when 1 then 'kept_separate' else 'rejected_duplicate' end"
_MEMBERS = f"select event_id, primary_id, {_DECISION} as decision from (select event_id, min(event_id) over w as primary_id from {{keys}} where start_ts is not null window w as (partition by weak_key) qualify count(*) over w > 1)"


def _members(v):
    groups = upsert.duplicate_groups(upsert.event_keys(v("v_event")).where("start_ts is not null"))
    primary = groups.groupBy("weak_key").agg(F.min("event_id").alias("primary_id")).withColumn("decision", F.expr(_DECISION))
    return groups.join(primary, "weak_key").select("event_id", "primary_id", "decision")


register(
    "e07_merged_groups",
    lambda v: upsert.resolve_groups(v("v_event").select("event_id", "genre", "image_url", "duplicate_status"), _members(v), ["genre", "image_url"]).withColumn("changed", F.array_join("changed", ",")),
    """select event_id, ng as genre, ni as image_url, status as duplicate_status, case when decision = 'merge' and primary_id <> event_id then primary_id end as canonical_event_id,
 concat_ws(',', case when ng is distinct from genre then 'genre' end, case when ni is distinct from image_url then 'image_url' end) as changed, (top)::int as updates
from (select e.*, m.primary_id, m.decision, coalesce(m.decision = 'merge' and m.primary_id = e.event_id, false) as top, case when m.decision = 'merge' and m.primary_id = e.event_id then f.genre else e.genre end as ng, case when m.decision = 'merge' and m.primary_id = e.event_id then f.image_url else e.image_url end as ni,
 case when m.decision = 'merge' then case when m.primary_id = e.event_id then 'none' else 'merged' end else coalesce(m.decision, e.duplicate_status) end as status
from {v_event} e left join {m} m on m.event_id = e.event_id left join (select primary_id, min_by(genre, m.event_id) filter (genre is not null) as genre, min_by(image_url, m.event_id) filter (image_url is not null) as image_url from {m} m join {v_event} e on e.event_id = m.event_id group by 1) f on f.primary_id = e.event_id)""",
    keys=EVENT_KEYS, m=_MEMBERS,
)
register("e07_moved_claims", lambda v: upsert.move_claims(v("v_claim").select("claim_id", "event_id"), _members(v)).select("claim_id", "event_id"),
         "select claim_id, case when decision = 'merge' then primary_id else c.event_id end as event_id from {v_claim} c left join {m} m on m.event_id = c.event_id", keys=EVENT_KEYS, m=_MEMBERS)

GOLDEN_POLICY = {"record_id": "fill", "provider": "replace", "amount": "raise"}


def _golden(v):
    """The claims of three kinds of sources as three batches into one table, which is compacted between the last two."""
    lines = v("lineitem")
    spark = lines.sparkSession
    # some ids name several claims: the first in the file counts, as in SQL
    claims = spark.sql(VIEWS["v_claim"].replace("varchar(9)", "string").replace("varchar(20)", "string").replace("\nfrom", ", file, place\nfrom"), lineitem=lines.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")))
    golden = GoldenTable(spark, shared_folder(spark, "golden"), "event_id", GOLDEN_POLICY, "event_id long, record_id string, provider string, amount double", buckets=16)
    for n, kind in enumerate(("api", "ics", "file_upload")):
        golden.upsert(claims.where(F.col("source_type") == kind).withColumn("amount", F.col("amount").cast("double")), n, ["claim_id"], ["file", "place"])
        if n == 1:
            golden.compact(n)
    return golden.rows()


register("l03_golden_table", _golden,
         """select event_id, min_by(record_id, n) filter (record_id is not null) as record_id, max_by(provider, n) as provider, max(amount)::double as amount
from (select *, case source_type when 'api' then 0 when 'ics' then 1 else 2 end as n from {v_claim} qualify row_number() over (partition by event_id, source_type order by claim_id desc) = 1) group by 1""")
