"""Keys, deduplication and merges of golden tables with their provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, dedupe_text, event_url, geo_key, hash_of, is_blank, place_name
from .matching import match_events


def event_keys(rows: DataFrame) -> DataFrame:
    """Adds strong_key, medium_key, weak_key, event_key and key_confidence.

    Columns: provider, source_event_id, source_type, source_url, title, headliner, start_ts,
    location_text, tickets_link. The provider's id wins over the calendar's and the upload's; without
    an id the medium key of title, start minute, venue and ticket link counts.
    """
    title, minute = dedupe_text(F.coalesce(clean("headliner"), F.col("title"))), F.date_format(F.date_trunc("minute", "start_ts"), "yyyy-MM-dd HH:mm")
    has_id = clean("source_event_id").isNotNull()
    strong = (
        F.when(has_id & clean("provider").isNotNull(), hash_of(F.lit("provider"), F.col("provider"), F.col("source_event_id")))
        .when(has_id & (F.col("source_type") == "ics"), hash_of(F.lit("ics"), event_url("source_url"), F.col("source_event_id")))
        .when(has_id & (F.col("source_type") == "file_upload"), hash_of(F.lit("file"), F.col("source_event_id"), dedupe_text("title"), F.to_date("start_ts")))
    )
    medium = hash_of(F.lit("event-medium"), title, minute, dedupe_text("location_text"), event_url("tickets_link"))
    return rows.withColumns({"strong_key": strong, "medium_key": medium, "weak_key": hash_of(F.lit("event-weak"), title, minute)}).withColumns({
        "event_key": F.coalesce("strong_key", "medium_key"),
        "key_confidence": F.when(F.col("strong_key").isNotNull(), "strong").otherwise("medium"),
    })


def claim_key(provider, provider_event_id, source_type, record_id, event_key) -> Column:
    """Provider event, then source record, then the event's own key."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return (
        F.when(clean(provider_event_id).isNotNull() & clean(provider).isNotNull(), hash_of(F.lit("provider-event"), c(provider), c(provider_event_id)))
        .when(clean(record_id).isNotNull() & clean(source_type).isNotNull(), hash_of(F.lit("source-record"), c(source_type), c(record_id)))
        .otherwise(hash_of(F.lit("claim"), c(source_type), c(event_key)))
    )


def duplicate_groups(events: DataFrame, key: str = "weak_key", id_col: str = "event_id") -> DataFrame:
    """(key, event_id, role, n): members of keys that more than one row holds; the first by id may be the primary one.

    Sizes and first ids are aggregated first, so a key of a third of all rows needs no window over it.
    """
    groups = events.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id")).where("n > 1")
    role = F.when(F.col(id_col) == F.col("first_id"), "possible_primary").otherwise("duplicate_candidate")
    return events.select(key, id_col).join(groups, key).select(key, id_col, role.alias("role"), "n")


def merge_fields(golden: DataFrame, incoming: DataFrame, key: str, policy: dict[str, str]) -> DataFrame:
    """Merge one incoming row per key into the golden rows by a policy per column.

    fill: only where the golden value is blank; replace: whenever the incoming one is not blank;
    raise: only if the incoming number is higher; keep: never. Adds changed (names of changed
    columns) and action: created, updated, skipped or kept (no incoming row).
    """
    g, i = golden.alias("g"), incoming.alias("i")
    both = g.join(i, F.col(f"g.{key}") == F.col(f"i.{key}"), "full")
    new, old = F.col(f"g.{key}").isNull(), F.col(f"i.{key}").isNull()
    values, changes = [], []
    for column, rule in policy.items():
        a, b = F.col(f"g.{column}"), F.col(f"i.{column}")
        empty = lambda c: is_blank(c.cast("string"))
        takes = {"fill": empty(a) & ~empty(b), "replace": ~empty(b), "raise": ~empty(b) & (empty(a) | (b > a)), "keep": F.lit(False)}[rule]
        value = F.when(new, b).when(F.coalesce(takes, F.lit(False)), b).otherwise(a)
        values.append(value.alias(column))
        changes.append(F.when(~new & ~old & ~value.eqNullSafe(a), F.lit(column)))
    changed = F.array_compact(F.array(*changes))
    action = F.when(new, "created").when(old, "kept").when(F.size(changed) > 0, "updated").otherwise("skipped")
    return both.select(F.coalesce(f"g.{key}", f"i.{key}").alias(key), *values, changed.alias("changed"), action.alias("action"))


def fold_latest(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """One row per key with the last value of each column that is not blank, by a total order of columns."""
    last = lambda c: F.max_by(F.when(~is_blank(F.col(c).cast("string")), F.col(c)), F.when(~is_blank(F.col(c).cast("string")), F.struct(*order)))
    return rows.groupBy(key).agg(*[last(c).alias(c) for c in columns])


def fold_first(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """One row per key with the first value of each column that is not blank."""
    first = lambda c: F.min_by(F.when(~is_blank(F.col(c).cast("string")), F.col(c)), F.when(~is_blank(F.col(c).cast("string")), F.struct(*order)))
    return rows.groupBy(key).agg(*[first(c).alias(c) for c in columns])


DECISIONS = ("merge", "kept_separate", "rejected_duplicate")


def resolve_groups(events: DataFrame, members: DataFrame, columns: list[str]) -> DataFrame:
    """Apply decided groups of events.

    members: event_id, primary_id, decision (one of DECISIONS, the same for a whole group). In a merged group the
    primary takes missing values from its duplicates by id and the duplicates become merged; in
    the other groups every member gets the decision as its status and keeps its values. Returns
    event_id, the columns, duplicate_status, canonical_event_id, changed (names of columns that a
    primary took) and updates (1 for a primary that a merge touched, else 0).
    """
    in_group = events.join(members, "event_id", "left")
    merged_group = F.coalesce(F.col("decision") == "merge", F.lit(False))
    filled = fold_first(in_group.where(merged_group).withColumn("late", F.col("event_id") != F.col("primary_id")), "primary_id", ["late", "event_id"], columns)
    filled = filled.select(F.col("primary_id").alias("event_id"), *[F.col(c).alias(f"f_{c}") for c in columns])
    out = in_group.join(filled, "event_id", "left")
    primary = merged_group & (F.col("primary_id") == F.col("event_id"))
    value = {c: F.when(primary, F.coalesce(f"f_{c}", c)).otherwise(F.col(c)) for c in columns}
    status = F.when(primary, "none").when(merged_group, "merged").when(F.col("decision").isNotNull(), F.col("decision")).otherwise(F.col("duplicate_status"))
    return out.select(
        "event_id",
        *[v.alias(c) for c, v in value.items()],
        status.alias("duplicate_status"),
        F.when(merged_group & ~primary, F.col("primary_id")).alias("canonical_event_id"),
        F.array_compact(F.array(*[F.when(~v.eqNullSafe(F.col(c)), F.lit(c)) for c, v in value.items()])).alias("changed"),
        primary.cast("int").alias("updates"),
    )


def move_claims(claims: DataFrame, members: DataFrame) -> DataFrame:
    """Claims of the events of merged groups go to their primary event."""
    merged = members.where("decision = 'merge'").select("event_id", "primary_id")
    return claims.join(merged, "event_id", "left").withColumn("event_id", F.coalesce("primary_id", "event_id")).drop("primary_id")


def upsert_actions(candidates: DataFrame, events: DataFrame, claims: DataFrame, policy: dict[str, str], least: float = 0.7) -> DataFrame:
    """What a batch of candidates does to the golden events.

    candidates: candidate_id, claim_key, event_key, title, start_ts, venue, lifecycle and the
    policy's columns; events: event_id, event_key, title, start_ts, venue and the policy's columns;
    claims: claim_key, event_id. A candidate that matches nothing is created; of several with one
    new key the one with the smallest id is, and the others meet it as its later versions. A match
    below `least` becomes a weak duplicate under a key of its own. A better match is updated where
    the policy takes any of its values, else skipped. Every candidate is compared with the golden
    values from before the batch. A cancelled candidate is cancelled, unless it is a weak duplicate.

    Returns candidate_id, event_id (the golden event met), follows (the new candidate met), score,
    reason, action, changed and event_key.
    """
    known = claims.join(events.select("event_id"), "event_id", "left_semi")  # a claim of an event that is no longer there tells nothing
    found = candidates.join(match_events(candidates, events, known), "candidate_id")
    values = F.struct(*policy)
    none = F.col("event_id").isNull()
    firsts = found.where(none & F.col("event_key").isNotNull()).groupBy("event_key").agg(F.min_by(F.struct(F.col("candidate_id").alias("first_id"), values.alias("first")), "candidate_id").alias("f")).select("event_key", "f.*")
    golden = events.select("event_id", values.alias("golden"))
    out = found.join(firsts, "event_key", "left").join(golden, "event_id", "left")
    follows = F.when(none & (F.col("first_id") != F.col("candidate_id")), F.col("first_id"))
    out = out.withColumn("follows", follows).withColumns({
        "score": F.when(F.col("follows").isNotNull(), 0.96).otherwise(F.col("score")),
        "reason": F.when(F.col("follows").isNotNull(), "event_key").otherwise(F.col("reason")),
        "old": F.when(F.col("follows").isNotNull(), F.col("first")).otherwise(F.col("golden")),
    })
    changes = []
    for c, rule in policy.items():
        a, b = F.col(f"old.{c}"), F.col(c)
        blank = lambda x: is_blank(x.cast("string"))
        takes = {"fill": blank(a) & ~blank(b), "replace": ~blank(b), "raise": ~blank(b) & (blank(a) | (b > a)), "keep": F.lit(False)}[rule]
        changes.append(F.when(F.coalesce(takes, F.lit(False)) & ~a.eqNullSafe(b), F.lit(c)))
    met, weak = F.col("score") > 0, (F.col("score") > 0) & (F.col("score") < least)
    out = out.withColumn("changed", F.when(met & ~weak, F.array_compact(F.array(*changes))).otherwise(F.array().cast("array<string>")))
    cancelled = F.coalesce(F.col("lifecycle") == "cancelled", F.lit(False))
    action = F.when(weak, "duplicate_candidate").when(cancelled, "cancelled").when(~met, "created").when(F.size("changed") > 0, "updated").otherwise("skipped")
    return out.select(
        "candidate_id", "event_id", "follows", "score", "reason", action.alias("action"), "changed",
        F.when(weak, hash_of(F.col("event_key"), F.col("candidate_id"))).otherwise(F.col("event_key")).alias("event_key"),
    )


def poi_key(rows: DataFrame) -> DataFrame:
    """Adds poi_key and poi_key_confidence: name with place, then stable ids, then name with address."""
    name, geo = place_name("name"), geo_key("lat", "lng")
    low = lambda c: F.lower(clean(c))
    key = (
        F.when((name != "") & geo.isNotNull(), F.concat(F.lit("name_geo:"), name, F.lit("|"), geo))
        .when(low("places_id").isNotNull(), F.concat(F.lit("places_id:"), low("places_id")))
        .when(low("export_id").isNotNull(), F.concat(F.lit("export_id:"), low("export_id")))
        .otherwise(F.concat(F.lit("name_location:"), F.concat_ws("|", name, F.lower(F.coalesce("city", F.lit(""))), F.lower(F.coalesce("state", F.lit(""))), place_name("address"))))
    )
    return rows.withColumn("poi_key", key).withColumn("poi_key_confidence", F.when(F.col("poi_key").startswith("name_location:"), "weak").otherwise("strong"))


def first_pairs(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, a, b): the first two ids of each key that several rows hold."""
    w = Window.partitionBy(key).orderBy(id_col)
    return rows.select(key, id_col, F.row_number().over(w).alias("n")).where("n <= 2").groupBy(key).agg(F.min(id_col).alias("a"), F.max(id_col).alias("b"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


def key_index(keys: DataFrame) -> DataFrame:
    """(strategy, key, refs, first_id) of keyed rows; refs above one are collisions."""
    return keys.groupBy("strategy", "key").agg(F.count(F.lit(1)).alias("refs"), F.min("id").alias("first_id"))


def feed_status(records: DataFrame, key: str, id_col: str, known: DataFrame) -> DataFrame:
    """new, duplicate_within_run (a smaller id has the key) or possible_existing_event (a known row has it); rows without a key are new."""
    first = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_col).alias("first_id"))
    out = records.join(first, key, "left").join(known.select(F.col(key), F.lit(True).alias("known")).distinct(), key, "left")
    status = F.when(F.col(id_col) != F.col("first_id"), "duplicate_within_run").when(F.col("known"), "possible_existing_event").otherwise("new")
    return out.select(id_col, status.alias("status"))


def decide(rows: DataFrame, decisions: DataFrame, id_col: str, allowed: Column) -> DataFrame:
    """Apply decisions (id, decision): approve needs the gate, all others pass; adds outcome, null without a decision."""
    out = rows.join(decisions, id_col, "left")
    outcome = F.when(F.col("decision").isNull(), None).when((F.col("decision") == "approve") & ~F.coalesce(allowed, F.lit(False)), "refused").otherwise(F.col("decision"))
    return out.withColumn("outcome", outcome)


def registry(rows: DataFrame, key: str, seen: str, risk: str, flags: str, submitter: str) -> DataFrame:
    """One row per key: first and last seen, the flags of the highest risk, how many submitters and submissions."""
    return rows.groupBy(key).agg(F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.max(risk).alias("risk"), F.max_by(flags, F.struct(risk, flags)).alias("flags"), F.countDistinct(submitter).alias("submitters"), F.count(F.lit(1)).alias("submissions"))


def new_candidates(rows: DataFrame, known: DataFrame, id_col: str) -> DataFrame:
    """The candidates that are not known yet: (id, source_type, run_id, name_key, city, state), the smallest id of each.

    Both have source_type, run_id, name, city, state. A candidate is the same as another of its
    source, run, normalised name, city and state, blank and null alike; rows without a name are none.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))).alias(c)
    keys = ["source_type", "run_id", "name_key", "city", "state"]
    side = lambda d, *more: d.select(*more, F.coalesce("source_type", F.lit("")).alias("source_type"), F.coalesce(F.col("run_id").cast("string"), F.lit("")).alias("run_id"), place_name("name").alias("name_key"), low("city"), low("state")).where("name_key <> ''")
    first = side(rows, id_col).groupBy(*keys).agg(F.min(id_col).alias(id_col))
    return first.join(side(known).distinct(), keys, "left_anti").select(id_col, *keys)
