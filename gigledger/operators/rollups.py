"""Grouped counts and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank
from . import filters
from .tickets import CATEGORIES, assess


def upcoming(events: DataFrame, keys: list[str], as_of: Column, start: str = "start_ts") -> DataFrame:
    """Per key: how many events start at or after the clock, and the next start."""
    return events.where(F.col(start) >= as_of).groupBy(*keys).agg(F.count(F.lit(1)).alias("upcoming"), F.min(start).alias("next_start"))


# States of an event that count in its source's metrics.
NOT_DUPLICATE = ("", "none", "unique", "resolved")
PENDING_IMAGE = ("selected_pending_approval", "needs_approval")
PUBLISHABLE = ("approved", "published")
UNPUBLISHED = ("rejected", "stale", "archived", "unpublished")
BAD_TICKET = ("platform_generic_or_app", "non_ticket", "suspicious", "unresolved")


def event_flags(events: DataFrame, keep: list[str]) -> DataFrame:
    """What event_metrics counts of each event, as booleans beside the kept columns, generic_images and claim_count.

    Columns: duplicate_status, tickets_link, image_url, image_status, image_clearance, venue_id,
    location_text, venue_lat, venue_lng, publish_status, claim_count, generic_images (how many
    image candidates are generic); optional: duplicate_group_id, recommended_ticket_link,
    update_count, publish_blockers. A null counts as blank.
    """
    has = lambda c: c in events.columns
    text = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    duplicate = ~text("duplicate_status").isin(*NOT_DUPLICATE)
    if has("duplicate_group_id"):
        duplicate |= F.col("duplicate_group_id").isNotNull()
    no_ticket = is_blank("tickets_link")
    if has("recommended_ticket_link"):
        no_ticket &= is_blank("recommended_ticket_link")
    blocked = text("publish_status").isin(*UNPUBLISHED)
    if has("publish_blockers"):
        blocked |= ~text("publish_blockers").isin("", "[]")
    counts = {
        "missing_ticket_count": no_ticket,
        "bad_ticket_count": assess(F.col("tickets_link")).getField("category").isin(*BAD_TICKET),
        "missing_image_count": is_blank("image_url"),
        "pending_image_count": text("image_status").isin(*PENDING_IMAGE) | (text("image_clearance") == "needs_approval"),
        "missing_venue_count": F.col("venue_id").isNull() & is_blank("location_text"),
        "missing_geo_count": F.col("venue_lat").isNull() | F.col("venue_lng").isNull(),
        "ready_count": text("publish_status").isin(*PUBLISHABLE),
        "blocked_count": blocked,
        "correction_count": F.col("update_count") > 0 if has("update_count") else F.lit(False),
        "duplicate_count": duplicate,
    }
    return events.select(*keep, *[c.alias(n) for n, c in counts.items()], "generic_images", "claim_count")


def event_metrics(events: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of the events of each source, provider or region, one row per key, as scores.trust wants them; columns as of event_flags."""
    return _counted(event_flags(events, keys), keys)


def _counted(flagged: DataFrame, keys: list[str]) -> DataFrame:
    out = flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("event_count"),
        *[F.count_if(n).alias(n) for n in flagged.columns if n not in (*keys, "event_id", "generic_images", "claim_count")],
        F.coalesce(F.sum("generic_images"), F.lit(0)).alias("generic_image_count"),
        F.coalesce(F.sum("claim_count"), F.lit(0)).alias("claim_count"),
    )
    return out.withColumn("duplicate_rate", F.bround(F.col("duplicate_count") / F.col("event_count"), 4))


def crawl_metrics(crawls: DataFrame) -> DataFrame:
    """Per source: success_count, failure_count, unsupported_count, last_success_at of its crawls."""
    return crawls.groupBy("source_id").agg(
        F.count_if(F.col("status") == "success").alias("success_count"),
        F.count_if(F.col("status") == "failed").alias("failure_count"),
        F.count_if(F.col("status") == "unsupported").alias("unsupported_count"),
        F.max(F.when(F.col("status") == "success", F.col("fetched_at"))).alias("last_success_at"),
    )


def source_metrics(events: DataFrame, claimed: DataFrame, crawls: DataFrame) -> DataFrame:
    """Metrics of each source from the events that it claims (source_id, event_id) and its crawls; sources without crawls have zeros.

    Events are judged once each, before they meet their claims.
    """
    flagged = claimed.join(event_flags(events, ["event_id"]), "event_id")
    out = _counted(flagged, ["source_id"]).join(crawl_metrics(crawls), "source_id", "left")
    return out.na.fill(0, ["success_count", "failure_count", "unsupported_count"]).withColumn("rejected_count", F.col("blocked_count"))


def preview_counts(events: DataFrame) -> DataFrame:
    """One row of counts of publishable events with their venue columns: what is missing, doubtful or tracked, and the class of every ticket link (zero where none)."""
    link = assess(F.col("tickets_link"))
    pending = (F.col("image_status") == "selected_pending_approval") | (F.col("image_clearance") == "needs_review")
    conditions = {
        "total_approved_events": F.lit(True),
        "events_missing_images": is_blank("image_url"),
        "events_missing_ticket_links": is_blank("tickets_link"),
        "events_missing_venue_address": is_blank("venue_address"),
        "events_missing_coordinates": F.col("venue_lat").isNull() | F.col("venue_lng").isNull(),
        "events_with_suspicious_tracking": F.size(F.filter(link["flags"], lambda f: f.contains("tracking"))) > 0,
        "events_without_venue_profile": is_blank("venue_name"),
        "duplicate_candidate_events": F.col("duplicate_status") == "duplicate_candidate",
        "weak_dedupe_events": F.col("dedupe_confidence") == "weak",
        "events_with_multiple_source_claims": F.col("claim_count") > 1,
        "events_with_single_source_claim": F.col("claim_count") <= 1,
        "events_with_selected_image": ~is_blank("image_url") & F.col("image_status").isin("accepted", "selected_pending_approval"),
        "events_needing_image_approval": pending,
        "events_with_blocked_image": F.col("image_clearance") == "blocked",
        "events_missing_headliner": is_blank("headliner"),
        "events_missing_genre": is_blank("genre"),
    } | {f"ticket_{c}": link["category"] == c for c in CATEGORIES}
    return conditional_counts(events, [], conditions)


def api_quality_counts(records: DataFrame, as_of: Column) -> DataFrame:
    """One row: eight counts of vendor records by state and provenance, and one per ticket link class (zero where none)."""
    review = lambda state: F.col("review_status") == state
    conditions = {
        "pending": review("pending_review"),
        "held": review("held"),
        "needs_enrichment": review("needs_enrichment"),
        "expiring_soon": filters.soon("compliance_expires_at", as_of),
        "rejected": review("rejected"),
        "unknown_upstream_source": filters.unknown_upstream(),
        "api_backfill_required": filters.needs_backfill(),
        "suspicious_provenance": F.exists("provenance_flags", lambda f: f.startswith("ticket repair:") | f.startswith("ticketing provider detected:")),
    }
    return conditional_counts(records, [], conditions | {f"ticket_{c}": F.col("ticket_link_classification") == c for c in CATEGORIES})


def run_counts(records: DataFrame, run: str) -> DataFrame:
    """Per run: approved, held and rejected records and those that may exist already."""
    review = lambda state: F.col("review_status") == state
    return conditional_counts(records, [run], {"approved_count": review("approved"), "held_count": review("held"), "rejected_count": review("rejected"), "duplicate_candidate_count": F.col("duplicate_status") != "new"})


def review_tabs(rows: DataFrame) -> DataFrame:
    """(tab, n) of the review board's rows: record_type, needs_review, app_feed_ready."""
    kind = lambda k: F.col("record_type") == k
    return conditional_counts(rows, [], {"all": F.lit(True), "normalized": kind("normalized_event"), "api": kind("api_feed_record"), "extracted": kind("extracted_candidate"), "needs_review": F.col("needs_review"), "ready_for_app": F.col("app_feed_ready")})


def beside(*frames: DataFrame) -> DataFrame:
    """The columns of frames of one row each, in one row; without a join."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def audit_counts(attempts: DataFrame, crawls: DataFrame) -> DataFrame:
    """One row of counts over submissions (risk_level, risk_flags, status) and crawls (status, error)."""
    flagged = lambda f: F.array_contains("risk_flags", f)
    of_attempts = conditional_counts(attempts, [], {
        "suspicious_submissions": F.col("risk_level").isin("high", "blocked") | F.col("status").isin("quarantined", "blocked", "rejected"),
        "blocked_submissions": F.col("risk_level") == "blocked",
        "rate_limit_hits": flagged("rate_limit_exceeded"),
        "unauthorised_submissions": flagged("authorization_missing"),
        "fast_submissions": flagged("submitted_too_fast"),
    })
    of_crawls = conditional_counts(crawls, [], {
        "crawl_timeouts": F.col("error").contains("timeout"),
        "failed_crawls": F.col("status") == "failed",
        "unsupported_crawls": F.col("status") == "unsupported",
    })
    return beside(of_attempts, of_crawls)


def zero_filled(counts: DataFrame, labels: list[str], label: str, n: str) -> DataFrame:
    """One row per label, zero where nothing was counted; counts of other labels stay out."""
    wanted = counts.sparkSession.createDataFrame([(x,) for x in labels], f"{label} string")
    return wanted.join(counts, label, "left").select(label, F.coalesce(n, F.lit(0)).alias(n))


def conditional_counts(rows: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    """count_if per condition, by keys (all rows without keys)."""
    return rows.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def metric_rows(wide: DataFrame, keys: list[str]) -> DataFrame:
    """One row per metric of a wide row: keys, metric, value (double)."""
    metrics = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in metrics]).unpivot(keys, metrics, "metric", "value")


def export_profile(rows: DataFrame, values: dict[str, tuple[Column | None, Column]], flags: dict[str, Column], top: dict[str, int]) -> DataFrame:
    """(section, within, value, n): what an export holds, counted in one pass.

    values names sections and, for each, a column to count within (or none) and the column whose
    values are counted, blank as 'blank'; flags names conditions that are counted where they hold. A
    section in `top` keeps its so many most frequent values (ties to the smaller one), cut per task
    before they are compared. Every row is read once, however many sections there are.
    """
    text = lambda c: F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("blank"))
    cells = [F.struct(F.lit(name).alias("section"), (F.lit("") if within is None else text(within)).alias("within"), text(value).alias("value")) for name, (within, value) in values.items()]
    cells += [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit("flags").alias("section"), F.lit("").alias("within"), F.lit(name).alias("value"))) for name, c in flags.items()]
    counted = rows.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.section", "c.within", "c.value").agg(F.count(F.lit(1)).alias("n"))
    if not top:
        return counted
    limit = F.create_map(*[F.lit(x) for kv in top.items() for x in kv])[F.col("section")]
    most = max(top.values())
    ranks = F.col("section").isin(*top)
    # values of the other sections are alone in their windows
    order = Window.partitionBy("section", F.when(~ranks, F.col("within")), F.when(~ranks, F.col("value"))).orderBy(F.col("n").desc(), "value")
    ranked = counted.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    return ranked.where(~ranks | (F.col("_r") <= limit)).drop("_r")
