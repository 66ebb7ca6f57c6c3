"""Readiness, quality, trust and risk scores as column sums; each takes a row that joins have completed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import flags, is_blank
from .filters import DUPLICATE_EXCLUDED, PUBLISHABLE
from .images import normal_role, role_points
from .tickets import assess


def _count(*conditions: Column) -> Column:
    return sum((F.when(c, 1).otherwise(0) for c in conditions), F.lit(0))


def event_readiness(events: DataFrame) -> DataFrame:
    """Twelve checks of an event with its venue columns (venue_name, venue_address, venue_lat, venue_lng).

    Adds readiness (0 to 100, halves to even), blockers and hints (arrays). A null status does not
    block.
    """
    has_place = ~is_blank("venue_address") | (F.col("venue_lat").isNotNull() & F.col("venue_lng").isNotNull())
    blocked = (F.col("image_clearance") == "blocked") | (F.col("image_status") == "rejected")
    pending = (F.col("image_clearance") == "needs_review") | (F.col("image_status") == "selected_pending_approval")
    excluded = F.col("duplicate_status").isin(*DUPLICATE_EXCLUDED)
    dead = F.lower(F.coalesce("event_status", F.lit(""))).rlike("cancell?ed|postponed")
    no = lambda c: F.coalesce(c, F.lit(False))
    missing = {
        "missing_title": is_blank("title"),
        "missing_start": F.col("start_ts").isNull(),
        "missing_venue": is_blank("venue_name"),
        "missing_venue_location": ~no(has_place),
        "missing_ticket_link": is_blank("tickets_link"),
        "image_hard_blocked": no(blocked),
        "duplicate_excluded": no(excluded),
        "not_active": no(dead),
    }
    hints = {"missing_image": is_blank("image_url"), "image_needs_approval": no(pending), "missing_source_claim": F.coalesce("claim_count", F.lit(0)) <= 0, "missing_source_trust_signal": is_blank("provider") & is_blank("source_type")}
    bad = [*missing.values(), *hints.values()]
    return events.withColumns({
        "readiness": F.bround((F.lit(12) - _count(*bad)) * 100 / F.lit(12.0)).cast("long"),
        "blockers": flags(*[(c, n) for n, c in missing.items()]),
        "hints": flags(*[(c, n) for n, c in hints.items()]),
    })


def poi_readiness(pois: DataFrame) -> DataFrame:
    """Eight checks of a place; adds readiness, blockers and hints."""
    place = (F.col("lat").isNotNull() & F.col("lng").isNotNull()) | ~is_blank("address")
    logo = F.lower(F.coalesce("image_url", F.lit(""))).contains("logo")
    missing = {
        "missing_name": is_blank("name"),
        "missing_category": is_blank("category"),
        "missing_location": ~F.coalesce(place, F.lit(False)),
        "possible_duplicate": F.lower(F.coalesce("quality_control", F.lit(""))).contains("duplicate"),
        "missing_stable_id": F.col("poi_id").isNull(),
    }
    hints = {"missing_subcategory": is_blank("subcategory"), "missing_website_or_source_url": is_blank("website") & is_blank("places_id"), "missing_image": is_blank("image_url") | logo}
    return pois.withColumns({
        "readiness": F.bround((F.lit(8) - _count(*missing.values(), *hints.values())) * 100 / F.lit(8.0)).cast("long"),
        "blockers": flags(*[(c, n) for n, c in missing.items()]),
        "hints": flags(*[(c, n) for n, c in hints.items()]),
    })


# Points of the parts of event quality, one hundred in all.
QUALITY_POINTS = (("title", 8), ("start", 8), ("venue", 8), ("location", 7), ("ticket", 7), ("good_ticket", 8), ("chosen_image", 9), ("clean_image", 8), ("settled_image", 7), ("artist", 7), ("relevant", 7), ("single", 7), ("claimed", 4), ("feed_ready", 5))


def event_quality(ready: DataFrame) -> DataFrame:
    """Quality 0 to 100 of rows from event_readiness; adds feed_ready, quality and quality_flags (sorted)."""
    has_image, has_ticket = ~is_blank("image_url"), ~is_blank("tickets_link")
    bad_ticket = has_ticket & ~assess(F.col("tickets_link")).getField("usable")
    pending = (F.col("image_status") == "selected_pending_approval") | (F.col("image_clearance") == "needs_review")
    duplicate = ~F.lower(F.trim(F.coalesce("duplicate_status", F.lit("")))).isin("", "none", "unique", "resolved", "kept_separate")
    feed_ready = F.col("publish_status").isin(*PUBLISHABLE) & (F.col("readiness") >= 80) & (F.size("blockers") == 0) & ~pending
    held = {
        "title": ~is_blank("title"),
        "start": F.col("start_ts").isNotNull(),
        "venue": ~is_blank("venue_name"),
        "location": F.col("venue_lat").isNotNull() | ~is_blank("venue_address"),
        "ticket": has_ticket,
        "good_ticket": has_ticket & ~bad_ticket,
        "chosen_image": has_image & F.col("image_status").isin("accepted", "selected_pending_approval"),
        "clean_image": has_image & (F.col("image_clearance") != "blocked"),
        "settled_image": has_image & ~pending,
        "artist": ~is_blank("headliner"),
        "relevant": F.col("relevance") >= 50,
        "single": ~duplicate,
        "claimed": F.col("claim_count") > 0,
        "feed_ready": feed_ready,
    }
    more = flags(
        (bad_ticket, "bad_generic_ticket_link"),
        (F.col("venue_lat").isNull(), "missing_coordinates"),
        (duplicate, "duplicate_candidate"),
        (F.coalesce("dedupe_confidence", F.lit("")).isin("", "weak", "medium", "low"), "weak_dedupe_confidence"),
        (F.col("relevance") < 50, "low_music_relevance"),
        (is_blank("headliner"), "missing_artist_headliner"),
        (is_blank("genre"), "missing_genre"),
        (F.coalesce(~feed_ready, F.lit(True)), "not_app_feed_ready"),
        (F.col("claim_count") > 1, "multiple_source_claims"),
    )
    return ready.withColumns({
        "feed_ready": F.coalesce(feed_ready, F.lit(False)),
        "quality": sum((F.when(held[n], points).otherwise(0) for n, points in QUALITY_POINTS), F.lit(0)).cast("long"),
        "quality_flags": F.array_sort(F.array_distinct(F.concat("blockers", "hints", more))),
    })


def grade(score: Column) -> Column:
    """Grades with inclusive lower bounds; unknown without a score."""
    return F.when(score.isNull(), "unknown").when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 60, "fair").when(score >= 40, "poor").otherwise("blocked")


def trust(metrics: DataFrame, as_of: Column) -> DataFrame:
    """Trust 0 to 100 of sources from their metrics, with a grade; no metrics at all give 60.

    Columns: event_count, success_count, failure_count, unsupported_count, rejected_count,
    duplicate_rate, missing_ticket_count, missing_image_count, missing_geo_count, ready_count,
    last_success_at; optional: bad_ticket_count, generic_image_count, pending_image_count,
    missing_venue_count, blocked_count, correction_count, claim_count, trusted. Nulls and absent
    columns count as zero.
    """
    absent = {"bad_ticket_count", "generic_image_count", "pending_image_count", "missing_venue_count", "blocked_count", "correction_count", "claim_count", "trusted"} - set(metrics.columns)
    given, metrics = metrics.columns, metrics.withColumns({c: F.lit(0) for c in sorted(absent)}) if absent else metrics
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    events = F.greatest(n("event_count"), F.lit(1.0))
    lose = lambda most, value: F.least(F.lit(float(most)), value)
    nothing = n("event_count") + n("success_count") + n("failure_count") + n("unsupported_count") + n("rejected_count") == 0
    score = (
        F.lit(100.0)
        - lose(25, n("failure_count") * 12)
        - lose(18, n("unsupported_count") * 8)
        - lose(22, n("duplicate_rate") * 35)
        - lose(18, n("rejected_count") * 4)
        - lose(18, n("missing_ticket_count") / events * 22)
        - lose(16, n("missing_image_count") / events * 20)
        - lose(10, n("missing_geo_count") / events * 14)
        - lose(16, n("bad_ticket_count") / events * 20)
        - lose(12, n("generic_image_count") * 4)
        - lose(8, n("pending_image_count") * 2)
        - lose(12, n("missing_venue_count") / events * 18)
        - lose(10, n("blocked_count") * 3)
        - lose(8, n("correction_count") * 1.5)
        + F.when(n("trusted") > 0, 3.0).otherwise(0.0)
        + F.when(n("claim_count") > n("event_count"), 3.0).otherwise(0.0)
        - F.when((n("event_count") > 0) & F.col("last_success_at").isNull(), 8.0).otherwise(0.0)
        + lose(8, n("ready_count") / events * 10)
        + lose(6, n("success_count") * 2)
        + lose(5, F.greatest(F.lit(0.0), n("event_count") - n("missing_image_count")) / events * 5)
        + lose(5, F.greatest(F.lit(0.0), n("event_count") - n("missing_ticket_count")) / events * 5)
        + F.when(F.col("last_success_at") >= as_of - F.expr("interval 45 days"), 3.0).otherwise(0.0)
    )
    kept = F.when(nothing, 60.0).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 1))
    return metrics.withColumn("trust", kept).select(*given, "trust", grade(F.col("trust")).alias("trust_grade"))


def recommendations(most: int = 5) -> Column:
    """The most pressing pieces of advice, most urgent first."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    ranked = [
        (95, n("failure_count") > 0, "fix extraction failures"),
        (90, n("unsupported_count") > 0, "classify unsupported formats"),
        (85, n("duplicate_rate") >= 0.25, "look into duplicates"),
        (80, n("missing_ticket_count") > 0, "repair ticket links"),
        (70, n("missing_image_count") > 0, "find images"),
        (62, n("missing_geo_count") > 0, "add coordinates"),
        (60, (n("ready_count") == 0) & (n("event_count") > 0), "review blockers"),
    ]
    advice = flags(*[(c, t) for _, c, t in ranked])
    return F.slice(F.when(F.size(advice) == 0, F.array(F.lit("keep monitoring"))).otherwise(advice), 1, most)


def health() -> Column:
    """Ladder over status, has_profile, unsupported_count, failed_count, ok_count, last_failed, last_ok, last_events, average_events, duplicate_rate, missing_ticket_rate, missing_image_rate."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        F.when(F.col("status") == "paused", "paused")
        .when(~F.coalesce("has_profile", F.lit(False)), "watch")
        .when(n("unsupported_count") > 0, "unsupported")
        .when((n("failed_count") >= 3) & ((n("ok_count") == 0) | F.col("last_failed")), "failing")
        .when(F.col("last_failed") & ~F.col("last_ok"), "watch")
        .when(F.col("last_failed"), "needs_review")
        .when((n("last_events") == 0) & (n("average_events") > 0), "watch")
        .when((n("duplicate_rate") >= 0.4) | (n("missing_ticket_rate") >= 0.6) | (n("missing_image_rate") >= 0.6), "needs_review")
        .otherwise("healthy")
    )


# Points of the parts of a submission's risk.
RISK_POINTS = (("honeypot_filled", 85), ("submitted_too_fast", 50), ("authorization_missing", 80), ("dangerous_url", 80), ("invalid_url_scheme", 80), ("many_query_parameters", 10), ("social_media_profile_url", 35), ("duplicate_url", 15), ("blocked_submitter_or_domain", 80), ("trusted_submitter_or_domain", -20), ("rate_limit_exceeded", 80), ("too_many_recent_submissions", 35), ("many_unrelated_domains", 25), ("repeated_invalid_submissions", 25))


def risk(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Adds risk_score (never below 0), risk_level (80 blocked, 50 high, 20 medium, low) and sorted risk_flags."""
    known = [(n, p) for n, p in RISK_POINTS if n in conditions]
    score = F.greatest(F.lit(0), sum((F.when(conditions[n], p).otherwise(0) for n, p in known), F.lit(0)))
    out = rows.withColumns({"risk_score": score.cast("long"), "risk_flags": F.array_sort(flags(*[(conditions[n], n) for n, _ in known]))})
    return out.withColumn("risk_level", F.when(F.col("risk_score") >= 80, "blocked").when(F.col("risk_score") >= 50, "high").when(F.col("risk_score") >= 20, "medium").otherwise("low"))


def image_score(rows: DataFrame) -> DataFrame:
    """Adds image_score (0 to 100, two decimals), blocked and generic: a short form for sources that state little more than a size and a clearance.

    images.candidate_scores is the full form. The points of the role are the same, the others are this form's own:

    role .28, technical .24, subject .20, provenance .16, approval .12 of scores of 0 to 100, less
    45 for provider graphics, 18 for a late priority (160 or more), plus 6 for an early one (40 or
    less); a rejected clearance scores 0. Columns: role, width, height, url, status, clearance,
    priority.
    """
    role = role_points(normal_role("role"))
    technical = F.when((F.col("width") >= 1200) & (F.col("height") >= 600), 100.0).when(F.col("width") >= 720, 70.0).when(F.col("width") >= 320, 40.0).otherwise(10.0)
    subject = F.when(F.col("role").isin("headliner", "event"), 90.0).when(F.col("role").startswith("venue"), 60.0).otherwise(30.0)
    provenance = F.when(F.lower("url").rlike("^https://"), 80.0).otherwise(40.0)
    approval = F.when(F.col("clearance") == "approved", 100.0).when(F.col("clearance") == "needs_review", 50.0).otherwise(0.0)
    generic = F.lower("url").rlike("logo|placeholder|default|sprite")
    severe = (F.col("width") < 720) | (F.least("width", "height") < 400)
    blocked = F.col("clearance").isin("blocked", "rejected") | (F.col("status") == "rejected") | generic | F.coalesce(severe, F.lit(False))
    score = role * 0.28 + technical * 0.24 + subject * 0.2 + provenance * 0.16 + approval * 0.12 - F.when(generic, 45.0).otherwise(0.0)
    score += F.when(F.col("priority") <= 40, 6.0).when(F.col("priority") >= 160, -18.0).otherwise(0.0)
    score = F.when(F.col("clearance") == "rejected", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))
    return rows.withColumns({"image_score": F.round(score, 2), "blocked": blocked, "generic": generic})


def issue_ratio(bad: Column, total: Column) -> Column:
    """100 less the share of issues, half-even to one decimal; 100 without rows."""
    return F.when(total == 0, 100.0).otherwise(F.bround(F.greatest(F.lit(0.0), 100 - bad * 100.0 / total), 1))


def platform_type(url, content_type, body, unsupported: Column | None = None) -> Column:
    """What kind of site a crawled body comes from, by a ladder over its content type, whole body and URL."""
    low, link, kind = (F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) for c in (body, url, content_type))
    ladder = [
        (unsupported if unsupported is not None else F.lit(False), "unsupported"),
        (kind.contains("text/calendar") | link.rlike(r"\.ics($|[?#])") | low.contains("begin:vcalendar"), "ics"),
        (kind.rlike("rss|atom") | low.rlike("<rss[ >]|<feed[ >]"), "rss_atom"),
        (link.contains("eventbrite."), "eventbrite_page"),
        (low.contains("the-events-calendar") | low.contains("tribe-events"), "the_events_calendar"),
        (low.contains("wp-content") | low.contains("wp-json"), "wordpress_events"),
        (low.contains("application/ld+json"), "json_ld"),
        (link.contains("tourism") | F.regexp_extract(link, "^[a-z]+://([^/?#]*)", 1).contains("visit"), "tourism_board_calendar"),
        (link.contains("calendar") | link.contains("events"), "venue_calendar"),
        (low.contains("<html") | low.contains("<article") | low.contains("<div"), "static_html"),
    ]
    out = F.lit("unknown")
    for condition, name in reversed(ladder):
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return out


def count_score(issues: Column, total: Column) -> Column:
    """100 less the rounded percentage of issues (halves to even), within 0 and 100; 100 without rows."""
    return F.when(total <= 0, F.lit(100)).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.bround(issues / total * 100)))).cast("long")
