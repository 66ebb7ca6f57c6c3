"""Row filters of the feeds, boards and search screens. Every option left out filters nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import MILES, haversine
from ..functions.text import clean, flags, is_blank

# States that keep an event or a place out of the feed.
DUPLICATE_EXCLUDED = ("duplicate_candidate", "merged", "rejected")
PUBLISHABLE = ("approved", "published")


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def contains_text(needle: str, *columns) -> Column:
    """Case-blind search over several columns joined by spaces."""
    return F.lower(F.concat_ws(" ", *columns)).contains(needle.strip().lower())


def event_feed(
    events: DataFrame,
    start=None,
    end=None,
    genre: str | None = None,
    include_cancelled: bool = False,
    include_needs_approval: bool = True,
    **equal,
) -> DataFrame:
    """Publishable events that are neither cancelled nor excluded as duplicates.

    start counts, end does not. genre must equal genre, normalized_genre or music_category, or stand
    in the array normalized_genres; columns that the events lack are passed over. equal names columns
    and the value each must have (event_id, venue_id, region_id, and the venue's city, state, country).
    """
    conditions = [F.col("publish_status").isin(*PUBLISHABLE), ~F.col("duplicate_status").isin(*DUPLICATE_EXCLUDED)]
    if not include_cancelled:
        conditions.append(~F.lower("event_status").rlike("cancell?ed"))
    if start is not None:
        conditions.append(F.col("start_ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        conditions.append(F.col("start_ts") < F.lit(end).cast("timestamp"))
    if genre is not None:
        named = [F.coalesce(F.col(c) == genre, F.lit(False)) for c in ("genre", "normalized_genre", "music_category") if c in events.columns]
        listed = [F.coalesce(F.array_contains(c, genre), F.lit(False)) for c in ("normalized_genres",) if c in events.columns]
        conditions.append(reduce(lambda a, b: a | b, named + listed, F.lit(False)))
    if not include_needs_approval:
        conditions.append((F.col("image_status") != "selected_pending_approval") & (F.col("image_clearance") != "needs_approval"))
    return events.where(every(conditions + [F.col(c) == value for c, value in equal.items() if value is not None]))


def publishable(rows: DataFrame) -> DataFrame:
    """Approved or published rows."""
    return rows.where(F.col("publish_status").isin(*PUBLISHABLE))


def poi_feed(pois: DataFrame, upcoming: DataFrame | None = None, key: str = "poi_id", has_upcoming: bool = False, **equal) -> DataFrame:
    """Publishable places, never those of the concert category.

    equal names columns and the value each must have (category, subcategory, city, state, country,
    region_id). upcoming has a row per key with a number `upcoming`, which every place then carries
    (0 where there is none); has_upcoming keeps places that have some.
    """
    conditions = [F.col("publish_status").isin(*PUBLISHABLE), F.lower("category") != "concert"]
    out = pois.where(every(conditions + [F.col(c) == value for c, value in equal.items() if value is not None]))
    if upcoming is not None:
        out = out.join(upcoming.select(key, "upcoming"), key, "left").withColumn("upcoming", F.coalesce("upcoming", F.lit(0)))
        out = out.where(F.col("upcoming") > 0) if has_upcoming else out
    return out


def hide_blocked(rows: DataFrame) -> DataFrame:
    """Board rows whose image is not blocked."""
    return rows.where(F.col("image_clearance") != "blocked")


# The fields that the board's free text search and its search for a place look at.
BOARD_TEXT = ("title", "venue_name", "address", "city", "state", "description", "genre", "source_label", "provider", "record_label")
BOARD_PLACE = ("venue_name", "address", "city", "state")
# Tabs of the board that stand for a kind of record.
BOARD_KINDS = {"normalized": "normalized_event", "api": "api_feed_record", "extracted": "extracted_candidate"}


def review_board(
    rows: DataFrame,
    tab: str = "all",
    search: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    location: str | None = None,
    around: tuple[float, float, float] | None = None,
    source_type: str | None = None,
    provider: str | None = None,
    venue_status: str | None = None,
    quality_issue: str | None = None,
    **containing: str | None,
) -> DataFrame:
    """Rows of the review board by any of seventeen wishes; blank ones filter nothing.

    around is (lat, lng, miles); a row without coordinates stays only where a city or state is
    wished for, too. Days count from date_from to date_to, both included; rows without a start go
    when one is given. source_badges, venue_badges and quality_flags are arrays. containing names
    columns and a text each must contain, whatever its case (city, state, genre, review_status,
    image_status, ticket_status, duplicate_status, app_feed_readiness).
    """
    wish = lambda t: (t or "").strip().lower()
    has = lambda c, t: F.lower(F.coalesce(c, F.lit(""))).contains(wish(t))
    any_has = lambda c, t: F.coalesce(F.exists(c, lambda x: F.lower(x).contains(wish(t))), F.lit(False))
    conditions = [has(c, t) for c, t in containing.items() if wish(t)]
    if tab in BOARD_KINDS:
        conditions.append(F.col("record_type") == BOARD_KINDS[tab])
    elif tab == "needs_review":
        conditions.append(F.col("needs_review"))
    elif tab == "ready_for_app":
        conditions.append(F.col("app_feed_ready"))
    if wish(search):
        conditions.append(contains_text(search, *(F.coalesce(c, F.lit("")) for c in BOARD_TEXT), F.array_join("quality_flags", " ")))
    if wish(location):
        conditions.append(contains_text(location, *(F.coalesce(c, F.lit("")) for c in BOARD_PLACE)))
    if date_from:
        conditions.append(F.col("start_ts") >= F.to_timestamp(F.lit(date_from)))
    if date_to:
        conditions.append(F.col("start_ts") < F.to_timestamp(F.lit(date_to)) + F.expr("interval 1 day"))
    if around:
        lat, lng, miles = around
        placeless = bool(wish(containing.get("city")) or wish(containing.get("state")))
        conditions.append(F.coalesce(haversine(F.lit(lat), F.lit(lng), "lat", "lng", MILES) <= miles, F.lit(placeless)))
    if wish(source_type):
        conditions.append(has("source_type", source_type) | any_has("source_badges", source_type))
    if wish(provider):
        conditions.append(has("provider", provider) | has("source_label", provider))
    if wish(venue_status):
        conditions.append(any_has("venue_badges", wish(venue_status).replace("_", " ")))
    if wish(quality_issue):
        conditions.append(any_has("quality_flags", quality_issue))
    return rows.where(every(conditions))


def poi_buckets(candidates: DataFrame) -> DataFrame:
    """Place candidates (review_status, match_status, candidate_flags) with one boolean column per review bucket."""
    flagged = lambda *names: F.arrays_overlap("candidate_flags", F.array(*[F.lit(n) for n in names]))
    review = lambda state: F.coalesce(F.col("review_status") == state, F.lit(False))
    match = lambda state: F.coalesce(F.col("match_status") == state, F.lit(False))
    return candidates.withColumns({
        "pending_review": review("pending_review"),
        "matched_existing": match("matched_existing"),
        "possible_duplicate": match("possible_duplicate"),
        "new_candidate": match("new_candidate"),
        "needs_research": review("needs_research"),
        "missing_coordinates": flagged("missing_geo"),
        "missing_image": flagged("missing_image"),
        "bad_social_image": flagged("social_image_url", "non_direct_image_url", "additional_social_image_url", "logo_image"),
        "missing_category": flagged("missing_category"),
        "weak_music_signal": flagged("weak_music_signal"),
        "event_venue_only": match("event_venue_only"),
        "approved_created": match("approved_created"),
        "rejected": review("rejected"),
    })


def within(rows: DataFrame, lat: float, lng: float, miles: float, radius: float = MILES) -> DataFrame:
    """Rows at most so many miles away, with the distance; a latitude band goes first, rows without coordinates go."""
    degrees = miles / radius * 180 / 3.141592653589793
    near = rows.where(F.col("lat").between(lat - degrees - 1e-6, lat + degrees + 1e-6) & F.col("lng").isNotNull())
    return near.withColumn("distance", haversine(F.lit(lat), F.lit(lng), "lat", "lng", radius)).where(F.col("distance") <= miles)


def image_wishes() -> dict[str, Column]:
    """Conditions of the image screen by name, over rows of images.with_owners."""
    reason = F.coalesce(F.col("selected_reason"), F.lit(""))
    return {
        "stock_placeholder_candidate": F.col("is_stock"),
        "text_detected": F.col("has_text"),
        "watermark_detected": F.col("has_watermark"),
        "poster_or_flyer": F.col("is_poster"),
        "missing_dimensions": F.col("width").isNull() | F.col("height").isNull(),
        "low_resolution": F.array_contains("qa_flags", "low resolution image"),
        "needs_approval": F.col("clearance") == "needs_approval",
        "selected": F.col("selected"),
        "selected_pending_approval": F.col("selected_pending"),
        "selected_and_cleared": F.col("selected_cleared"),
        "selected_but_needs_approval": F.col("selected_pending"),
        "hard_blocked": F.size("reasons") > 0,
        "missing_image": F.col("owner_without_image"),
        "source_evidence_only": F.col("evidence_only"),
        "can_be_final_image": F.col("can_be_final"),
        "selected_by_rescue": reason.contains("photo_rescue"),
        "missing_artist_image": F.col("event_without_artist_image"),
    }


def images(rows: DataFrame, wishes: dict[str, bool] | None = None, quality_flag: str | None = None, **equal) -> DataFrame:
    """Image candidates by any of 26 wishes.

    wishes maps names of image_wishes to whether the condition must hold; a null condition does not.
    equal names columns and the value each must have (event_id, venue_id, source_type, source_provider,
    status, clearance, role, rescue_source).
    """
    known = image_wishes() if wishes else {}
    conditions = [F.coalesce(known[name], F.lit(False)) == wanted for name, wanted in (wishes or {}).items()]
    if quality_flag:
        conditions.append(F.array_contains("qa_flags", quality_flag))
    return rows.where(every(conditions + [F.col(c) == value for c, value in equal.items() if value is not None]))


def soon(column: str, as_of: Column, hours: int = 24) -> Column:
    """A moment that is known and not later than so many hours from the clock."""
    return F.coalesce(F.col(column) <= as_of + F.expr(f"interval {hours} hours"), F.lit(False))


def unknown_upstream(source: str = "upstream_event_source", provenance: str = "provenance_flags") -> Column:
    return F.coalesce(F.col(source), F.lit("unknown")).isin("unknown") | F.array_contains(provenance, "unknown upstream source")


def needs_backfill(repair: str = "ticket_link_repair_strategy", provenance: str = "provenance_flags") -> Column:
    return F.array_contains(provenance, "api backfill required") | F.coalesce(F.col(repair) == "api_backfill_required", F.lit(False))


def api_records(
    records: DataFrame,
    as_of: Column,
    quality_issue: str | None = None,
    provenance_flag: str | None = None,
    missing_image: bool = False,
    missing_ticket_link: bool = False,
    missing_venue: bool = False,
    expiring_soon: bool = False,
    unknown_upstream_source: bool = False,
    api_backfill_required: bool = False,
    least_relevance: float | None = None,
    least_photo_quality: float | None = None,
    **equal,
) -> DataFrame:
    """Vendor records by any of nineteen wishes.

    equal names columns and the value each must have (run, provider_key, ingestion_provider,
    upstream_event_source, ticketing_provider, ticket_link_classification,
    ticket_link_repair_strategy, review_status, normalization_status, duplicate_status). quality_flags
    and provenance_flags are arrays; a null score counts as 0.
    """
    conditions = [F.col(c) == value for c, value in equal.items() if value is not None]
    for flag, wanted in ((quality_issue, quality_issue), ("missing image", missing_image), ("missing ticket link", missing_ticket_link)):
        if wanted:
            conditions.append(F.array_contains("quality_flags", flag))
    if provenance_flag:
        conditions.append(F.array_contains("provenance_flags", provenance_flag))
    if missing_venue:
        conditions.append(F.exists("quality_flags", lambda f: f.startswith("missing venue")))
    if expiring_soon:
        conditions.append(soon("compliance_expires_at", as_of))
    if unknown_upstream_source:
        conditions.append(unknown_upstream())
    if api_backfill_required:
        conditions.append(needs_backfill())
    for column, least in (("event_relevance_score", least_relevance), ("photo_quality_score", least_photo_quality)):
        if least is not None:
            conditions.append(F.coalesce(F.col(column), F.lit(0)) >= least)
    return records.where(every(conditions))


def crawl_gate(status: Column, review: Column) -> Column:
    """Why a source is not crawled, null where it is."""
    return (
        F.when((status == "blocked") | (review == "blocked"), "blocked")
        .when(review == "quarantined", "quarantined")
        .when(F.coalesce(status != "approved", F.lit(True)), F.concat(F.lit("status="), F.coalesce(status, F.lit(""))))
        .when(F.coalesce(review != "approved", F.lit(True)), F.concat(F.lit("review_status="), F.coalesce(review, F.lit(""))))
    )


def suspicious(rows: DataFrame, level: str = "risk_level", status: str = "status") -> DataFrame:
    """High or blocked risk, or a status that keeps it out."""
    return rows.where(F.col(level).isin("high", "blocked") | F.col(status).isin("quarantined", "blocked", "rejected"))


def like(rows: DataFrame, **wanted: str) -> DataFrame:
    """Case-blind substring filters by column; blank wishes filter nothing."""
    return rows.where(every([F.lower(c).contains(v.strip().lower()) for c, v in wanted.items() if v and v.strip()]))


def page(rows: DataFrame, order: list[Column], number: int, size: int, most: int = 500) -> DataFrame:
    """One page of a total order; size is kept within 1 and most, number at 1 or more."""
    size = max(1, min(size, most))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


__all__ = ["clean", "contains_text", "api_records", "crawl_gate", "event_feed", "every", "hide_blocked", "image_wishes", "images", "like", "page", "poi_buckets", "poi_feed", "review_board", "suspicious", "within"]


# Names of the rate limits in the order in which they are told, and counts from which attempts are too many whatever the limits.
RATE_FLAGS = (("email_day", "rate_limit_email_day_exceeded"), ("ip_hour", "rate_limit_ip_hour_exceeded"), ("domain_day", "rate_limit_domain_day_exceeded"), ("route_hour", "rate_limit_route_hour_exceeded"), ("agent_hour", "rate_limit_user_agent_hour_exceeded"), ("global_hour", "rate_limit_global_hour_exceeded"))
TOO_MANY = (("email_day", 5), ("ip_hour", 8), ("domain_day", 10))


def rate_flags(limits: dict[str, int]) -> Column:
    """Flags of an attempt from its look-backs (the columns of RATE_FLAGS, other_domains and invalid_hour); a count without a limit raises no flag of its own."""
    exceeded = [(F.col(c) >= limits[c], name) for c, name in RATE_FLAGS if c in limits]
    many = reduce(lambda a, b: a | b, [F.col(c) >= n for c, n in TOO_MANY])
    return flags(*exceeded, (many, "too_many_recent_submissions"), (F.col("other_domains") >= 3, "same_email_many_unrelated_domains"), (F.col("invalid_hour") >= 3, "repeated_failed_or_invalid_submissions"))
