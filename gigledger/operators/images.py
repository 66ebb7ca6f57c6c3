"""Image reuse and selection; rows come scored by scores.image_score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import flags, is_blank, url_flags
from .rollups import beside, conditional_counts
from .tickets import assess

ARTIST_ROLES = ("artist_live", "artist_press")
# Clearances with which an image may be shown.
CLEARED = ("approved", "licensed", "partner_supplied", "provider_allowed")
# What a scored or detected property of an image is called where it blocks the image.
_TRAITS = (
    ("is_poster", "poster or flyer"), ("has_text", "text-heavy image"), ("has_watermark", "watermark suspected"), ("has_logo", "logo detected"), ("is_stock", "stock placeholder"),
    ("is_food", "unrelated food or drink image"), ("is_unrelated_place", "unrelated place image"),
)
_SCORES = (("generic_score", 70.0, "generic provider image"), ("text_score", 90.0, "text graphic"), ("poster_score", 70.0, "poster or flyer score"), ("admat_score", 70.0, "admat score"))


# Points of an image's role, of where it comes from, and clearances that settle or raise them.
ROLE_POINTS = (
    ("artist_live", 100), ("artist_press", 88), ("event_provider", 72), ("venue_live", 56), ("venue_exterior", 42), ("unknown", 24),
    ("generic_crowd", 10), ("poster", 0), ("flyer", 0), ("admat", 0), ("logo", 0), ("stock_placeholder", 0),
)
OTHER_ROLE = 20
PROVENANCE = (
    ("partner_supplied", 94), ("official_artist_site", 88), ("official_venue_site", 82), ("press_kit", 84), ("manual", 78), ("upload", 72),
    ("provider", 58), ("ticket_page", 74), ("spotify", 54), ("serpapi", 45), ("venue", 50), ("unknown", 25),
)
OTHER_SOURCE = 35
RAISED = ("approved", "licensed", "partner_supplied")
VENUE_ROLES = ("venue_live", "venue_exterior")
#: Names that sources give to roles, and the role that is meant.
ROLE_NAMES = (("headliner", "artist_live"), ("artist", "artist_live"), ("promo", "artist_press"), ("press", "artist_press"), ("event", "event_provider"), ("venue", "venue_live"), ("exterior", "venue_exterior"))
KNOWN_ROLES = tuple(n for n, _ in ROLE_POINTS) + ("social_screenshot",)


def normal_role(role) -> Column:
    """The role that a source's name means; 'unknown' for any other."""
    c = F.lower(F.trim(F.coalesce(role if isinstance(role, Column) else F.col(role), F.lit(""))))
    return F.coalesce(_looked_up(c, {r: r for r in KNOWN_ROLES} | dict(ROLE_NAMES)), F.lit("unknown"))


def _looked_up(value: Column, table: dict) -> Column:
    """What a table has for a value, or null; the value is computed once, which a chain of whens would do per entry."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def _points(value: Column, table, other: float) -> Column:
    return F.coalesce(_looked_up(value, {name: float(n) for name, n in table}), F.lit(float(other)))


def role_points(role: Column) -> Column:
    """Points of a normalised role."""
    return _points(role, ROLE_POINTS, OTHER_ROLE)


def candidate_scores(rows: DataFrame) -> DataFrame:
    """Adds role_score, technical_score, subject_score, provenance_score, approval_score, image_score (0 to 100, two decimals) and score_flags of image candidates.

    image_score is .28 role, .24 technical, .20 subject, .16 provenance and .12 approval, less what
    text (14), a watermark (22), a poster (45), a stock picture (50), a generic one (45) and one
    that can't be final (55) cost, plus 6 for a priority of 40 or less, less 18 from 160 on; 0 if the
    clearance is rejected. Columns: role, source_type, status, clearance, width, height, content_type,
    is_direct, is_social, is_accessible, shows_live, shows_artist, shows_venue, is_food,
    is_unrelated_place, is_generic_crowd, has_text, has_watermark, is_poster, is_stock,
    generic_score, can_be_final, priority. One that the rows lack, or that is null, tells nothing: a
    picture is then direct and can be final, without dimensions and with a priority of 100.
    """
    have = set(rows.columns)
    col = lambda c, default=None: F.coalesce(F.col(c), F.lit(default)) if c in have and default is not None else F.col(c) if c in have else F.lit(default)
    yes = lambda c: col(c, False) if c in have else F.lit(False)
    text = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in have else F.lit("")
    width, height = (F.col(c) if c in have else F.lit(None).cast("int") for c in ("width", "height"))
    ratio = width / height
    lost = width.isNull() | height.isNull()
    low = (width < 720) | (F.least(width, height) < 400)
    odd = F.when((ratio >= 2.2), "panoramic").when(ratio < 0.85, "portrait")
    rules = [
        (~col("is_direct", True), "not direct image asset", 40),
        (yes("is_social"), "social media image URL", 45),
        (~col("is_accessible", True), "broken or inaccessible image", 55),
        ((text("content_type") != "") & ~text("content_type").startswith("image/"), "content-type mismatch", 45),
        (lost, "missing dimensions", 12),
        (~lost & low, "low resolution image", 35),
        (~lost & ~low & (width < 1200), "below preferred 1200px width", 10),
        (~lost & (odd == "portrait"), "portrait image", 8),
        (~lost & (odd == "panoramic"), "panoramic image", 8),
    ]
    cost = lambda pairs: sum((F.when(c, float(n)).otherwise(0.0) for c, _, n in pairs), F.lit(0.0))
    technical = F.greatest(F.lit(0.0), 100 - cost(rules))
    against = [(yes("is_food"), "food or drink image", 24), (yes("is_unrelated_place"), "unrelated place image", 36), (yes("is_generic_crowd"), "generic crowd image", 22)]
    shown = cost([(yes("shows_live"), "", 30), (yes("shows_artist"), "", 26), (yes("shows_venue"), "", 18)])
    subject = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 40 + shown - cost(against)))
    clearance, status = text("clearance"), text("status")
    source = _points(text("source_type"), PROVENANCE, OTHER_SOURCE) + F.when(clearance.isin(*RAISED), 8.0).when(clearance == "provider_allowed", 4.0).otherwise(0.0)
    provenance = F.when(clearance == "rejected", 0.0).otherwise(F.least(source, F.lit(100.0)))
    approval = F.when((status == "rejected") | (clearance == "rejected"), 0.0).when(status == "accepted", 96.0).when(clearance.isin(*RAISED, "provider_allowed"), 86.0).when(clearance.isin("needs_approval", "unknown"), 74.0).otherwise(50.0)
    role = _points(text("role"), ROLE_POINTS, OTHER_ROLE)
    generic = (col("generic_score", 0.0) if "generic_score" in have else F.lit(0.0)) >= 70
    less = [(yes("has_text"), "text-heavy image candidate", 14), (yes("has_watermark"), "watermark suspected", 22), (yes("is_poster"), "poster/flyer detected", 45), (yes("is_stock"), "stock_placeholder_candidate", 50), (generic, "generic_provider_image", 45), (~col("can_be_final", True), "not_final_image_eligible", 55)]
    priority = col("priority", 100) if "priority" in have else F.lit(100)
    score = role * 0.28 + technical * 0.24 + subject * 0.2 + provenance * 0.16 + approval * 0.12 - cost(less) + F.when(priority <= 40, 6.0).when(priority >= 160, -18.0).otherwise(0.0)
    score = F.when(clearance == "rejected", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))
    named = flags(*[(c, n) for c, n, _ in rules + against + less], (clearance == "needs_approval", "needs image approval"))
    return rows.withColumns({
        "role_score": role, "technical_score": technical, "subject_score": subject, "provenance_score": provenance, "approval_score": approval, "image_score": F.round(score, 2), "score_flags": F.array_sort(named),
    })


def same_picture(url) -> Column:
    """What tells pictures apart: the address without query and fragment, lower case."""
    return F.lower(F.trim(F.regexp_replace(url if isinstance(url, Column) else F.col(url), r"[?#].*$", "")))


def reuse_reasons(candidates: DataFrame, events: DataFrame, least: int = 3) -> DataFrame:
    """(image_id, reused_events, reasons): candidates whose picture other events use, and why that makes it a stock picture.

    candidates: image_id, event_id, venue_id, url, role; events: event_id, headliner, title,
    venue_id. A picture of different headliners, or of `least` events or more, is stock, but for one
    of a venue's roles whose uses all belong to one venue. Counts are per picture, so one that
    everybody shows is counted in partial aggregates; rows without an address have no reasons.
    """
    uses = candidates.where("url is not null").select("image_id", "event_id", "venue_id", "role", same_picture("url").alias("picture"))
    who = F.lower(F.trim(F.coalesce(F.nullif("headliner", F.lit("")), F.col("title"))))
    shown = uses.join(events.select("event_id", F.col("venue_id").alias("event_venue"), who.alias("who")), "event_id", "left")
    counts = shown.groupBy("picture").agg(F.countDistinct("event_id").alias("reused_events"), F.countDistinct("who").alias("n_who"))
    venues = shown.select("picture", F.explode(F.array("venue_id", "event_venue")).alias("v")).where("v is not null").groupBy("picture").agg(F.countDistinct("v").alias("n_venues"))
    rows = uses.join(counts, "picture").join(venues, "picture", "left")
    allowed = F.col("role").isin(*VENUE_ROLES) & F.coalesce(F.col("n_venues") == 1, F.lit(False))
    reasons = flags(((F.col("n_who") > 1) & ~allowed, "reused across different headliners"), ((F.col("reused_events") >= least) & ~allowed, "reused across three or more events" if least == 3 else f"reused across {least} or more events"))
    return rows.select("image_id", "reused_events", reasons.alias("reasons"))


def gathered_candidates(parts: list[DataFrame]) -> DataFrame:
    """One scored candidate per owner and picture from several sources: (owner, picture, url, role, source_type, priority, n, image_score).

    Parts have owner, url, role, source_type, status, clearance, width, height, priority. Roles are
    normalised; of several sources the one with the lowest priority counts, ties to the source's name.
    """
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.where(~is_blank("url")).withColumns({"role": normal_role("role"), "picture": same_picture("url")})
    # a group's hash comes first, as rows are sorted by their groups, and texts that begin alike compare slowly
    rows = rows.withColumn("_h", F.xxhash64("owner", "picture"))
    order = F.struct("priority", "source_type", "url", "role", "status", "clearance", "width", "height")
    best = rows.groupBy("_h", "owner", "picture").agg(F.min(order).alias("b"), F.count(F.lit(1)).alias("n"))
    return candidate_scores(best.select("owner", "picture", "n", "b.*")).select("owner", "picture", "url", "role", "source_type", "priority", "n", "image_score")


def select_images(events: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per event: the chosen image and why.

    Accepted images come first, then artist and event pictures that nothing blocks, then pictures of
    the venue; within a tier the best score, then the smaller id. Events without any image are
    'missing', those with blocked ones alone 'needs_review'. The choice is one max per event, so no
    event's images are gathered.
    """
    open_ = ~F.col("blocked")
    tier = F.when(open_ & (F.col("status") == "accepted"), 0).when(open_ & F.col("role").isin("headliner", "event"), 1).when(open_ & F.col("role").isin("venue_live", "venue_exterior"), 2).otherwise(3)
    best = scored.groupBy("event_id").agg(F.min_by(F.struct("image_id", "clearance", tier.alias("tier")), F.struct(tier, -F.col("image_score"), "image_id")).alias("b"))
    out = events.join(best, "event_id", "left")
    selection = (
        F.when(F.col("b").isNull(), "missing")
        .when(F.col("b.tier") == 3, "needs_review")
        .when(F.col("b.tier") == 2, "venue_fallback")
        .when(F.col("b.clearance") == "approved", "accepted")
        .otherwise("selected_pending_approval")
    )
    return out.select("event_id", F.when(F.col("b.tier") < 3, F.col("b.image_id")).alias("image_id"), selection.alias("selection"))


def blocking_reasons(override: bool = False) -> Column:
    """Why an image candidate can't be shown; with an editor's override only what no one may pass over. A null trait or score does not block."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    hard = [
        (F.col("status") == "rejected", "candidate rejected"),
        (F.col("clearance") == "rejected", "clearance rejected"),
        (~F.col("is_accessible"), "image inaccessible"),
        (~yes("is_direct"), "not direct image asset"),
        (F.col("is_social"), "social media URL"),
    ]
    if override:
        return flags(*hard)
    shown = yes("shows_artist") | yes("shows_live") | yes("shows_venue")
    soft = [(F.col("evidence_only"), "source evidence only"), (~yes("can_be_final"), "not eligible as final image")]
    soft += [(F.col(c) >= least, name) for c, least, name in _SCORES]
    soft.append((F.col("role").isin("logo", "social_screenshot"), "logo or social screenshot"))
    soft += [(F.col(c), name) for c, name in _TRAITS]
    soft.append((F.col("is_generic_crowd") & ~shown, "generic crowd without music signal"))
    soft.append((F.col("width").isNotNull() & F.col("height").isNotNull() & ((F.col("width") < 720) | (F.least("width", "height") < 400)), "severe low resolution"))
    return flags(*hard, *soft)


def _artist() -> Column:
    return F.col("role").isin(*ARTIST_ROLES) | F.coalesce(F.col("rescue_source") == "provider_artist_image", F.lit(False))


def with_owners(candidates: DataFrame, events: DataFrame, venues: DataFrame) -> DataFrame:
    """Image candidates with their reasons, and how their event and venue use them.

    events (event_id) and venues (venue_id) each have selected_image_id, image_status,
    image_clearance, selected_url. Adds reasons, selected, selected_pending, selected_cleared,
    owner_without_image, event_without_artist_image, selected_by_event. Whether an event has an
    artist's image is one aggregate per event, joined back on the same key.
    """
    rows = candidates.withColumn("reasons", blocking_reasons())
    artists = rows.where("event_id is not null").groupBy("event_id").agg(F.bool_or(_artist()).alias("has_artist_image"))
    owned = lambda owners, key, p: owners.select(key, F.lit(True).alias(f"{p}_known"), *[F.col(c).alias(f"{p}_{c}") for c in ("selected_image_id", "image_status", "image_clearance", "selected_url")])
    rows = rows.join(artists, "event_id", "left").join(owned(events, "event_id", "event"), "event_id", "left").join(owned(venues, "venue_id", "venue"), "venue_id", "left")
    chosen = {p: F.coalesce(F.col(f"{p}_selected_image_id") == F.col("image_id"), F.lit(False)) for p in ("event", "venue")}

    def use(states: tuple[str, ...], clearances: tuple[str, ...]) -> Column:
        made = [chosen[p] & F.coalesce(F.col(f"{p}_image_status").isin(*states) & F.col(f"{p}_image_clearance").isin(*clearances), F.lit(False)) for p in chosen]
        return made[0] | made[1]

    added = {
        "selected": chosen["event"] | chosen["venue"],
        "selected_by_event": chosen["event"],
        "selected_pending": use(("selected_pending_approval", "venue_fallback"), ("needs_approval",)),
        "selected_cleared": use(("accepted", "venue_fallback"), CLEARED),
        "owner_without_image": F.when(F.col("event_known"), is_blank("event_selected_url")).when(F.col("venue_known"), is_blank("venue_selected_url")).otherwise(False),
        "event_without_artist_image": F.coalesce(F.col("event_known") & ~F.col("has_artist_image"), F.lit(False)),
    }
    return rows.withColumns(added).select(*candidates.columns, "reasons", *added)


def of_events(owned: DataFrame) -> DataFrame:
    """One row per event of what its candidates (of with_owners) show: a flag per kind of candidate, and the traits of the selected one."""
    said = lambda flag: F.array_contains("qa_flags", flag)
    any_ = {
        "hard_blocked": F.size("reasons") > 0,
        "stock": F.col("is_stock"),
        "text_heavy": F.col("has_text"),
        "watermarked": F.col("has_watermark"),
        "poster_flyer": F.col("is_poster"),
        "by_rescue": F.col("selected_by_event") & F.col("selected_reason").contains("photo_rescue"),
        "generic": (F.col("generic_score") >= 70) | said("generic_provider_image"),
        "admat": (F.col("poster_score") >= 70) | (F.col("admat_score") >= 70) | said("poster_flyer_admat"),
        "social_evidence": F.col("evidence_only") | (F.col("rescue_source") == "social_graphic_reference"),
        "artist": _artist(),
        "artist_accepted": (F.col("status") == "accepted") & (F.size(blocking_reasons(override=True)) == 0) & _artist(),
        "manual_accepted": F.col("selected_by_event") & (F.col("status") == "accepted") & F.col("source_type").isin("manual", "upload", "partner_supplied"),
        "selected_weak": F.col("selected_by_event") & (F.col("is_stock") | F.col("is_poster") | (F.col("generic_score") >= 70) | (F.col("rescue_source") == "social_graphic_reference") | F.col("evidence_only")),
    }
    return owned.groupBy("event_id").agg(
        *[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in any_.items()],
        F.bool_and(F.coalesce(F.col("evidence_only"), F.lit(False)) | (F.size("reasons") > 0)).alias("only_evidence"),
        F.max(F.when(F.col("selected_by_event"), F.array_join(F.slice("reasons", 1, 3), ","))).alias("selected_reasons"),
    )


def quality_counts(events: DataFrame, found: DataFrame, venues: DataFrame) -> DataFrame:
    """One row of counts of events by their image and by what their candidates show (found, of of_events), and of venues that wait for approval."""
    rows = events.join(found, "event_id", "left")
    state, cleared, has = F.col("image_status"), F.col("image_clearance"), ~is_blank("selected_url")
    waits = cleared == "needs_approval"
    fallback = state == "venue_fallback"
    conditions = {
        "events_with_selected_image": has,
        "events_with_selected_image_pending_approval": has & waits,
        "events_with_selected_cleared_image": has & cleared.isin(*CLEARED),
        "events_missing_usable_image": ~has,
        "events_using_venue_fallback": fallback,
        "events_using_provider_image_pending_approval": has & waits & (F.col("image_role") == "event_provider"),
        "events_with_hard_blocked_image_candidates": F.col("hard_blocked"),
        "events_with_provider_stock_candidate": F.col("stock"),
        "events_needing_image_approval": F.coalesce(waits, F.lit(False)) | F.coalesce(state == "selected_pending_approval", F.lit(False)),
        "events_with_text_heavy_image_candidates": F.col("text_heavy"),
        "events_with_watermark_candidates": F.col("watermarked"),
        "events_with_poster_flyer_candidates": F.col("poster_flyer"),
        "events_with_accepted_artist_images": state.isin("accepted", "selected_pending_approval") & F.col("image_role").isin(*ARTIST_ROLES),
        "events_with_accepted_venue_fallback_images": fallback,
        "events_selected_by_photo_rescue": F.col("by_rescue"),
        "events_with_generic_provider_image_blocked": F.col("generic"),
        "events_with_poster_flyer_admat_blocked": F.col("admat"),
        "events_with_social_graphic_evidence": F.col("social_evidence"),
        "events_with_artist_image_candidates": F.col("artist"),
    }
    waiting = conditional_counts(venues, [], {"venues_needing_image_approval": F.col("image_clearance") == "needs_approval"})
    return beside(conditional_counts(rows, [], conditions), waiting)


# States of an event that keep its ticket page from being fetched, classes of links that may be.
DEAD = ("rejected", "expired", "stale", "cancelled")
FETCHED = ("direct", "platform_event", "redirect_or_handoff")


def page_fallback(events: DataFrame, found: DataFrame) -> DataFrame:
    """(event_id, fetch, reason): whether an event's ticket page should be read for an image, and why.

    events has publish_status, event_status, tickets_link, selected_url, image_status; optional:
    lifecycle, recommended_ticket_link. found is of of_events; an event without candidates has none of its flags.
    """
    rows = events.join(found, "event_id", "left")
    has = lambda c: c in events.columns
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    states = [F.lower(F.coalesce(c, F.lit(""))).isin(*DEAD) for c in ("publish_status", "event_status", "lifecycle") if has(c)]
    dead = states[0]
    for state in states[1:]:
        dead = dead | state
    link = F.coalesce(F.nullif(F.trim("recommended_ticket_link"), F.lit("")), F.col("tickets_link")) if has("recommended_ticket_link") else F.col("tickets_link")
    rows = rows.withColumns({"link": link, "assessed": assess(link)})
    rungs = [
        (dead, False, F.lit("event_rejected_expired_or_stale")),
        (yes("manual_accepted"), False, F.lit("manual_accepted_image_exists")),
        (yes("artist_accepted"), False, F.lit("accepted_artist_image_exists")),
        (is_blank("link"), False, F.lit("missing_ticket_url")),
        (~F.col("assessed.usable") | ~F.col("assessed.category").isin(*FETCHED), False, F.concat(F.lit("ticket_link_not_usable:"), F.col("assessed.category"))),
        (F.size(url_flags(F.col("link"))) > 0, False, F.lit("ticket_url_safety_blocked")),
        (is_blank("selected_url"), True, F.lit("missing_selected_image")),
        (F.col("image_status").isin("missing", "needs_review"), True, F.concat(F.lit("selected_image_status:"), F.col("image_status"))),
        (F.coalesce(F.col("selected_reasons"), F.lit("")) != "", True, F.concat(F.lit("selected_image_blocked:"), F.col("selected_reasons"))),
        (yes("selected_weak"), True, F.lit("selected_provider_image_weak")),
        (yes("only_evidence"), True, F.lit("only_evidence_or_blocked_images")),
    ]
    fetch, reason = F.lit(False), F.lit("usable_image_exists")
    for condition, wanted, name in reversed(rungs):
        fetch, reason = F.when(condition, F.lit(wanted)).otherwise(fetch), F.when(condition, name).otherwise(reason)
    return rows.select("event_id", fetch.alias("fetch"), reason.alias("reason"))
