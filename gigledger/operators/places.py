"""Quality of place candidates, preview flags and images found in vendor payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, sorted_flags

# Points a flag of a place candidate costs; others cost 4.
PENALTIES = (
    ("missing_name", 35), ("missing_category", 15), ("missing_subcategory", 5), ("concert_category_not_allowed_for_poi", 60), ("missing_geo", 12), ("invalid_geo", 35),
    ("missing_city_state", 10), ("missing_address_or_geo", 18), ("missing_website_or_source_url", 8), ("missing_image", 8), ("logo_image", 40), ("social_image_url", 25),
    ("non_direct_image_url", 15), ("poster_flyer_or_admat_image", 12), ("low_resolution_thumbnail", 8), ("weak_music_signal", 12), ("weak_match_requires_review", 6), ("possible_duplicate", 8),
)
_SOCIAL = r"(?i)//([^/]*\.)?(facebook|instagram|twitter|tiktok|x|youtube)\.com"
_IMAGE = r"(?i)^https?://[^?#]+\.(jpe?g|png|webp|gif)([?#].*)?$"


def music_signal(name: str, category: str, subcategory: str, description: str, source_type: str) -> Column:
    """30, plus 20 for crawled and vendor places, 12 with a category, 10 with a sub-category, 25 with a word of music; at most 100."""
    text = F.lower(F.concat_ws(" ", name, category, subcategory, description))
    words = "music|concert|venue|festival|record|theatre|theater|studio|stage|club|performing arts"
    return F.least(
        F.lit(100.0),
        F.lit(30.0)
        + F.when(F.col(source_type).isin("crawl_extraction", "api_provider"), 20.0).otherwise(0.0)
        + F.when(~is_blank(category) & (F.lower(category) != "unknown"), 12.0).otherwise(0.0)
        + F.when(~is_blank(subcategory), 10.0).otherwise(0.0)
        + F.when(text.rlike(words), 25.0).otherwise(0.0),
    )


def candidate_quality(rows: DataFrame) -> DataFrame:
    """Adds candidate_flags (sorted) and candidate_score (0 to 100).

    Columns: name, category, subcategory, lat, lng, city, state, address, website, image_url, signal
    (music signal), match_confidence, possible_duplicate.
    """
    no_geo = F.col("lat").isNull() | F.col("lng").isNull()
    image = F.lower(F.trim(F.coalesce("image_url", F.lit(""))))
    logo, social, direct = image.contains("logo"), image.rlike(_SOCIAL), image.rlike(_IMAGE)
    has = image != ""
    found = sorted_flags(
        (is_blank("name"), "missing_name"),
        (is_blank("category"), "missing_category"),
        (is_blank("subcategory"), "missing_subcategory"),
        (F.col("category") == "Concert", "concert_category_not_allowed_for_poi"),
        (no_geo, "missing_geo"),
        ((F.abs("lat") > 90) | (F.abs("lng") > 180), "invalid_geo"),
        (is_blank("city") | is_blank("state"), "missing_city_state"),
        (is_blank("address") & no_geo, "missing_address_or_geo"),
        (is_blank("website"), "missing_website_or_source_url"),
        (~has, "missing_image"),
        (has & logo, "logo_image"),
        (has & ~logo & social, "social_image_url"),
        (has & ~logo & ~social & ~direct, "non_direct_image_url"),
        (image.rlike("poster|flyer|admat"), "poster_flyer_or_admat_image"),
        (image.contains("thumbnail"), "low_resolution_thumbnail"),
        (F.col("signal") < 55, "weak_music_signal"),
        (F.col("match_confidence") == "weak", "weak_match_requires_review"),
        (F.col("possible_duplicate"), "possible_duplicate"),
    )
    rows = rows.withColumn("candidate_flags", found)
    cost = sum((F.when(F.array_contains("candidate_flags", n), float(p)).otherwise(0.0) for n, p in PENALTIES), F.lit(0.0))
    bonus = F.when(has & ~logo & ~social & direct, 5.0).otherwise(0.0) + F.when(F.col("match_confidence") == "strong", 5.0).otherwise(0.0)
    return rows.withColumn("candidate_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - cost + bonus)))


def preview_flags(event: bool = True) -> Column:
    """Sorted flags of an event's preview: image state, ticket link, coordinates, vendor tracking."""
    link = F.lower(F.trim(F.coalesce("tickets_link", F.lit(""))))
    return sorted_flags(
        (F.col("image_status") == "needs_review", "needs image review"),
        ((F.col("image_status") == "selected_pending_approval") | (F.col("image_clearance") == "needs_approval"), "needs image approval"),
        (F.col("image_status") == "venue_fallback", "venue fallback image"),
        (link == "", "missing ticket link"),
        ((link != "") & ~link.rlike("^https?://[^/]+"), "malformed ticket link"),
        (link.rlike("^https?://") & link.rlike("cart|checkout|session"), "session/cart ticket URL"),
        (F.col("venue_lat").isNull() | F.col("venue_lng").isNull(), "missing venue coordinates"),
        (F.coalesce(F.col("source_url"), F.lit("")).rlike("(?i)[?&]utm_(source|medium|campaign)=") | link.rlike("[?&]utm_(source|medium|campaign)="), "suspicious/vendor tracking"),
    )


# Priority of a vendor's image by where it stands in the payload; evidence only ones can't be final.
PAYLOAD_IMAGES = (
    ("event_image", "$.image", 70, True),
    ("promo_image", "$.x-promoImage", 170, False),
    ("venue_image", "$.location.image", 90, True),
    ("link_logo", "$.links[0].logo", 230, False),
)


def payload_images(rows: DataFrame, key: str, payload: str, headliner: str) -> DataFrame:
    """(key, source, url, priority, can_be_final) of direct images in a vendor's JSON; performers count 30 as headliner and 42 otherwise."""
    fixed = [F.struct(F.lit(n).alias("source"), F.get_json_object(payload, p).alias("url"), F.lit(q).alias("priority"), F.lit(f).alias("can_be_final")) for n, p, q, f in PAYLOAD_IMAGES]
    performers = F.coalesce(F.from_json(F.get_json_object(payload, "$.performer"), "array<struct<name:string,image:string>>"), F.array())
    lead = F.lower(F.trim(F.coalesce(headliner, F.lit(""))))
    played = F.transform(performers, lambda p: F.struct(F.lit("performer_image").alias("source"), p["image"].alias("url"), F.when(F.lower(F.trim(p["name"])) == lead, 30).otherwise(42).alias("priority"), F.lit(True).alias("can_be_final")))
    return rows.select(key, F.explode(F.concat(F.array(*fixed), played)).alias("i")).select(key, "i.*").where(F.col("url").rlike(_IMAGE))


# Words that name a kind of place, in the order in which they are tried, with category, subcategory and confidence.
SUGGESTIONS = (
    (("festival", "fairgrounds"), "Music Site", "Festivals", 0.82),
    (("record store", "vinyl", "record shop"), "Shopping", "Record Stores", 0.82),
    (("music store", "guitar shop", "instrument"), "Shopping", "Music Stores", 0.78),
    (("museum",), "Cultural", "Museums", 0.76),
    (("performing arts",), "Cultural", "Performing Arts Centers", 0.78),
    (("theatre", "theater"), "Cultural", "Theatres", 0.74),
    (("hotel",), "Lodging", "Music Hotels", 0.7),
    (("camp", "campground"), "Lodging", "Music Camping", 0.68),
    (("chamber",), "Visitor & Travel", "Chamber", 0.7),
    (("tourism", "visitor", "travel"), "Visitor & Travel", "Travel & Tourism", 0.7),
    (("venue", "hall", "club", "stage", "amphitheater", "amphitheatre", "arena", "auditorium"), "Music Site", "Venues", 0.78),
)


def suggest_category(*texts) -> Column:
    """Struct (category, subcategory, confidence) by the first words found in the joined texts; a place without any is taken for a venue with less confidence, no text for unknown."""
    made = lambda c, s, n: F.struct(F.lit(c).alias("category"), F.lit(s).cast("string").alias("subcategory"), F.lit(n).alias("confidence"))
    out = made("Music Site", "Venues", 0.58)
    low = F.lower(F.concat_ws(" ", *texts))
    for words, category, subcategory, confidence in reversed(SUGGESTIONS):
        out = F.when(low.rlike("|".join(words)), made(category, subcategory, confidence)).otherwise(out)
    return F.when(F.trim(low) == "", made("unknown", None, 0.0)).otherwise(out)
