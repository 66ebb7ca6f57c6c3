"""Published records of the app feed: events, places and venues as nested columns.

A builder takes rows with the columns it names; one that the rows lack counts as null, so partial
sources can be published, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, people

# States of an image that wait for an approval.
NEEDS_APPROVAL = ("needs_approval", "pending_approval", "selected_pending_approval")
OPEN_REVIEW = ("needs_review",)  # states of this library's own sources that mean the same
LOGO_MARKS = ("logo",)


class _Of:
    """Columns of a table by name, null where it has none."""

    def __init__(self, rows: DataFrame):
        self.names = set(rows.columns)

    def __call__(self, name: str, kind: str | None = None) -> Column:
        c = F.col(name) if name in self.names else F.lit(None)
        return c.cast(kind) if kind else c

    def text(self, *names: str) -> Column:
        """The first of the columns that is not blank, else an empty text."""
        return F.coalesce(*[clean(self(n, "string")) for n in names], F.lit(""))

    def time(self, name: str) -> Column:
        return F.coalesce(F.date_format(self(name, "timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit(""))


def _logo(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike("|".join(LOGO_MARKS)), F.lit(False))


def _waits(of: _Of) -> Column:
    states = NEEDS_APPROVAL + OPEN_REVIEW
    return of.text("image_status").isin(*states) | of.text("image_clearance").isin(*states)


def event_record(rows: DataFrame) -> Column:
    """The published form of an event: what it is, its venue, image, tickets, links, source and quality.

    A logo is never published as an image. Columns: event_id, title, headliner, supporting_artists,
    genre, normalized_genre, normalized_genres (array), provider_genre, music_category, start_ts,
    end_ts, timezone, doors_time, lifecycle, event_status, location_text, the venue's (venue_id, venue_key, venue_name,
    venue_address, venue_city, venue_state, venue_zip, venue_country, venue_lat, venue_lng, venue_website), the
    image's (selected_image_url, image_url, image_role, image_source, image_status,
    image_clearance, image_score), recommended_ticket_link, tickets_link, ticket_provider, ticket_class, source_url,
    spotify_url, provider, source_type, claim_count, source_chain, readiness, dedupe_confidence, flags (array) and updated_at.
    """
    of = _Of(rows)
    image = of.text("selected_image_url", "image_url")
    names = F.coalesce(of("normalized_genres", "array<string>"), F.array().cast("array<string>"))
    flags = F.array_distinct(F.concat(F.coalesce(of("flags", "array<string>"), F.array().cast("array<string>")), F.when(_logo(image), F.array(F.lit("logo_asset_suppressed"))).otherwise(F.array().cast("array<string>"))))
    providers = F.array_distinct(F.filter(F.array(of.text("provider"), of.text("source_type")), lambda x: x != ""))
    return F.struct(
        F.concat(F.lit("event-"), of("event_id", "string")).alias("event_id"),
        F.lit("event").alias("record_type"),
        F.when(of.text("category") == "", "Concert").otherwise(of.text("category")).alias("category"),
        of.text("title").alias("title"),
        of.text("headliner").alias("headliner"),
        people(of("supporting_artists", "string")).alias("supporting_artists"),
        F.coalesce(F.get(names, 0), of.text("genre", "normalized_genre")).alias("genre"),
        names.alias("normalized_genres"),
        of.text("provider_genre").alias("provider_genre"),
        of.text("music_category").alias("music_category"),
        of.time("start_ts").alias("start_datetime"),
        of.time("end_ts").alias("end_datetime"),
        of.text("timezone").alias("timezone"),
        of.text("doors_time").alias("doors_time"),
        F.when(of.text("lifecycle", "event_status") == "", "active").otherwise(of.text("lifecycle", "event_status")).alias("lifecycle_status"),
        F.struct(
            of.text("venue_id").alias("venue_id"), of.text("venue_key").alias("poi_id"), of.text("venue_name", "location_text").alias("name"), of.text("venue_address").alias("address"), of.text("venue_city").alias("city"),
            of.text("venue_state").alias("state"), of.text("venue_zip").alias("zip_code"), of.text("venue_country").alias("country"), of("venue_lat", "double").alias("latitude"), of("venue_lng", "double").alias("longitude"),
        ).alias("venue"),
        F.struct(
            F.when(_logo(image), "").otherwise(image).alias("url"), of.text("image_role").alias("role"), of.text("image_source").alias("source_type"), of.text("image_status").alias("status"),
            of.text("image_clearance").alias("clearance_status"), _waits(of).alias("needs_approval"), of("image_score", "double").alias("quality_score"), flags.alias("flags"),
        ).alias("image"),
        F.struct(of.text("recommended_ticket_link", "tickets_link").alias("url"), of.text("ticket_provider").alias("provider"), of.text("ticket_class").alias("classification")).alias("tickets"),
        F.struct(of.text("source_url").alias("event_url"), of.text("spotify_url").alias("spotify_url"), of.text("venue_website").alias("website")).alias("links"),
        F.struct(of.text("provider", "source_type").alias("primary_provider"), providers.alias("ingestion_providers"), F.coalesce(of("claim_count", "long"), F.lit(0)).alias("source_claim_count"), of.text("source_chain").alias("source_chain_summary")).alias("source"),
        F.struct(of("readiness", "long").alias("publish_ready_score"), of.text("dedupe_confidence").alias("dedupe_confidence"), flags.alias("flags")).alias("quality"),
        of.time("updated_at").alias("updated_at"),
    )


def poi_record(rows: DataFrame) -> Column:
    """The published form of a place. Columns: poi_id, canonical_poi_id, name, category, subcategory, description, address, city, state, zip, country, lat, lng, website, instagram, facebook, x_url, tiktok, spotify_url, image_url, image_score, certified, carousel, business_status, hours, upcoming, next_start, readiness, flags (array), updated_at."""
    of = _Of(rows)
    image = of.text("image_url")
    shown = F.when(_logo(image), "").otherwise(image)
    flags = F.array_distinct(F.concat(F.coalesce(of("flags", "array<string>"), F.array().cast("array<string>")), F.when(_logo(image), F.array(F.lit("logo_asset_suppressed"))).otherwise(F.array().cast("array<string>"))))
    return F.struct(
        F.coalesce(clean(of("canonical_poi_id", "string")), F.concat(F.lit("poi-"), of("poi_id", "string"))).alias("poi_id"),
        F.lit("poi").alias("record_type"),
        *[of.text(c).alias(n) for c, n in (("name", "name"), ("category", "category"), ("subcategory", "subcategory"), ("description", "description"), ("address", "address"), ("city", "city"), ("state", "state"), ("zip", "zip_code"), ("country", "country"))],
        of("lat", "double").alias("latitude"),
        of("lng", "double").alias("longitude"),
        F.struct(*[of.text(c).alias(n) for c, n in (("website", "website"), ("instagram", "instagram"), ("facebook", "facebook"), ("x_url", "x"), ("tiktok", "tiktok"), ("youtube", "youtube"), ("spotify_url", "spotify"))]).alias("links"),
        F.struct(shown.alias("url"), F.when(shown == "", "missing").otherwise("available").alias("status"), F.lit("unknown").alias("clearance_status"), F.lit(False).alias("needs_approval"), of("image_score", "double").alias("quality_score"), flags.alias("flags")).alias("image"),
        F.struct(F.coalesce(of("certified", "boolean"), F.lit(False)).alias("certified"), of.text("carousel").alias("carousel_selection"), of.text("business_status").alias("business_status"), of.text("hours").alias("hours_of_operation")).alias("place"),
        F.struct(F.coalesce(of("upcoming", "long"), F.lit(0)).alias("upcoming_event_count"), of.time("next_start").alias("next_event_datetime")).alias("events"),
        F.struct(of("readiness", "long").alias("publish_ready_score"), flags.alias("flags")).alias("quality"),
        of.time("updated_at").alias("updated_at"),
    )


def venue_record(rows: DataFrame) -> Column:
    """The published form of a venue with its upcoming events counted. Columns: venue_id, venue_key, name, category, subcategory, address, city, state, zip, country, lat, lng, website, selected_image_url, image_url, image_status, image_clearance, image_score, upcoming, next_start, flags (array), updated_at."""
    of = _Of(rows)
    image = of.text("selected_image_url", "image_url")
    shown = F.when(_logo(image), "").otherwise(image)
    flags = F.array_distinct(F.concat(F.coalesce(of("flags", "array<string>"), F.array().cast("array<string>")), F.when(_logo(image), F.array(F.lit("logo_asset_suppressed"))).otherwise(F.array().cast("array<string>"))))
    status = F.when(of.text("image_status") != "", of.text("image_status")).when(shown != "", "available").otherwise("missing")
    return F.struct(
        of.text("venue_id").alias("venue_id"),
        F.lit("venue").alias("record_type"),
        of.text("venue_key").alias("poi_id"),
        *[of.text(c).alias(n) for c, n in (("name", "name"), ("category", "category"), ("subcategory", "subcategory"), ("address", "address"), ("city", "city"), ("state", "state"), ("zip", "zip_code"), ("country", "country"))],
        of("lat", "double").alias("latitude"),
        of("lng", "double").alias("longitude"),
        of.text("website").alias("website"),
        F.struct(shown.alias("url"), status.alias("status"), of.text("image_clearance").alias("clearance_status"), _waits(of).alias("needs_approval"), of("image_score", "double").alias("quality_score"), flags.alias("flags")).alias("image"),
        F.struct(F.coalesce(of("upcoming", "long"), F.lit(0)).alias("upcoming_event_count"), of.time("next_start").alias("next_event_datetime")).alias("events"),
        of.time("updated_at").alias("updated_at"),
    )
