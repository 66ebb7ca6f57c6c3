"""Genre names and music relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, clean, flags

# Spellings and the genre they mean, in the order in which they are tried.
ALIASES = (
    ("alt country", "Americana"), ("alternative", "Indie"), ("alternative rock", "Rock"), ("americana", "Americana"), ("bluegrass", "Bluegrass"),
    ("blues", "Blues"), ("classical", "Classical"), ("country", "Country"), ("dance", "Electronic/Dance"), ("dj", "Electronic/Dance"),
    ("edm", "Electronic/Dance"), ("electronic", "Electronic/Dance"), ("folk", "Folk"), ("funk", "R&B/Soul"), ("hip hop", "Hip-Hop/Rap"),
    ("hip-hop", "Hip-Hop/Rap"), ("hip-hop/rap", "Hip-Hop/Rap"), ("indie", "Indie"), ("indie rock", "Indie"), ("jam", "Jam Band"),
    ("jam band", "Jam Band"), ("jamband", "Jam Band"), ("jazz", "Jazz"), ("latin", "Latin"), ("metal", "Metal"), ("music", "Other / Unknown"),
    ("pop", "Pop"), ("punk", "Punk"), ("rap", "Hip-Hop/Rap"), ("r&b", "R&B/Soul"), ("r&b/soul", "R&B/Soul"), ("reggae", "Reggae"),
    ("rock", "Rock"), ("soul", "R&B/Soul"), ("tribute", "Tribute"), ("world", "World"),
)
UNKNOWN = "Other / Unknown"


def genre(text) -> Column:
    """An alias that is the whole text, else the first alias within it, else unknown."""
    return bind(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[_\-\s]+", " ")), _genre)


def _genre(low: Column) -> Column:
    out = F.lit(UNKNOWN)
    for alias, name in reversed(ALIASES):
        out = F.when(low.contains(alias), name).otherwise(out)
    for alias, name in reversed(ALIASES):
        out = F.when(low == alias, name).otherwise(out)
    return F.when(low == "", F.lit(UNKNOWN)).otherwise(out)


def genre_confidence(name: Column) -> Column:
    return F.when(name == UNKNOWN, 0.3).otherwise(0.9)


def genres(texts: Column) -> tuple[Column, Column]:
    """(primary genre, distinct genres) of an array of texts, order kept; unknown ones only if there is nothing else."""
    found = F.array_distinct(F.transform(texts, genre))
    known = F.filter(found, lambda g: g != UNKNOWN)
    out = F.when(F.size(known) > 0, known).otherwise(F.array(F.lit(UNKNOWN)))
    return F.element_at(out, 1), out


def relevance(rows: DataFrame) -> DataFrame:
    """Adds relevance (0 to 100) and relevance_flags: 50 plus what speaks for music, less what speaks against.

    Columns: segment, category_text, provider, headliner, has_artist, venue_category, has_venue,
    has_ticket. Nulls speak for nothing.
    """
    segment, category = F.lower(F.trim(F.coalesce("segment", F.lit("")))), F.lower(F.coalesce("category_text", F.lit("")))
    lead = clean("headliner").isNotNull()
    points = (
        (segment == "music", 24, "provider_music_segment"),
        (segment.isin("sports", "arts & theatre", "film", "miscellaneous"), -35, "non_music_segment"),
        (F.col("provider") == "performer_feed", 15, "performer_feed"),
        ((F.col("provider") == "licensed_feed") & category.rlike("music|concert"), 12, "licensed_music_category"),
        (lead, 10, "headliner_present"),
        (F.col("has_artist"), 8, "linked_artist"),
        (F.col("venue_category") == "Music Site", 8, "music_site_venue"),
        (F.col("has_ticket"), 4, "ticket_link_present"),
        (category.rlike("sports|comedy|family"), -20, "non_music_category_signal"),
        (~lead, -8, "missing_artist"),
        (~F.coalesce("has_venue", F.lit(False)), -5, "missing_venue"),
    )
    score = sum((F.when(c, float(p)).otherwise(0.0) for c, p, _ in points), F.lit(50.0))
    return rows.withColumns({"relevance": F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), "relevance_flags": flags(*[(c, n) for c, _, n in points])})
