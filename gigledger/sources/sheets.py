"""Sheets and exports: all-string scans with a header check, row numbers and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean, is_blank, sorted_flags, truth

# Columns a sheet must have.
EVENT_SHEET = ("Category", "Event Name", "Headliner", "Start Date", "Timezone", "Venue Name", "City", "State")
SOURCE_SHEET = ("Organization Name", "Calendar URL", "Contact Email", "Authorization Confirmed")
RESEARCH_SHEET = ("Calendar URL", "Source Name", "Organization Name", "Source Type", "City", "State", "Country", "Contact Email", "Authorization Status", "Notes")


def missing_columns(columns: list[str], required: tuple[str, ...]) -> list[str]:
    have = {c.strip().lower() for c in columns}
    return [c for c in required if c.lower() not in have]


def read_sheet(spark: SparkSession, path: str, required: tuple[str, ...], sep: str = ",") -> DataFrame:
    """Trimmed text columns of one or more CSV files; raises if a required column is missing.

    Adds row_number, from 2 for a file's first data row, and source_file. One file is one task's
    input, as cells may hold line ends.
    """
    raw = spark.read.csv(path, header=True, sep=sep, multiLine=True, quote='"', escape='"', inferSchema=False)
    missing = missing_columns(raw.columns, required)
    if missing:
        raise ValueError(f"Missing columns: {', '.join(missing)}")
    from pyspark.sql import Window

    trimmed = raw.select(*[clean(F.col(f"`{c}`")).alias(c.strip()) for c in raw.columns], F.input_file_name().alias("source_file"), F.monotonically_increasing_id().alias("_at"))
    return trimmed.withColumn("row_number", F.row_number().over(Window.partitionBy("source_file").orderBy("_at")) + 1).drop("_at")


def parse_lines(lines: DataFrame, column: str, names: list[str], sep: str = ",") -> DataFrame:
    """Rows of a column that holds one CSV record each."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    parsed = F.from_csv(column, schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"sep": sep, "escape": '"'})
    return lines.withColumn("_r", parsed).select(*[c for c in lines.columns if c != column], *[clean(F.col(f"_r.{n}")).alias(n) for n in names])


def localised(rows: DataFrame, name: str) -> Column:
    """A column with a language suffix: the English text, else the Spanish, else the bare column."""
    found = [F.col(f"`{c}`") for c in (f"{name} (en)", f"{name} (es)", name) if c in rows.columns]
    return F.coalesce(*[clean(c) for c in found], F.lit(None).cast("string"))


#: Sheet column by the name that rules use.
EVENT_FIELDS = {
    "category": "Category", "event_name": "Event Name", "headliner": "Headliner", "start_date": "Start Date", "timezone": "Timezone", "venue_name": "Venue Name",
    "city": "City", "state": "State", "event_url": "Event URL", "tickets_link": "Tickets Link", "address": "Venue Address", "lat": "Latitude", "lng": "Longitude",
    "main_image": "Main Image URL", "images": "Additional Image URL(s)",
}
_SOCIAL = r"(?i)//([^/]*\.)?(facebook|instagram|twitter|tiktok|x|youtube)\.com"
_IMAGE = r"(?i)^https?://[^?#]+\.(jpe?g|png|webp|gif)([?#].*)?$"


def event_sheet_errors(**columns: str) -> Column:
    """Sorted rule names that an event row breaks; a blank category is Concert. Arguments map names of EVENT_FIELDS to columns."""
    c = lambda name: F.col(columns.get(name, name))
    gone = lambda name: is_blank(c(name))
    extra = F.filter(F.transform(F.split(F.coalesce(c("images"), F.lit("")), r"\$"), lambda x: F.trim(x)), lambda x: x != "")
    bare_url = lambda name: ~gone(name) & ~F.trim(c(name)).rlike("(?i)^https?://[^/]+")
    required = ("event_name", "headliner", "start_date", "timezone", "venue_name", "city", "state")
    return sorted_flags(
        (F.coalesce(clean(c("category")), F.lit("Concert")) != "Concert", "non_concert_category"),
        *[(gone(name), f"{name}_missing") for name in required],
        (gone("event_url") & gone("tickets_link"), "event_or_ticket_url_missing"),
        (gone("address") & (gone("lat") | gone("lng")), "venue_address_or_coordinates_missing"),
        *[(bare_url(name), f"{name}_not_full_url") for name in ("event_url", "tickets_link")],
        (c("main_image").rlike(_SOCIAL), "main_image_social_media_url"),
        (~gone("main_image") & ~c("main_image").rlike(_SOCIAL) & ~F.trim(c("main_image")).rlike(_IMAGE), "main_image_not_direct_public_image"),
        (F.exists(extra, lambda x: x.rlike(_SOCIAL)), "additional_image_social_media_url"),
        (F.exists(extra, lambda x: ~x.rlike(_SOCIAL) & ~x.rlike(_IMAGE)), "additional_image_not_direct_public_image"),
    )


def source_sheet_errors(organization: str = "organization", url: str = "url", email: str = "email", confirmed: str = "confirmed", category: str | None = None) -> Column:
    """Sorted rule names that a calendar-source row breaks."""
    expected = F.lit(None).cast("string") if category is None else F.col(category)
    return sorted_flags(
        (is_blank(organization), "organization_name_missing"),
        (is_blank(url), "calendar_url_missing"),
        (is_blank(email), "contact_email_missing"),
        (~F.coalesce(truth(F.col(confirmed)), F.lit(False)), "authorization_missing"),
        (F.coalesce(clean(expected), F.lit("Concert")) != "Concert", "expected_category_not_concert"),
    )


def upload_status(rows: DataFrame, key: str, id_col: str, known: DataFrame) -> DataFrame:
    """new, duplicate_within_file (an earlier row has the key) or duplicate_existing; rows without a key are new."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_col).alias("first_id"))
    out = rows.join(first, key, "left").join(known.select(key).distinct().withColumn("known", F.lit(True)), key, "left")
    return out.select(id_col, F.when(F.col(id_col) != F.col("first_id"), "duplicate_within_file").when(F.col("known"), "duplicate_existing").otherwise("new").alias("status"))
