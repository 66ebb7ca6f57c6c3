"""The review board: several kinds of records as rows of one schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXTS = (
    "record_type", "record_label", "title", "venue_name", "address", "city", "state", "description", "genre", "source_label", "provider", "source_type",
    "review_status", "image_status", "ticket_status", "duplicate_status", "app_feed_readiness",
)
LISTS = ("source_badges", "venue_badges", "quality_flags")
VALUES = {"id": "long", "start_ts": "timestamp", "lat": "double", "lng": "double"}
MARKS = ("needs_review", "app_feed_ready")


def review_rows(*kinds: DataFrame) -> DataFrame:
    """All kinds one below the other, with row_key ("kind:id").

    A kind gives what columns it has: texts it lacks, and null ones, are blank, lists empty, marks
    false, and its start and coordinates stay null.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds)
    has = lambda c: c in rows.columns
    made = [F.coalesce(F.trim(c), F.lit("")).alias(c) if has(c) else F.lit("").alias(c) for c in TEXTS]
    made += [F.coalesce(c, F.array().cast("array<string>")).alias(c) if has(c) else F.array().cast("array<string>").alias(c) for c in LISTS]
    made += [F.col(c) if has(c) else F.lit(None).cast(kind).alias(c) for c, kind in VALUES.items()]
    made += [F.coalesce(c, F.lit(False)).alias(c) if has(c) else F.lit(False).alias(c) for c in MARKS]
    return rows.select(F.concat_ws(":", "record_type", F.col("id").cast("string")).alias("row_key"), *made)
