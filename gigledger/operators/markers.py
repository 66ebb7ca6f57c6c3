"""Map markers and review rows of several entities in common shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Colour and icon of a marker's category.
STYLES = (("Music Site", "purple", "note"), ("Cultural", "blue", "column"), ("Food & Bev", "orange", "fork"), ("Lodging", "green", "bed"), ("Shopping", "teal", "bag"), ("event", "red", "star"), ("venue", "navy", "stage"))


def _style(category: Column, at: int) -> Column:
    out = F.lit("grey" if at == 1 else "pin")
    for row in STYLES:
        out = F.when(category == row[0], row[at]).otherwise(out)
    return out


def markers(rows: DataFrame, kind: str, id_col: str, label: str, category: Column, start: Column | None = None, as_of: Column | None = None) -> DataFrame:
    """Rows with coordinates as markers; upcoming means a start at most twelve hours before the clock."""
    upcoming = F.lit(None).cast("boolean") if start is None else F.coalesce(start >= as_of - F.expr("interval 12 hours"), F.lit(False))
    return rows.where("lat is not null and lng is not null").select(
        F.lit(kind).alias("kind"), F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), "lat", "lng", _style(category, 1).alias("color"), _style(category, 2).alias("icon"), upcoming.alias("upcoming")
    )


def union(parts: list[DataFrame]) -> DataFrame:
    """Union by name; columns a part lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
