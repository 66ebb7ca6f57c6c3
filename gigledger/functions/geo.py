"""Distances and grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radii of the earth.
METRES, MILES = 6_371_000.0, 3958.8


def haversine(lat1, lng1, lat2, lng2, radius: float = METRES) -> Column:
    """Great-circle distance in the unit of the radius; null where a coordinate is."""
    lat1, lng1, lat2, lng2 = (F.col(c) if isinstance(c, str) else c for c in (lat1, lng1, lat2, lng2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * radius) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def cell_size(distance: float, radius: float) -> float:
    """Degrees of latitude of a band of cells such that points within the distance lie in the same or the next band."""
    return math.degrees(distance / radius) * (1 + 1e-9)


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _around(band: Column, size: float) -> Column:
    """How many cells lie around the earth in a band: each at least as wide as the distance is at the band's (or the next one's) farther edge; one where it spans the pole."""
    edge = F.greatest(F.abs(band), F.abs(band + 1)) * size + size
    reach = F.lit(math.sin(math.radians(size) / 2)) / F.cos(F.radians(edge))
    return F.when((edge >= 90) | (reach >= 1), F.lit(1)).otherwise(F.floor(F.lit(180.0) / F.degrees(F.asin(F.least(reach, F.lit(1.0)))) * (1 - 1e-9))).cast("long")


def _number(lng: Column, cells: Column) -> Column:
    return F.least(F.floor(F.pmod(lng + 180.0, F.lit(360.0)) / 360.0 * cells), cells - 1)


def cell(lat, lng, size: float) -> Column:
    """The cell of a point: (cy, cx) of its band and its place around the earth."""
    band = F.floor(_column(lat) / size)
    return F.struct(band.alias("cy"), _number(_column(lng), F.greatest(_around(band, size), F.lit(1))).alias("cx"))


def neighbours(lat, lng, size: float) -> Column:
    """The cells around a point as an array of structs (cy, cx): three bands, in each the point's place and the next ones, across the date line and the poles too."""
    here = F.floor(_column(lat) / size)
    found = []
    for dy in (-1, 0, 1):
        cells = F.greatest(_around(here + dy, size), F.lit(1))
        at = _number(_column(lng), cells)
        found += [F.struct((here + dy).alias("cy"), F.pmod(at + dx, cells).alias("cx")) for dx in (-1, 0, 1)]
    return F.array_distinct(F.array(*found))
