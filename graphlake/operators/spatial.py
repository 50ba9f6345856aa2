"""Boxes and points as columns lo1, hi1, lo2, hi2, ... (a point has lo = hi)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = list[tuple[float, float]]
EARTH_KM = 6371.0


def _dims(box: Box) -> list[tuple[Column, Column, float, float]]:
    return [(F.col(f"lo{i}"), F.col(f"hi{i}"), lo, hi) for i, (lo, hi) in enumerate(box, 1)]


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def intersects(box: Box) -> Column:
    return _all([(lo <= b) & (hi >= a) for lo, hi, a, b in _dims(box)])


def contains(box: Box) -> Column:
    """The row's box holds the given one."""
    return _all([(lo <= a) & (hi >= b) for lo, hi, a, b in _dims(box)])


def within(box: Box) -> Column:
    return _all([(lo >= a) & (hi <= b) for lo, hi, a, b in _dims(box)])


def touches(box: Box) -> Column:
    """The boxes meet, and in some dimension only at an edge."""
    edge = reduce(lambda a, b: a | b, [(lo == b) | (hi == a) for lo, hi, a, b in _dims(box)])
    return intersects(box) & edge


def equals(box: Box) -> Column:
    return _all([(lo == a) & (hi == b) for lo, hi, a, b in _dims(box)])


def distance(box: Box) -> Column:
    """Least Euclidean distance between the boxes."""
    gaps = [F.greatest(lo - F.lit(float(b)), F.lit(float(a)) - hi, F.lit(0.0)) for lo, hi, a, b in _dims(box)]
    return F.sqrt(reduce(lambda x, y: x + y, [g * g for g in gaps]))


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Distance on a sphere between points in degrees, stable for near and far points."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east, north = F.cos(b) * F.sin(d), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return radius * F.atan2(F.sqrt(east * east + north * north), F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d))


def expanded(box: Box, by: float, metric: str = "euclid", radius: float = EARTH_KM) -> Box:
    """The box grown by a distance: alike in each dimension, or on the sphere in
    degrees (latitude first; longitude by the cosine of the latitude, 360 at most)."""
    if metric == "euclid":
        return [(lo - by, hi + by) for lo, hi in box]
    degrees = math.degrees(by / radius)
    (lat_lo, lat_hi), (lon_lo, lon_hi) = box
    slim = min(math.cos(math.radians(lat_lo)), math.cos(math.radians(lat_hi)))
    lon = min(degrees / slim, 360.0) if slim > 1e-12 else 360.0
    return [(lat_lo - degrees, lat_hi + degrees), (lon_lo - lon, lon_hi + lon)]


def in_region(rows: DataFrame, box: Box) -> DataFrame:
    return rows.where(intersects(box))


def in_distance(rows: DataFrame, box: Box, by: float, metric: str = "euclid") -> DataFrame:
    """Rows that meet the expanded box: a filter by box, not by true radius."""
    return rows.where(intersects(expanded(box, by, metric)))


def nearest(rows: DataFrame, box: Box, k: int, exclude: int | None = None) -> DataFrame:
    found = rows if exclude is None else rows.where(F.col("id") != exclude)
    return found.select("id", distance(box).alias("distance")).orderBy("distance", "id").limit(k)
