"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factors and radii.
KNOTS_PER_MS = 1.94384
EARTH_NM = 3440.065
EARTH_KM = 6371.0088
MERCATOR_RADIUS_M = 6378137.0
MAD_SCALE = 1.4826


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970 of a timestamp with or without zone (the session's zone is UTC)."""
    return F.unix_micros(col(ts).cast("timestamp")) / F.lit(1_000_000.0)


def clip(x: Column | str, low: float, high: float) -> Column:
    """``x`` kept within bounds; null stays null (``least`` and ``greatest`` would skip it)."""
    return F.when(col(x).isNotNull(), F.least(F.greatest(col(x), F.lit(low)), F.lit(high)))


def safe_z(x: Column | str, mean: Column | str, std: Column | str) -> Column:
    """``(x - mean) / std``; null where any is null or ``std`` is 0."""
    return F.when(col(std) != 0, (col(x) - col(mean)) / col(std))


def finite(x: Column | str) -> Column:
    return ~F.isnan(col(x)) & (F.abs(col(x)) < F.lit(float("inf")))


def nan_to_null(x: Column | str) -> Column:
    return F.when(finite(x), col(x))


def sigmoid(x: Column | str, bound: float = 10.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(x, -bound, bound)))


def haversine(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str, radius: float = EARTH_NM) -> Column:
    """Great-circle distance, in the radius's unit."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    dlat, dlon = b - a, F.radians(col(lon2)) - F.radians(col(lon1))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Initial course in degrees, 0 to 360."""
    a, b, dlon = F.radians(col(lat1)), F.radians(col(lat2)), F.radians(col(lon2)) - F.radians(col(lon1))
    y = F.sin(dlon) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def slug(text: Column | str) -> Column:
    """Lower case, runs of other characters as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(text))), "[^a-z0-9]+", "-"), "^-|-$", "")


def along(u: Column | str, v: Column | str, course_rad: Column | str) -> Column:
    """Component against the course: ``-(u cos + v sin)``, the course taken as a mathematical angle."""
    return -(col(u) * F.cos(col(course_rad)) + col(v) * F.sin(col(course_rad)))
