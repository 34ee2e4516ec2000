"""Angles, distances and numbers that guard themselves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radii in kilometres and metres.
EARTH_KM, EARTH_M = 6371.0088, 6371000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in the radius' unit; null if any coordinate is null."""
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def angle_between(a: Column, b: Column) -> Column:
    """Degrees between two directions, 0 to 180."""
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def bearing(dx: Column, dy: Column) -> Column:
    """Compass bearing of an offset (dx to the east, dy to the north), 0 to 360."""
    return F.pmod(F.degrees(F.atan2(dx, dy)) + 360, F.lit(360.0))


def toward(direction: Column) -> Column:
    """The direction a wind named by its origin blows to."""
    return F.pmod(direction + 180, F.lit(360.0))


def season_distance(a: Column, b: Column) -> Column:
    """Days between two days of the year, around the turn of the year."""
    d = F.abs(F.dayofyear(a) - F.dayofyear(b))
    return F.least(d, 366 - d)


def safe_ratio(num: Column, den: Column, eps: float = 1e-12) -> Column:
    """num / den; null where den is null or within eps of zero, or the result isn't finite."""
    x = F.when(F.abs(den) > eps, num / den)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def normalised_difference(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return safe_ratio(a - b, a + b, eps)


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b), null unless both are above 0."""
    return F.when((a > 0) & (b > 0), F.ln(a / b))


def utm_epsg(lat: Column, lon: Column) -> Column:
    """EPSG number of the UTM zone."""
    zone = F.least(F.lit(60), F.greatest(F.lit(1), (F.floor((lon + 180) / 6) + 1).cast("int")))
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


def hours_between(a: Column, b: Column) -> Column:
    """(a - b) in hours, to the microsecond."""
    return (F.unix_micros(a) - F.unix_micros(b)) / 3.6e9
