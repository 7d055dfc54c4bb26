"""Places on a sphere: distances, boxes and grid cells as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidInput

RADIUS_M = 6_371_000.0


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    return 2 * RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2))))


def valid(lon: Column, lat: Column) -> Column:
    return F.coalesce(lon.between(-180, 180) & lat.between(-90, 90) & ~F.isnan(lon) & ~F.isnan(lat), F.lit(False))


def check(lon: float, lat: float) -> None:
    if not (math.isfinite(lon) and math.isfinite(lat) and abs(lon) <= 180 and abs(lat) <= 90):
        raise InvalidInput(f"no place: {lon}, {lat}")


def in_box(lon: Column, lat: Column, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> Column:
    """Inside a box; one with min_lon > max_lon crosses the antimeridian."""
    across = (lon >= min_lon) | (lon <= max_lon) if min_lon > max_lon else lon.between(min_lon, max_lon)
    return across & lat.between(min_lat, max_lat)


def middle_lon(min_lon: float, max_lon: float) -> float:
    if min_lon <= max_lon:
        return (min_lon + max_lon) / 2
    mid = (min_lon + max_lon + 360) / 2
    return mid - 360 if mid > 180 else mid


def box_around(lon: float, lat: float, meters: float) -> tuple[float, float, float, float] | tuple[None, float, None, float]:
    """(min_lon, min_lat, max_lon, max_lat) that holds the circle; longitudes are None where every one may be inside."""
    check(lon, lat)
    d = math.degrees(meters / RADIUS_M) * (1 + 1e-9)
    low, high = max(-90.0, lat - d), min(90.0, lat + d)
    if lat - d <= -90 or lat + d >= 90 or d >= 90:
        return None, low, None, high
    wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(d)) / math.cos(math.radians(lat))))) * (1 + 1e-9)
    if wide >= 180:
        return None, low, None, high
    wrap = lambda x: (x + 180) % 360 - 180
    return wrap(lon - wide), low, wrap(lon + wide), high


def cell(lon: Column, lat: Column, precision: int = 6) -> Column:
    """The decimal grid cell `x:y` of a place, with `precision` digits (0 to 9) after the point."""
    if not 0 <= precision <= 9:
        raise InvalidInput("0 to 9 digits")
    return F.concat_ws(":", F.floor((lon + 180) * 10**precision).cast("string"), F.floor((lat + 90) * 10**precision).cast("string"))
