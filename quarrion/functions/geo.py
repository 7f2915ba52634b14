"""Points on the globe: parsing, distances, polygons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def parse_point(text: Column) -> Column:
    """struct<lat, lon> of "lat,lon", to six decimals; null if malformed or out of range."""
    parts = F.split(text, ",")
    lat, lon = (F.get(parts, F.lit(i)).try_cast("double") for i in (0, 1))
    fine = (F.size(parts) == 2) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(fine, F.struct(F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon")))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def within_km(lat: Column, lon: Column, centre: tuple[float, float], km: float) -> Column:
    return haversine_km(lat, lon, F.lit(float(centre[0])), F.lit(float(centre[1]))) <= km


def in_box(lat: Column, lon: Column, low: tuple[float, float], high: tuple[float, float]) -> Column:
    return lat.between(low[0], high[0]) & lon.between(low[1], high[1])


def in_polygon(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting behind a test of the bounding box; ring: (lat, lon) corners."""
    if len(ring) < 3:
        return F.lit(False)
    crossings = F.lit(0)
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 == y2:
            continue
        spans = (F.lit(float(y1)) > lat) != (F.lit(float(y2)) > lat)
        crossings = crossings + F.when(spans & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1), 1).otherwise(0)
    lats, lons = zip(*ring, strict=True)
    return in_box(lat, lon, (min(lats), min(lons)), (max(lats), max(lons))) & (crossings % 2 == 1)
