"""Distances and polygon tests as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
KM_PER_LAT, KM_PER_LON = 110.574, 111.320


def central_km(p1: Column, cos1: Column, lon1: Column, p2: Column, cos2: Column, lon2: Column) -> Column:
    """Great-circle distance in km of points whose latitudes are in radians and known with their cosines; longitudes are in degrees."""
    sin_lat, sin_lon = F.sin((p2 - p1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = sin_lat * sin_lat + cos1 * cos2 * (sin_lon * sin_lon)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def close_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km; the difference of degrees, which is exact for near points, is taken before it goes to radians."""
    sin_lat, sin_lon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = sin_lat * sin_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * (sin_lon * sin_lon)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def rounded(x: Column, digits: int) -> Column:
    """``x``, not negative, to ``digits`` decimals, halves up. ``F.round`` makes a text and a decimal of each double, which costs more than the distance of a pair."""
    return F.floor(x * F.lit(float(10**digits)) + 0.5) / F.lit(float(10**digits))


def decay(distance: Column, full: float, zero: float) -> Column:
    """1 up to ``full``, 0 from ``zero`` on, linear between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(zero) - distance) / F.lit(zero - full)))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd ray cast of a point against a closed ring, an array of structs (x, y)."""

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    edges = F.sequence(F.lit(1), F.size(ring) - 1)
    return F.aggregate(edges, F.lit(False), lambda inside, i: inside != F.coalesce(crosses(i), F.lit(False)))


def segment_m(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar distance in metres from a point to a segment, in the projection around the point."""
    kx = F.lit(KM_PER_LON * 1000) * F.cos(F.radians(lat))
    x1, y1, x2, y2 = (lon1 - lon) * kx, (lat1 - lat) * (KM_PER_LAT * 1000), (lon2 - lon) * kx, (lat2 - lat) * (KM_PER_LAT * 1000)
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    along = F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x1 * dx + y1 * dy) / size)))
    return F.sqrt(F.pow(x1 + along * dx, 2) + F.pow(y1 + along * dy, 2))
