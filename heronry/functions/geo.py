"""Geometry on the sphere as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    y = F.sin(F.radians(lon2 - lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def sector(bearing: Column) -> Column:
    """0 .. 7 for N, NE, .. NW."""
    return F.floor(F.pmod(bearing + 22.5, F.lit(360.0)) / 45)


def inside_ring(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd test against a ring of (lat, lon)."""
    crossings = F.lit(0)
    for (a_lat, a_lon), (b_lat, b_lon) in zip(ring, ring[1:] + ring[:1]):
        if a_lat == b_lat:
            continue
        spans = (F.lit(a_lat) > lat) != (F.lit(b_lat) > lat)
        at = (b_lon - a_lon) * (lat - a_lat) / (b_lat - a_lat) + a_lon
        crossings = crossings + F.when(spans & (lon < at), 1).otherwise(0)
    return crossings % 2 == 1


def synthetic_lat(key: Column) -> Column:
    return (key * 37 % 1400) / 10.0 - 70


def synthetic_lon(key: Column) -> Column:
    return (key * 91 % 3600) / 10.0 - 180
