"""Geometry as column expressions: a sphere for points, local flat metres for lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sphere radius and metres of a degree.
EARTH_M, DEGREE_M = 6371000.0, 111320.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def point_segment_m(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres from a point to a segment, in flat metres around the segment's middle latitude; the foot is clamped."""
    k = F.cos(F.radians((lat1 + lat2) / 2)) * DEGREE_M
    dx, dy = (lon2 - lon1) * k, (lat2 - lat1) * DEGREE_M
    px, py = (lon - lon1) * k, (lat - lat1) * DEGREE_M
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / size))).otherwise(F.lit(0.0))
    return F.sqrt(F.pow(px - t * dx, 2) + F.pow(py - t * dy, 2))


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def valid_point(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180)
