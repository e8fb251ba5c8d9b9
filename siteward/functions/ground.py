"""Distances on the ground as column expressions, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The half axis and the flattening of the WGS84 ellipsoid.
AXIS_M, FLATTENING = 6378137.0, 1 / 298.257223563
ECCENTRICITY2 = FLATTENING * (2 - FLATTENING)


def local_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two near points by the two radii of curvature at their middle latitude."""
    phi = F.radians((lat1 + lat2) / 2)
    bend = 1 - ECCENTRICITY2 * F.pow(F.sin(phi), 2)
    x = F.radians(lon2 - lon1) * F.cos(phi) * AXIS_M / F.sqrt(bend)
    y = F.radians(lat2 - lat1) * AXIS_M * (1 - ECCENTRICITY2) / F.pow(bend, 1.5)
    return F.sqrt(x * x + y * y)


def local_m_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    phi = f"radians(({lat1} + {lat2}) / 2)"
    bend = f"(1 - {ECCENTRICITY2!r}::DOUBLE * pow(sin({phi}), 2))"
    return f"sqrt(pow(radians({lon2} - {lon1}) * cos({phi}) * {AXIS_M}::DOUBLE / sqrt({bend}), 2) + pow(radians({lat2} - {lat1}) * {AXIS_M * (1 - ECCENTRICITY2)!r}::DOUBLE / pow({bend}, 1.5), 2))"


def planar_microdegrees(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance in the plane of degrees, in millionths of one."""
    return F.sqrt(F.pow(lon2 - lon1, 2) + F.pow(lat2 - lat1, 2)) * 1e6


def length_m(points: Column) -> Column:
    """The length of an array of (lon, lat)."""
    n = F.size(points)
    steps = F.zip_with(F.slice(points, 2, n - 1), F.slice(points, 1, n - 1), lambda b, a: local_m(a["lon"], a["lat"], b["lon"], b["lat"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)
