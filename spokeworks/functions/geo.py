"""Distance on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spokeworks.schemas import EARTH_RADIUS_KM, KM_PER_MILE


def great_circle_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Miles between two points in degrees; NULL if a coordinate is missing.

    Uses the two-argument arc tangent, which is accurate for near and for
    opposite points and gives exactly 0 for equal points.
    """
    a, b = F.radians(lat1), F.radians(lat2)
    turn = F.radians(lon2) - F.radians(lon1)
    east = F.cos(b) * F.sin(turn)
    north = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(turn)
    along = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(turn)
    angle = F.atan2(F.sqrt(east * east + north * north), along)
    return angle * EARTH_RADIUS_KM / KM_PER_MILE
