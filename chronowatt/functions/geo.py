"""Distance and sun expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0

# Coefficients of the public NOAA equation-of-time series, in minutes.
EQUATION_OF_TIME = (229.18, 0.000075, 0.001868, -0.032077, -0.014615, -0.040849)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_dp = (p2 - p1) / 2
    half_dl = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_dp), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_dl), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def equation_of_time_minutes(day: Column) -> Column:
    scale, base, c1, s1, c2, s2 = EQUATION_OF_TIME
    g = 2 * math.pi / 365.0 * (F.dayofyear(day) - 0.5)
    return scale * (
        base + c1 * F.cos(g) + s1 * F.sin(g) + c2 * F.cos(2 * g) + s2 * F.sin(2 * g)
    )


def solar_noon_utc_hours(day: Column, longitude: Column | float) -> Column:
    """True solar noon of a day, in decimal UTC hours."""
    longitude = F.lit(longitude) if isinstance(longitude, float) else longitude
    return 12.0 - longitude / 15.0 - equation_of_time_minutes(day) / 60.0
