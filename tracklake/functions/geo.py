"""Distances and angles as Catalyst expressions, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius in km; a fixed value.
EARTH_RADIUS_KM = 6371.0088


def _col(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine_km(lat1: Column | str | float, lon1: Column | str | float, lat2: Column | str | float, lon2: Column | str | float) -> Column:
    """Great-circle distance in km of points in degrees; null or NaN if a coordinate is."""
    phi1, lam1, phi2, lam2 = (F.radians(_col(x)) for x in (lat1, lon1, lat2, lon2))
    half_phi, half_lam = F.sin((phi2 - phi1) / 2), F.sin((lam2 - lam1) / 2)
    a = half_phi * half_phi + F.cos(phi1) * F.cos(phi2) * half_lam * half_lam
    # least and greatest skip nulls and rank NaN highest, so the clip applies only to numbers.
    clipped = F.when(a < 0, F.lit(0.0)).when((a > 1) & ~F.isnan(a), F.lit(1.0)).otherwise(a)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(clipped))


def angle_diff_deg(current: Column | str, previous: Column | str) -> Column:
    """The smaller angle between two directions in degrees, 0 to 180.

    The difference is taken in radians: whether exact multiples of a threshold
    fire depends on this form.
    """
    d = F.radians(_col(current)) - F.radians(_col(previous))
    return F.abs(F.degrees(F.atan2(F.sin(d), F.cos(d))))


def is_finite(x: Column) -> Column:
    """True for a number that is not null, NaN or infinite. NaN ranks above every number in Spark."""
    return F.coalesce((x < float("inf")) & (x > float("-inf")), F.lit(False))
