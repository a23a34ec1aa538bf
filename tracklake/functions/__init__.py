"""Column expressions: geometry, angles, tolerant parsing."""

from tracklake.functions.geo import angle_diff_deg, haversine_km
from tracklake.functions.parsing import epoch_ms, parse_timestamp, to_double, to_long

__all__ = ["angle_diff_deg", "epoch_ms", "haversine_km", "parse_timestamp", "to_double", "to_long"]
