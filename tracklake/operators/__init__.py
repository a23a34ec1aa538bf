"""Analytical operators on point tables."""

from tracklake.operators.events import detect_events
from tracklake.operators.spatial import geofence, grid_features
from tracklake.operators.stats import compute_stats, compute_stats_eager

__all__ = ["compute_stats", "compute_stats_eager", "detect_events", "geofence", "grid_features"]
