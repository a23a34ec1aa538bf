"""Vessel-trajectory analytics on Spark.

Names are loaded when first used, so a Python worker that needs one module
does not import all.
"""

from importlib import import_module

_HOMES = {
    "TrackDataset": "dataset", "compute_stats": "operators.stats", "compute_stats_eager": "operators.stats",
    "detect_events": "operators.events", "detect_events_stream": "streaming.online", "geofence": "operators.spatial",
    "grid_features": "operators.spatial", "normalize_columns": "schema", "plot_track_html": "viz",
    "process_stream": "streaming.online", "write_parquet": "sources.sinks",
}
__all__ = sorted(_HOMES)


def __getattr__(name: str):
    if name not in _HOMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_HOMES[name]}"), name)
