"""Shared pieces of logical plans."""

from tracklake.plans.tracks import SEQUENCE, track_window, with_order

__all__ = ["SEQUENCE", "track_window", "with_order"]
