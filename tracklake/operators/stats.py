"""Trajectory statistics: one shuffle on the vessel, one sort, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake.functions.geo import angle_diff_deg, haversine_km, is_finite
from tracklake.plans.tracks import (
    HOUR, by_hour, carried_forward, first_of, handed, hours, hours_before, last_known, last_of, running, track_window, with_order, with_previous,
)

_METRICS = "points bigint, distance_km double, straight_km double, tortuosity double, turn_index_deg double, avg_sog double, max_sog double"
#: Straight distances below this (km) count as this in the tortuosity.
LEAST_STRAIGHT_KM = 1e-6


def _double(df: DataFrame, name: str) -> Column:
    return F.col(name).try_cast("double") if name in df.columns else F.lit(None).cast("double")


def compute_stats(df: DataFrame, level: str = "mmsi", mode: str = "lazy", split: str | None = None) -> DataFrame:
    """A row of statistics for each MMSI, or one row if there is no MMSI column.

    points, distance_km, straight_km, tortuosity, turn_index_deg, avg_sog,
    max_sog. Rows with a null MMSI are one group. Without LAT and LON the
    result is empty.

    ``mode="lazy"`` counts a pair of rows with an unknown course as no turn;
    a single point has a tortuosity of 0. ``mode="eager"`` carries courses
    forward; a single point has a tortuosity of 1 and no turn index, and
    without a COG column there is none.

    ``split``, a unit such as day or hour, deals a vessel's track by that span
    instead of giving it to one task; without an MMSI column it is an hour.
    """
    if level != "mmsi":
        raise ValueError(f"Unsupported level: {level!r}")
    if mode not in ("lazy", "eager"):
        raise ValueError(f"Unsupported mode: {mode!r}")
    key = "MMSI" if "MMSI" in df.columns else None
    if not {"LAT", "LON"} <= set(df.columns):
        empty = T.StructType.fromDDL(("MMSI bigint, " if key else "") + _METRICS)
        return df.sparkSession.createDataFrame([], empty)
    df, order = with_order(df)
    used = [c for c in dict.fromkeys([key, *order, "LAT", "LON", "SOG", "COG"]) if c and c in df.columns]
    has_cog = "COG" in df.columns
    points = df.select(*used).withColumns({c: _double(df, c) for c in ("LAT", "LON", "SOG", "COG")})
    w = track_window(key, order)
    here = F.struct("LAT", "LON", "COG")
    spans = "ts" in order and (key is None or split is not None)
    if spans and mode == "lazy":
        points = with_previous(points, order, here, key=key, unit=split or "hour")
    elif spans:
        points = _eager_by_spans(points, order, key, split or "hour")
    else:
        points = points.withColumn("previous", F.lag(here).over(w))
    segment = haversine_km(F.col("previous.LAT"), F.col("previous.LON"), F.col("LAT"), F.col("LON"))
    points = points.withColumn("segment_km", F.coalesce(segment, F.lit(0.0)))
    if mode == "lazy":
        points = points.withColumn("turn", F.coalesce(angle_diff_deg(F.col("COG"), F.col("previous.COG")), F.lit(0.0)))
    else:
        # An unknown course at the start, or a NaN, leaves every later angle undefined, and undefined angles add nothing.
        if not spans:
            points = points.withColumn("course", carried_forward(F.col("COG"), w))
            points = points.withColumns({"lost": F.max(~_known(F.col("course"))).over(running(w)), "previous_course": F.lag("course").over(w)})
        turn = angle_diff_deg(F.col("course"), F.col("previous_course"))
        points = points.withColumn("turn", F.when(F.col("lost"), 0.0).otherwise(F.coalesce(turn, F.lit(0.0))))
    place, when = F.struct("LAT", "LON"), F.struct(*order)
    sums = (points.groupBy(key) if key else points.groupBy()).agg(
        F.count(F.lit(1)).alias("points"),
        F.sum("segment_km").alias("d"),
        F.sum("turn").alias("turn"),
        F.avg("SOG").alias("avg_sog"),
        F.max("SOG").alias("max_sog"),
        F.min_by(place, when).alias("first"),
        F.max_by(place, when).alias("last"),
    )
    straight = haversine_km(F.col("first.LAT"), F.col("first.LON"), F.col("last.LAT"), F.col("last.LON"))
    tortuosity = F.col("d") / F.greatest(F.col("s"), F.lit(LEAST_STRAIGHT_KM))
    tortuosity = F.when(F.col("s").isNotNull(), tortuosity)
    turn = F.round("turn", 1)
    if mode == "eager":
        single = F.col("points") == 1
        tortuosity = F.when(single, 1.0).otherwise(tortuosity)
        turn = F.when(~single, turn) if has_cog else F.lit(None).cast("double")
    if not key:
        sums = sums.where(F.col("points") > 0)
    return sums.withColumn("s", straight).select(
        *([F.col(key).try_cast("bigint").alias(key)] if key else []),
        "points",
        F.round("d", 3).alias("distance_km"),
        F.round("s", 3).alias("straight_km"),
        F.round(tortuosity, 3).alias("tortuosity"),
        turn.alias("turn_index_deg"),
        "avg_sog",
        "max_sog",
    )


def _known(course: Column) -> Column:
    return F.coalesce(is_finite(course), F.lit(False))


def _eager_by_spans(points: DataFrame, order: list[str], key: str | None, unit: str) -> DataFrame:
    """Tracks dealt by hour: each row with the place before it, its course, that before it, and whether one was lost."""
    keys = [key] if key else []
    points, w, here = by_hour(points, unit), track_window([*keys, HOUR], order), F.struct("LAT", "LON", "COG")
    cog = F.col("COG")
    table = points.groupBy(*keys, HOUR).agg(
        last_of(here, order).alias("last"), last_known(cog, order).alias("cog"), first_of(F.struct(cog), order).alias("first"),
        F.max(cog.isNotNull() & ~_known(cog)).alias("broken"),
    )
    table = table.withColumns({"h_last": F.lag("last").over(hours(key)), "h_course": F.last("cog", ignorenulls=True).over(hours_before(key))})
    # A course is unknown in an hour if one reported there is, or if the hour starts without one and none is carried into it.
    unknown = F.col("broken") | (F.col("first.COG").isNull() & ~_known(F.col("h_course")))
    table = table.withColumn("unknown", unknown)
    table = table.select(*keys, HOUR, "h_last", "h_course", F.coalesce(F.max("unknown").over(hours_before(key)), F.lit(False)).alias("h_lost"))
    points = handed(points, table, key).withColumn("course", F.coalesce(carried_forward(cog, w), "h_course"))
    first = F.lag(here).over(w).isNull()
    return points.withColumns({
        "previous": F.coalesce(F.lag(here).over(w), F.col("h_last")),
        "previous_course": F.when(first, F.col("h_course")).otherwise(F.lag("course").over(w)),
        "lost": F.col("h_lost") | F.max(~_known(F.col("course"))).over(running(w)),
    })


def compute_stats_eager(df: DataFrame, level: str = "mmsi") -> DataFrame:
    return compute_stats(df, level, mode="eager")


def row_and_vessel_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: rows and distinct vessels, exactly or by a sketch of fixed size."""
    vessels = F.approx_count_distinct("MMSI") if approximate else F.count_distinct("MMSI")
    return df.agg(F.count(F.lit(1)).alias("rows"), vessels.alias("vessels"))


def timing_summary(runs: DataFrame) -> DataFrame:
    """Median, mean and sample deviation of ``seconds`` for each task and engine."""
    return runs.groupBy("task", "engine").agg(
        F.count(F.lit(1)).alias("runs"),
        F.median("seconds").alias("median_s"),
        F.avg("seconds").alias("mean_s"),
        F.stddev_samp("seconds").alias("sd_s"),
    )
