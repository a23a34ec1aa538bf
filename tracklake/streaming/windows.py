"""Windowed aggregates of a stream of points, with a policy for late rows.

A window's result is given out once, when the watermark has passed its end.
Rows that come later than ``lateness`` behind the latest time seen are left out
and counted: ``late_rows`` reads the count from a query's progress.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracklake.functions.parsing import with_timestamp


def _timed(df: DataFrame, lateness: str) -> DataFrame:
    """MMSI, time, SOG of rows that have vessel and time."""
    df = with_timestamp(df)
    speed = F.col("SOG").try_cast("double") if "SOG" in df.columns else F.lit(None).cast("double")
    rows = df.select(F.col("MMSI").try_cast("bigint").alias("MMSI"), F.col("ts").cast("timestamp").alias("time"), speed.alias("SOG"))
    return rows.where(F.col("MMSI").isNotNull() & F.col("time").isNotNull()).withWatermark("time", lateness)


def _aggregates() -> list[Column]:
    known = (F.col("SOG") > float("-inf")) & (F.col("SOG") < float("inf"))
    return [
        F.count(F.lit(1)).alias("points"), F.min("time").alias("first_time"), F.max("time").alias("last_time"),
        F.avg(F.when(known, F.col("SOG"))).alias("avg_sog"), F.max(F.when(known, F.col("SOG"))).alias("max_sog"),
    ]


def sessions_stream(df: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """MMSI, start, end and aggregates of each run of a vessel's rows that follow each other by less than ``gap``; end is the last row's time and the gap."""
    grouped = _timed(df, lateness).groupBy("MMSI", F.session_window("time", gap).alias("session")).agg(*_aggregates())
    return grouped.select("MMSI", F.col("session.start").alias("start"), F.col("session.end").alias("end"), "points", "first_time", "last_time", "avg_sog", "max_sog")


def windows_stream(df: DataFrame, length: str = "1 hour", slide: str = "15 minutes", lateness: str = "1 hour", by_vessel: bool = True) -> DataFrame:
    """Aggregates of windows of ``length`` that begin every ``slide``, by vessel or over all, with the number of vessels then."""
    rows = _timed(df, lateness)
    keys = ["MMSI"] if by_vessel else []
    aggregates = _aggregates() if by_vessel else [*_aggregates(), F.approx_count_distinct("MMSI", 0.01).alias("vessels")]
    grouped = rows.groupBy(*keys, F.window("time", length, slide).alias("span")).agg(*aggregates)
    return grouped.select(*keys, F.col("span.start").alias("start"), F.col("span.end").alias("end"), *(c for c in grouped.columns if c not in (*keys, "span")))


def late_rows(query: StreamingQuery) -> int:
    """Rows (of aggregates, partial groups of rows) that a query's stateful operators have left out as too late, over the progress it still holds."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
