"""Trips and positions at regular times.

A vessel's trip ends where its reports fall silent for long. Between two reports
of one trip positions are put on a common time grid, on the great circle: each
pair of neighbours makes the grid times that lie between them, so a row never
becomes more than the limit of a gap over the step of the grid, and everything
happens in the one window by vessel that finds neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.geo import haversine_km, is_finite
from tracklake.functions.parsing import with_timestamp
from tracklake.plans.tracks import TIES

_EPOCH = "1970-01-01"


def _tracked(df: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    """vessel, ts, ms, LAT, LON, SOG and tie-breakers of rows with vessel, time and a finite position."""
    df = with_timestamp(df)
    if missing := [c for c in (key, "ts", "LAT", "LON") if c not in df.columns]:
        raise ValueError(f"Trips need the columns {missing}")
    ties = [c for c in TIES if c in df.columns]
    numbers = {c: F.col(c).try_cast("double") for c in ("LAT", "LON")}
    numbers["SOG"] = F.col("SOG").try_cast("double") if "SOG" in df.columns else F.lit(None).cast("double")
    ts = F.col("ts").cast("timestamp_ntz")
    rows = df.select(F.col(key).try_cast("bigint").alias("vessel"), ts.alias("ts"), *ties, *(c for c in ("LAT", "LON") if c not in ties)).withColumns(
        {c: v for c, v in numbers.items() if c in ("LAT", "LON") or c in ties} | ({} if "SOG" in ties else {"SOG": numbers["SOG"]})
    )
    rows = rows.withColumn("ms", F.timestamp_diff("MILLISECOND", F.lit(_EPOCH).cast("timestamp_ntz"), F.col("ts")))
    return rows.where(F.col("vessel").isNotNull() & F.col("ms").isNotNull() & is_finite(F.col("LAT")) & is_finite(F.col("LON"))), ["ts", *ties]


def trips(df: DataFrame, gap_min: float = 60, key: str = "MMSI") -> DataFrame:
    """MMSI, trip, start, end, points, distance_km and avg_sog of each trip; trips of a vessel count from 1.

    A report more than ``gap_min`` minutes after the one before begins a trip.
    Rows without vessel, time or a finite position are left out.
    """
    rows, order = _tracked(df, key)
    w = Window.partitionBy("vessel").orderBy(*order)
    km = haversine_km(F.lag("LAT").over(w), F.lag("LON").over(w), F.col("LAT"), F.col("LON"))
    silent = F.col("ms") - F.lag("ms").over(w) > round(gap_min * 60_000)
    rows = rows.withColumns({"km": km, "begins": F.coalesce(silent, F.lit(True))})
    rows = rows.withColumn("trip", F.sum(F.col("begins").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    speed = F.when(is_finite(F.col("SOG")), F.col("SOG"))
    found = rows.groupBy("vessel", "trip").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("points"),
        F.sum(F.when(F.col("begins"), 0.0).otherwise(F.col("km"))).alias("distance_km"), F.avg(speed).alias("avg_sog"),
    )
    return found.withColumnRenamed("vessel", "MMSI")


def between(lat1: Column, lon1: Column, lat2: Column, lon2: Column, share: Column) -> tuple[Column, Column]:
    """The point on the great circle at a ``share`` of the way, in degrees; equal and opposite points are taken on straight lines."""
    a1, o1, a2, o2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    half = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    angle = 2 * F.asin(F.least(F.sqrt(half), F.lit(1.0)))
    near, far = F.sin((1 - share) * angle), F.sin(share * angle)
    x = near * F.cos(a1) * F.cos(o1) + far * F.cos(a2) * F.cos(o2)
    y = near * F.cos(a1) * F.sin(o1) + far * F.cos(a2) * F.sin(o2)
    z = near * F.sin(a1) + far * F.sin(a2)
    straight = F.sin(angle) < 1e-12
    lat = F.when(straight, lat1 + (lat2 - lat1) * share).otherwise(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))))
    lon = F.when(straight, lon1 + (lon2 - lon1) * share).otherwise(F.degrees(F.atan2(y, x)))
    return lat, lon


def resample(df: DataFrame, step_s: float = 60, max_gap_s: float = 1800, key: str = "MMSI") -> DataFrame:
    """MMSI, ts, LAT, LON, SOG at the multiples of ``step_s`` from 1970 on, between reports at most ``max_gap_s`` apart.

    Position and speed are those between the two reports around; a grid time at
    which there is a report has the last of that time. Speed is null unless both
    reports have one. Gaps that are longer are not bridged, but a report on the
    grid is always there.
    """
    step, most = round(step_s * 1000), round(max_gap_s * 1000)
    if step <= 0 or most < 0:
        raise ValueError("step_s must be positive, and max_gap_s not negative")
    rows, order = _tracked(df, key)
    w = Window.partitionBy("vessel").orderBy(*order)
    following = {f"next_{c}": F.lead(c).over(w) for c in ("ms", "LAT", "LON", "SOG")}
    rows = rows.select("vessel", "ms", "LAT", "LON", "SOG", *(c.alias(n) for n, c in following.items()))
    bridged = F.col("next_ms") - F.col("ms") <= most
    first = F.ceil(F.col("ms") / F.lit(float(step))) * step
    # The last grid time before the next report; a report of its own time is its own end, unless the next one has that time too.
    last = F.when(bridged, F.floor((F.col("next_ms") - 1) / F.lit(float(step))) * step).otherwise(F.when(first == F.col("ms"), first))
    grid = rows.withColumns({"first": first, "last": last}).where(F.col("last") >= F.col("first"))
    grid = grid.withColumn("at", F.explode(F.sequence(F.col("first"), F.col("last"), F.lit(step).cast("bigint"))))
    share = (F.col("at") - F.col("ms")) / (F.col("next_ms") - F.col("ms"))
    own = F.col("at") == F.col("ms")
    lat, lon = between(*(F.col(c) for c in ("LAT", "LON", "next_LAT", "next_LON")), share)
    speed = F.col("SOG") + (F.col("next_SOG") - F.col("SOG")) * share
    start = F.lit(_EPOCH).cast("timestamp_ntz")
    return grid.select(
        F.col("vessel").alias("MMSI"), F.timestamp_add("MILLISECOND", F.col("at"), start).alias("ts"),
        F.when(own, F.col("LAT")).otherwise(lat).alias("LAT"), F.when(own, F.col("LON")).otherwise(lon).alias("LON"), F.when(own, F.col("SOG")).otherwise(speed).alias("SOG"),
    )
