"""Simpler tracks whose lines stay within an error of every point.

A vessel's track is cut into spans of time, whose first points are always kept,
so a span is simplified by itself and no task needs a whole track. Within a span
the point that is farthest from the line between two kept ones is kept too, as
long as it is farther than the error, and both halves go on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.functions.geo import EARTH_RADIUS_KM, is_finite
from tracklake.functions.parsing import with_timestamp

DEGREE_KM = EARTH_RADIUS_KM * np.pi / 180


def kept_points(lat: np.ndarray, lon: np.ndarray, error_km: float) -> np.ndarray:
    """Which points of a polyline stay: the ends, and as many more as the error asks for.

    Distances are those on a plane that touches the Earth near the line; of a
    line over the date line, longitudes go on beyond 180.
    """
    n = len(lat)
    keep = np.zeros(n, bool)
    if not n:
        return keep
    keep[[0, -1]] = True
    y = lat * DEGREE_KM
    x = np.unwrap(lon, period=360) * DEGREE_KM * np.cos(np.radians(lat.mean()))
    todo = [(0, n - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        length = dx * dx + dy * dy
        along = np.clip((px * dx + py * dy) / length, 0, 1) if length else np.zeros(b - a - 1)
        away = np.hypot(px - along * dx, py - along * dy)
        far = int(away.argmax())
        if away[far] > error_km:
            keep[a + 1 + far] = True
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return keep


def simplify(df: DataFrame, error_km: float = 0.05, span: str = "day", key: str | None = "MMSI") -> DataFrame:
    """The rows of each track that its simplified line keeps, with their MMSI (if there is a key), ts, LAT and LON.

    ``span`` is the unit of date_trunc by which tracks are cut: one span of one
    vessel is one group. Each span's first and last row stay. Rows without
    vessel, time or a finite position are left out.
    """
    df = with_timestamp(df)
    if missing := [c for c in ([key] if key else []) + ["ts", "LAT", "LON"] if c not in df.columns]:
        raise ValueError(f"Simplification needs the columns {missing}")
    vessel = F.col(key).try_cast("bigint") if key else F.lit(0).cast("bigint")
    lat, lon = F.col("LAT").try_cast("double"), F.col("LON").try_cast("double")
    rows = df.select(vessel.alias("MMSI"), F.col("ts").cast("timestamp_ntz").alias("ts"), lat.alias("LAT"), lon.alias("LON"))
    rows = rows.where(F.col("MMSI").isNotNull() & F.col("ts").isNotNull() & is_finite(F.col("LAT")) & is_finite(F.col("LON")))
    rows = rows.withColumn("span", F.date_trunc(span, "ts"))

    def thin(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ts", "LAT", "LON"], kind="stable")
        return group[kept_points(group.LAT.to_numpy(), group.LON.to_numpy(), error_km)][["MMSI", "ts", "LAT", "LON"]]

    out = rows.groupBy("MMSI", "span").applyInPandas(thin, "MMSI bigint, ts timestamp_ntz, LAT double, LON double")
    return out if key else out.drop("MMSI")
