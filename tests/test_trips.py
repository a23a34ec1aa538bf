"""Trips, positions at regular times, mergeable sketches and simplified tracks."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake import viz
from tracklake.operators.simplify import DEGREE_KM, kept_points, simplify
from tracklake.operators.sketches import daily_sketches, estimates, merged
from tracklake.operators.trips import resample, trips

START = 1_700_000_000


def frame(spark, rows):
    rows = [(m, None if t is None else float(t), *rest) for m, t, *rest in rows]
    df = spark.createDataFrame(rows, "MMSI bigint, t double, LAT double, LON double, SOG double")
    return df.withColumn("ts", F.timestamp_millis((F.col("t") * 1000).cast("bigint")).cast("timestamp_ntz")).drop("t")


def seconds(df):
    return df.withColumn("t", F.unix_timestamp(F.col("ts").cast("timestamp")))


def test_trips(spark):
    rows = [(1, START, 50.0, 10.0, 1.0), (1, START + 3600, 51.0, 10.0, 3.0), (1, START + 7201, 52.0, 10.0, None), (1, START + 7300, 52.0, 10.0, float("nan")), (2, START, 0.0, 0.0, 5.0)]
    rows += [(None, START, 1.0, 1.0, 1.0), (3, None, 1.0, 1.0, 1.0), (3, START, None, 1.0, 1.0), (2, START, 0.0, 0.0, 5.0)]
    got = sorted((r.MMSI, r.trip, r.points, round(r.distance_km, 3), r.avg_sog) for r in trips(frame(spark, rows)).collect())
    assert got == [(1, 1, 2, 111.195, 2.0), (1, 2, 2, 0.0, None), (2, 1, 2, 0.0, 5.0)]
    assert trips(frame(spark, rows).limit(0)).collect() == []
    with pytest.raises(ValueError):
        trips(frame(spark, rows).drop("LAT"))


def test_resample(spark):
    base = START // 60 * 60
    rows = [(1, base + 30, 0.0, 179.0, 2.0), (1, base + 150, 0.0, -179.0, 6.0), (1, base + 180, 1.0, -179.0, None), (1, base + 180, 2.0, -179.0, 4.0)]
    rows += [(1, base + 5000, 3.0, 1.0, 1.0), (1, base + 6000, 3.0, 1.0, 1.0), (2, base + 1, 5.0, 5.0, 5.0), (3, base + 60, 7.0, 7.0, 7.0), (None, base, 1.0, 1.0, 1.0), (4, base, float("inf"), 1.0, 1.0)]
    got = sorted((r.MMSI, r.t - base, round(r.LAT, 6), round(r.LON, 6), r.SOG) for r in seconds(resample(frame(spark, rows), 60, 900)).collect())
    # At 180 there are two reports; the greater one counts. Over the date line the way is the short one.
    assert got == [(1, 60, 0.0, 179.5, 3.0), (1, 120, 0.0, -179.5, 5.0), (1, 180, 2.0, -179.0, 4.0), (1, 6000, 3.0, 1.0, 1.0), (3, 60, 7.0, 7.0, 7.0)]
    with pytest.raises(ValueError):
        resample(frame(spark, rows), 0)
    plan = resample(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_resample_of_a_vessel_that_stays_where_it_is(spark):
    rows = [(1, 0.0, 54.483, 18.827, 1.0), (1, 240.0, 54.483, 18.827, 3.0)]
    got = sorted((r.t, r.LAT, r.LON, r.SOG) for r in seconds(resample(frame(spark, rows), 60, 900)).collect())
    assert got == [(60 * i, 54.483, 18.827, 1.0 + i / 2) for i in range(5)]


def test_resampled_points_lie_on_the_great_circle(spark):
    rows = [(1, 0.0, 60.0, -100.0, 0.0), (1, 1000.0, 40.0, 60.0, 10.0)]
    points = resample(frame(spark, rows), 100, 1000).orderBy("ts").collect()
    vector = lambda la, lo: np.array([math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)])
    v = [vector(math.radians(r.LAT), math.radians(r.LON)) for r in points]
    steps = [math.acos(a @ b) for a, b in zip(v, v[1:], strict=False)]
    assert len(points) == 11 and max(steps) - min(steps) < 1e-6
    assert all(abs(np.dot(np.cross(v[0], v[-1]), x)) < 1e-9 for x in v)


def test_sketches_merge_within_their_bounds(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3000), START + rng.randrange(20 * 86_400), 50 + rng.random() * 4, 10 + rng.random() * 4, rng.expovariate(0.2)) for _ in range(30_000)]
    rows += [(None, START, 50.0, 10.0, None), (5, START, 50.0, 10.0, float("nan")), (1, None, 50.0, 10.0, 1.0), (1, START, None, 10.0, 1.0)]
    df = frame(spark, rows)
    stored = daily_sketches(df, 1)
    parts = merged(stored, "cell")
    (row,) = estimates(merged(parts), (0.1, 0.5, 0.99)).collect()
    speeds = sorted(r[4] for r in rows[:30_000])
    assert row.points == 30_002 and abs(row.vessels - len({r[0] for r in rows[:30_000]})) < 0.03 * 3000
    for q, value in ((0.1, row.sog_p10), (0.5, row.sog_p50), (0.99, row.sog_p99)):
        assert abs(np.searchsorted(speeds, value) / len(speeds) - q) < 0.015
    (lone,) = estimates(daily_sketches(frame(spark, [(None, START, 1.0, 1.0, None)]))).collect()
    assert (lone.points, lone.vessels, lone.sog_p50) == (1, 0, None)


def deviation(lat, lon, keep):
    """The greatest distance of a point from the line kept, found on its own."""
    y, x = lat * DEGREE_KM, np.unwrap(lon, period=360) * DEGREE_KM * np.cos(np.radians(lat.mean()))
    at = np.flatnonzero(keep)
    most = 0.0
    for a, b in zip(at, at[1:], strict=False):
        for i in range(a, b + 1):
            d, p = complex(x[b] - x[a], y[b] - y[a]), complex(x[i] - x[a], y[i] - y[a])
            f = min(1, max(0, (p * d.conjugate()).real / abs(d) ** 2)) if d else 0
            most = max(most, abs(p - f * d))
    return most


@pytest.mark.parametrize("error", [0.01, 0.5, 5])
def test_simplified_lines_keep_the_error(spark, error):
    rng = np.random.default_rng(4)
    lat, lon = 54 + np.cumsum(rng.normal(0, 0.003, 800)), 179.5 + np.cumsum(rng.normal(0.002, 0.003, 800))
    lon = (lon + 180) % 360 - 180
    keep = kept_points(lat, lon, error)
    assert keep[0] and keep[-1] and deviation(lat, lon, keep) <= error and keep.sum() < 800
    rows = [(v, START + 600.0 * i, float(a), float(b), 0.0) for v in (1, 2) for i, (a, b) in enumerate(zip(lat, lon, strict=True))]
    got = simplify(frame(spark, [*rows, (None, START, 1.0, 1.0, 1.0)]), error).orderBy("MMSI", "ts").collect()
    days = [(START + 600 * i) // 86_400 for i in range(800)]
    want = []
    for day in sorted(set(days)):
        span = np.array([d == day for d in days])
        want += list(lat[span][kept_points(lat[span], lon[span], error)])
    assert [r.LAT for r in got if r.MMSI == 1] == want == [r.LAT for r in got if r.MMSI == 2]


def test_simplification_edges(spark):
    assert kept_points(np.array([]), np.array([]), 1.0).sum() == 0 and kept_points(np.array([1.0]), np.array([1.0]), 1.0).all()
    assert list(kept_points(np.full(5, 3.0), np.full(5, 3.0), 0.1)) == [True, False, False, False, True]
    assert simplify(frame(spark, [(1, START, 1.0, 1.0, 1.0)]).limit(0)).collect() == []


def test_map_of_a_simplified_line(spark, tmp_path):
    rows = [(1, START + i, 50 + i / 1000, 10.0, 1.0) for i in range(300)]
    page = viz.plot_track_html(frame(spark, rows), tmp_path / "map.html", error_km=0.01).read_text(encoding="utf-8")
    assert json.loads(re.search('id="track">(.*)</script>', page)[1]) == [[50.0, 10.0], [50.299, 10.0]]
