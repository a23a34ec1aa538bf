"""Hexagonal cells against published ones, and against what the grid promises everywhere."""

import math

import pytest
from pyspark.sql import functions as F

from tracklake.functions import h3
from tracklake.operators.spatial import grid_features

#: Points and cells as documentation and examples of the grid publish them.
PUBLISHED = [
    (37.775938728915946, -122.41795063018799, 9, "8928308280fffff"),
    (37.769377, -122.388903, 9, "89283082e73ffff"),
    (37.3615593, -122.0553238, 5, "85283473fffffff"),
    (37.3615593, -122.0553238, 7, "87283472bffffff"),
    (40.689167, -74.044444, 10, "8a2a1072b59ffff"),
    (0.0, 0.0, 0, "8075fffffffffff"),
    (0.0, 0.0, 9, "89754e64993ffff"),
    (0.0, 0.0, 15, "8f754e64992d6d8"),
]
#: The pentagons of resolution 0.
PENTAGONS = {
    "8009fffffffffff", "801dfffffffffff", "8031fffffffffff", "804dfffffffffff", "8063fffffffffff", "8075fffffffffff",
    "807ffffffffffff", "8091fffffffffff", "80a7fffffffffff", "80c3fffffffffff", "80d7fffffffffff", "80ebfffffffffff",
}


def cells(spark, points, resolution):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "n int, la double, lo double").coalesce(1)
    found = h3.with_h3(df, F.col("la"), F.col("lo"), resolution)
    assert found.columns == ["n", "la", "lo", "h3"]
    return [r.h3 for r in found.orderBy("n").collect()]


@pytest.mark.parametrize("resolution", sorted({r for _, _, r, _ in PUBLISHED}))
def test_published_cells(spark, resolution):
    rows = [(la, lo, c) for la, lo, r, c in PUBLISHED if r == resolution]
    assert cells(spark, [r[:2] for r in rows], resolution) == [r[2] for r in rows]


def degrees(v):
    return math.degrees(math.asin(v[2])), math.degrees(math.atan2(v[1], v[0]))


@pytest.mark.parametrize("resolution", [0, 7, 15])
def test_pentagons_are_the_corners_of_the_icosahedron(spark, resolution):
    corners = {tuple(round(x, 9) for x in h3._place(f, *p)): degrees(h3._place(f, *p)) for f in range(20) for p in ((2, 0), (0, 2), (-2, -2))}
    assert len(corners) == 12
    tail = "0" * resolution + "f" * (15 - resolution)
    want = {f"{(1 << 59) | (resolution << 52) | (int(c[1:4], 16) >> 1 & 127) << 45 | int('0o' + tail.replace('f', '7'), 8):x}" for c in PENTAGONS}
    # A point at the corner itself has no direction; a nudge to each side stays in the middle cell.
    nudged = [(la + 1e-7 * a, lo + 1e-7 * b) for la, lo in corners.values() for a, b in ((1, 0), (-1, 1), (-1, -1))]
    assert set(cells(spark, nudged, resolution)) == want and (resolution or want == PENTAGONS)


@pytest.mark.parametrize("resolution", [0, 1, 2])
def test_cells_cover_the_globe_once(spark, resolution):
    """As many cells as the grid has, each in one place, and no child that a pentagon lacks."""
    n = 60_000
    points = []
    for i in range(n):  # evenly spread over the sphere
        points.append((math.degrees(math.asin(1 - 2 * (i + 0.5) / n)), (i * 137.50776405) % 360 - 180))
    found = {}
    for (la, lo), cell in zip(points, cells(spark, points, resolution), strict=True):
        found.setdefault(cell, []).append(h3._vector(math.radians(la), math.radians(lo)))
    assert len(found) == 2 + 120 * 7**resolution
    reach = 1.6 * math.sqrt(4 * math.pi / len(found))
    assert all(math.dist(vs[0], v) < reach for vs in found.values() for v in vs)


def test_date_line_poles_and_odd_input(spark):
    for resolution in (3, 8):
        east, west = cells(spark, [(la, 180.0) for la in (-70.3, -1.7, 33.3)], resolution), cells(spark, [(la, -180.0) for la in (-70.3, -1.7, 33.3)], resolution)
        assert east == west
        poles = cells(spark, [(90.0, lo) for lo in (-170.0, 3.0, 91.0)] + [(-90.0, lo) for lo in (-170.0, 3.0, 91.0)], resolution)
        assert len(set(poles)) == 2
    odd = [(None, 1.0), (1.0, None), (float("nan"), 1.0), (1.0, float("inf"))]
    assert cells(spark, odd, 4) == [None] * 4
    with pytest.raises(ValueError):
        cells(spark, [], 16)


def test_grid_features_by_h3(spark):
    df = spark.createDataFrame([(54.3, 18.6, 10.0, 45.0), (54.3, 18.6, 12.0, 55.0), (54.9, 18.6, 3.0, None), (None, 18.6, 1.0, 1.0)], "LAT double, LON double, SOG double, COG double")
    out = {r.h3: tuple(r)[1:] for r in grid_features(df, 7).collect()}
    assert sorted(out.values(), key=str) == [(1, 3.0, None), (2, 11.0, 50.0)] and all(len(c) == 15 for c in out)
    plan = grid_features(df, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") == 1
