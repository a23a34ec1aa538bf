"""Encounters, areas and tracks dealt by spans, against plain versions; and their plans."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tracklake import queries as own
from tracklake.operators.areas import _cells, _edges, cover, covers, points_in_areas
from tracklake.operators.encounters import FORWARD, encounters
from tracklake.operators.events import detect_events
from tracklake.operators.stats import compute_stats

START = 1_700_000_400  # a multiple of 600 seconds


def km_between(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


def brute_encounters(rows, km, seconds):
    last = {}
    for v, t, lat, lon in rows:
        if None in (v, t, lat, lon) or not all(map(math.isfinite, (lat, lon))) or abs(lat) > 90:
            continue
        slot = t // seconds
        last[v, slot] = max(last.get((v, slot), (0,)), (t, lat, lon))
    met = {}
    for (v, s), p in last.items():
        for (w, r), q in last.items():
            if v < w and s == r and (d := km_between(p[1:], q[1:])) <= km:
                met.setdefault((v, w), {})[s] = d
    out = []
    for (v, w), slots in met.items():
        run = []
        for s in sorted(slots):
            if run and s != run[-1] + 1:
                out.append((v, w, run[0] * seconds, (run[-1] + 1) * seconds, len(run), round(min(slots[x] for x in run), 6)))
                run = []
            run.append(s)
        out.append((v, w, run[0] * seconds, (run[-1] + 1) * seconds, len(run), round(min(slots[x] for x in run), 6)))
    return sorted(out)


def found_encounters(df, *args, **how):
    out = encounters(df, *args, **how).withColumns({c: F.unix_timestamp(F.col(c).cast("timestamp")) for c in ("start", "end")})
    return sorted((r.mmsi_a, r.mmsi_b, r.start, r.end, r.slots, round(r.min_km, 6)) for r in out.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "MMSI bigint, t bigint, LAT double, LON double").withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))


@pytest.mark.parametrize("centre", [(54.0, 18.0), (0.0, 179.999), (89.99, 0.0), (-89.999, 120.0)])
@pytest.mark.parametrize("block", [500, 3])
def test_encounters_equal_brute_force(spark, centre, block):
    rng = random.Random(int(centre[0]) + block)
    rows = []
    for v in range(25):
        for _ in range(12):
            lat, lon = centre[0] + rng.uniform(-0.02, 0.02), centre[1] + rng.uniform(-0.02, 0.02)
            rows.append((v, START + rng.randrange(0, 6000), max(-90.0, min(90.0, lat)), lon - 360 if lon > 180 else lon))
    rows += [rows[0], (None, START, *centre), (99, None, *centre), (98, START, None, 1.0), (97, START, float("nan"), 1.0)]
    want = brute_encounters(rows, 1.2, 600)
    assert found_encounters(frame(spark, rows), 1.2, 10, block=block) == want and len(want) > 20
    assert len(FORWARD) == 13 and not {tuple(-x for x in s) for s in FORWARD} & set(FORWARD)


def test_encounters_of_none_and_errors(spark):
    df = frame(spark, [(1, START, 1.0, 1.0)])
    assert encounters(df).collect() == [] and encounters(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        encounters(df, km=0)
    with pytest.raises(ValueError):
        encounters(df.drop("LAT"))


@pytest.mark.parametrize("block", [100_000, 40])
def test_encounters_of_many_spans_are_whole(spark, block):
    # Runs that begin, end or go on at any span of any chunk, and vessels that stay together all the time.
    rng = random.Random(block)
    rows = [(v, START + 600 * s + rng.randrange(600), 54.0 + v % 3 * 0.009, 18.0) for v in range(9) for s in range(40) if v < 3 or rng.random() < 0.8]
    want = brute_encounters(rows, 1.2, 600)
    assert found_encounters(frame(spark, rows), 1.2, 10, block=block) == want
    assert max(w[4] for w in want) == 40 and len({w[2] // 600 % 8 for w in want}) == 8


def shuffled_rows(spark):
    """Rows written for shuffles by all jobs of the session so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_encounters_shuffle_no_pairs(spark):
    df = frame(spark, [(v, START, 54.0 + v / 1e6, 18.0) for v in range(500)])
    before = shuffled_rows(spark)
    # Of 500 vessels in one place 124,750 pairs meet.
    assert encounters(df, 1.2, 10).where("min_km >= 0").agg(F.sum("slots")).first()[0] == 124_750
    assert shuffled_rows(spark) - before < 10_000


def test_encounters_broadcast_no_positions(spark, tmp_path):
    # A small file is a table of any number of rows once it is read, and its size says what Spark would broadcast.
    frame(spark, [(v, START, 1.0, 1.0) for v in range(9)]).write.parquet(str(tmp_path / "points"))
    plan = encounters(spark.read.parquet(str(tmp_path / "points")), 1.2, 10)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "part#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_encounters_far_broadcasts_no_positions(spark):
    # The query's own joins, on a table that is small as a file: what is compared is dealt, whatever its size.
    plan = own.queries()["encounters_far"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "part#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def star(rng, x, y, r, corners):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    return [[x + math.cos(a) * r * rng.uniform(0.3, 1), y + math.sin(a) * r * rng.uniform(0.3, 1)] for a in angles]


def strictly_inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            side = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
            if side == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            odd ^= (y1 <= y < y2 and side > 0) or (y2 <= y < y1 and side < 0)
    return odd


@pytest.mark.parametrize("depth", [0, 3, 6])
def test_points_in_areas_equal_ray_casting(spark, depth):
    rng = random.Random(depth)
    areas = [(i, [star(rng, rng.uniform(0, 4), rng.uniform(50, 54), rng.choice((0.05, 0.5, 2)), rng.randint(3, 40))]) for i in range(25)]
    areas += [(50, [[[0.0, 50.0], [4.0, 50.0], [4.0, 54.0], [0.0, 54.0]], [[1.0, 51.0], [3.0, 51.0], [3.0, 53.0], [1.0, 53.0]]])]  # a hole
    areas += [(51, areas[3][1]), (52, [[[1.0, 51.0], [1.5, 51.0], [1.0, 51.5]]]), (None, areas[0][1]), (53, None)]
    points = [(i, rng.uniform(50, 54), rng.uniform(0, 4)) for i in range(400)]
    points += [(500, 50.0, 2.0), (501, 51.0, 1.25), (502, 52.0, 1.0), (503, 54.0, 4.0), (504, None, 1.0), (505, float("nan"), 1.0), (506, 51.0, 1.0), (507, 51.25, 1.25)]
    df = spark.createDataFrame(points, "id int, LAT double, LON double")
    table = spark.createDataFrame(areas, "area bigint, rings array<array<array<double>>>")
    found = points_in_areas(df, table, depth)
    assert found.columns == ["id", "LAT", "LON", "area"]
    got = sorted((r.id, r.area) for r in found.collect())
    want = []
    for area, rings in areas:
        if area is not None and rings:
            want += [(i, area) for i, lat, lon in points if lat is not None and strictly_inside(lon, lat, rings)]
    assert got == sorted(want) and len(want) > 100


def test_inner_cells_need_no_test_and_edges_are_few():
    rng = random.Random(3)
    ring = star(rng, 10, 50, 1, 300)
    cells = cover([ring], 6)
    inner, outer = [c for c in cells if c[3]], [c for c in cells if not c[3]]
    area = lambda cs: sum((360 / 2 ** c[0]) ** 2 for c in cs)
    assert inner and outer and all(not c[5] for c in inner)
    assert sum(len(c[5]) for c in outer) / len(outer) < 100 and len(cells) < 6000
    square = [[0.1, 50.1], [0.9, 50.1], [0.9, 50.9], [0.1, 50.9]]
    done = cover([square], 6)
    assert area([c for c in done if c[3]]) > 0.9 * 0.64


def test_covers_of_many_polygons_are_those_of_each(spark):
    rng = random.Random(9)
    rings = [[star(rng, rng.uniform(-170, 170), rng.uniform(-80, 80), rng.choice((0.01, 1.0)), 4)] for _ in range(1500)]
    began = time.process_time()
    together = list(_cells([_edges(r) for r in rings], 5))
    # One by one in Python they take several times as long.
    assert time.process_time() - began < 2.5
    got = sorted((int(p), *map(int, c)) for part in together for p, *c in zip(*part[:7], strict=True))
    some = range(0, 1500, 100)
    want = sorted((i, *map(int, c[:5]), len(c[5])) for i in some for c in cover(rings[i], 5))
    assert [g for g in got if g[0] % 100 == 0] == want
    # A batch is covered in parts; a hole and a polygon of more edges than a part has are in one with others.
    big = star(rng, 5, 50, 1, 2500)
    table = spark.createDataFrame([(1, rings[0]), (2, [big]), (3, [*rings[1], rings[1][0][:3]])], "area bigint, rings array<array<array<double>>>")
    counts = {r.area: r["count"] for r in covers(table.coalesce(1), 3).groupBy("area").count().collect()}
    assert counts == {1: len(cover(rings[0], 3)), 2: len(cover([big], 3)), 3: len(cover([*rings[1], rings[1][0][:3]], 3))}


def test_areas_test_few_edges_in_compiled_code(spark):
    df = spark.createDataFrame([(1.0, 1.0)], "LAT double, LON double")
    few = [(1, [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.5, 1.0]]])]
    rng = random.Random(4)
    for areas, walked in ((few, False), ([*few, (2, [star(rng, 1, 1, 1, 400)])], True)):
        found = points_in_areas(df, spark.createDataFrame(areas, "area bigint, rings array<array<array<double>>>"))
        done = found._jdf.queryExecution()
        # Spark walks lists of edges without generated code: only those of the cells that have many.
        assert ("aggregate(edges" in done.executedPlan().toString()) == walked
        assert sorted(r.area for r in found.collect()) == [a for a, rings in areas if strictly_inside(1.0, 1.0, rings)]
    df = points_in_areas(df, spark.createDataFrame(few, "area bigint, rings array<array<array<double>>>"))
    df.collect()
    text = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    sizes = list(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text)))
    # Longer methods the JVM doesn't compile.
    assert sizes and max(sizes) < 8000


def test_areas_broadcast_no_points(spark, tmp_path):
    spark.createDataFrame([(1.0, 1.0)], "LAT double, LON double").write.parquet(str(tmp_path / "points"))
    table = spark.createDataFrame([(1, [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0]]])], "area bigint, rings array<array<array<double>>>")
    plan = points_in_areas(spark.read.parquet(str(tmp_path / "points")), table)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_areas_plan_has_no_pairs_of_all(spark):
    df = spark.createDataFrame([(1.0, 1.0)], "LAT double, LON double")
    table = spark.createDataFrame([(1, [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0]]])], "area bigint, rings array<array<array<double>>>")
    plan = points_in_areas(df, table)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert points_in_areas(df, table.limit(0)).collect() == [] and covers(table.limit(0)).collect() == []
    with pytest.raises(ValueError):
        points_in_areas(df.drop("LAT"), table)


def hot_vessel(spark, n=6000):
    """Half of all rows are one vessel's, ten seconds apart over most of a day."""
    rng = random.Random(2)
    rows = []
    for i in range(n):
        rows.append((1, START + 10 * i, rng.choice((0.0, 0.1, 0.2, 4.0, None)) if i // 400 % 2 else 0.1, rng.choice((10.0, 60.0, None)), rng.choice((3.0, 3.5)), 54 + i / n, 18.0))
        rows.append((rng.randint(2, 200), START + rng.randrange(60_000), rng.choice((0.0, 5.0)), rng.choice((10.0, 60.0, None)), 3.0, 54.0 + rng.random(), 18 + rng.random()))
    rows += [(1, None, 1.0, 1.0, 1.0, 54.0, 18.0), (None, START, 1.0, 1.0, 1.0, 54.0, 18.0)]
    df = spark.createDataFrame(rows, "MMSI bigint, t bigint, SOG double, COG double, Draft double, LAT double, LON double")
    return df.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).drop("t")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("unit", ["day", "hour", "minute"])
def test_split_tracks_give_the_same(spark, unit):
    df = hot_vessel(spark, 1500)
    assert rows_of(detect_events(df, stop_min=2, split=unit)) == rows_of(detect_events(df, stop_min=2))
    round_sums = {"avg_sog": F.round("avg_sog", 9)}
    for mode in ("lazy", "eager"):
        timed = df.where("ts is not null")
        assert rows_of(compute_stats(timed, mode=mode, split=unit).withColumns(round_sums)) == rows_of(compute_stats(timed, mode=mode).withColumns(round_sums))


def test_split_tracks_spread_a_hot_vessel(spark):
    """The largest share that one task of the window gets, by the key that deals it."""
    df = hot_vessel(spark)
    tasks = 8
    by_vessel = df.groupBy(F.pmod(F.hash("MMSI"), F.lit(tasks))).count()
    by_span = df.where("MMSI is not null and ts is not null").groupBy(F.pmod(F.hash(F.col("MMSI"), F.date_trunc("minute", "ts")), F.lit(tasks))).count()
    most = lambda c: max(r["count"] for r in c.collect()) / (df.count() / tasks)
    assert most(by_vessel) > 4 and most(by_span) < 2
    plan = detect_events(df, split="minute")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    windows = [line for line in plan.splitlines() if "Window [" in line and "lag(ts" in line]
    assert windows and all("__hour" in line for line in windows)
