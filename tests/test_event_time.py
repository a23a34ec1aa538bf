"""Streams in event time: order, timers, what the state keeps, windows and late rows; and the as-of join."""

import bisect
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracklake import queries_time
from tracklake.operators.asof import asof_join
from tracklake.streaming import ordered, process_stream
from tracklake.streaming.online import Thresholds
from tracklake.streaming.ordered import detect_events_in_order
from tracklake.streaming.sources import use_rocksdb
from tracklake.streaming.windows import late_rows, sessions_stream, windows_stream

MINUTE = 60_000


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


SCHEMA = "MMSI bigint, ts timestamp, SOG double, COG double, Draft double"


class Feed:
    """Batches put into a folder one by one, each read by a run of the same query."""

    def __init__(self, spark, tmp_path, make):
        self.spark, self.path, self.made = spark, tmp_path, 0
        (tmp_path / "in").mkdir()
        self.frame = make(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))

    def batch(self, rows):
        df = self.spark.createDataFrame([(m, ms / 1000, sog, cog, draft) for m, ms, sog, cog, draft in rows], SCHEMA.replace("timestamp", "double"))
        df.withColumn("ts", F.timestamp_millis((F.col("ts") * 1000).cast("bigint"))).coalesce(1).write.mode("append").parquet(str(self.path / "in"))
        found = []
        writer = self.frame.writeStream.outputMode("append").foreachBatch(lambda out, n: found.extend(out.collect()))
        query = writer.option("checkpointLocation", str(self.path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        self.query = query
        self.state = [sum(o.numRowsTotal for o in p.stateOperators) for p in query.recentProgress][-1]
        return found


def plain(events):
    return sorted(tuple(e.get(k) if isinstance(e, dict) else e[k] for k in ("type", "MMSI", "ts", "delta_deg", "duration_min", "delta_m", "gap_s")) for e in events)


def test_shuffled_rows_give_the_events_of_sorted_ones(spark, tmp_path, rocksdb):
    rng = random.Random(5)
    rows = []
    for vessel in (1, 2, 3):
        ms = 1_700_000_000_000
        for _ in range(80):
            ms += rng.choice((1, 4, 20)) * MINUTE
            rows.append((vessel, ms, rng.choice((0.0, 0.2, 6.0, None)), rng.choice((10.0, 50.0, None)), rng.choice((5.0, 5.5, None))))
    want = plain(process_stream([{"MMSI": m, "ts": ms, "SOG": s, "COG": c, "Draft": d} for m, ms, s, c, d in sorted(rows, key=lambda r: r[:2])]))
    arriving = sorted(rows, key=lambda r: r[1] + rng.uniform(-60, 60) * MINUTE)
    feed = Feed(spark, tmp_path, lambda df: detect_events_in_order(df, lateness="150 minutes"))
    got, waiting = [], []
    for at in range(0, len(arriving), 60):
        got += feed.batch(arriving[at : at + 60])
        waiting.append(feed.state)
    got += feed.batch([(9, max(r[1] for r in rows) + 10**9, 5.0, 0.0, 5.0)])
    assert plain(got) == want and len({e[0] for e in want}) == 4
    # What stays: four vessels' values and one row that waits, and its timer.
    assert feed.state < min(waiting) and feed.state <= 10
    late = feed.batch([(1, 1_700_000_000_000, 5.0, 200.0, 9.0)])
    assert late == [] and late_rows(feed.query) == 1


def test_silent_vessels_end_their_stops_and_leave(spark, tmp_path, rocksdb):
    start = 1_700_000_000_000
    feed = Feed(spark, tmp_path, lambda df: detect_events_in_order(df, lateness="10 minutes", quiet_min=60))
    rows = [(1, start + i * 10 * MINUTE, 0.1, 5.0, 3.0) for i in range(4)] + [(2, start, 9.0, 5.0, 3.0)]
    assert feed.batch(rows) == []
    found = feed.batch([(3, start + 300 * MINUTE, 4.0, 5.0, 3.0)])
    assert plain(found) == [("stop", 1, start + 30 * MINUTE, None, 30.0, None, None)]
    before = feed.state
    # Vessel 1 is new again: no gap, no turn; vessel 3 waits.
    assert feed.batch([(1, start + 301 * MINUTE, 4.0, 170.0, 8.0)]) == []
    assert feed.batch([(4, start + 900 * MINUTE, 4.0, 5.0, 3.0)]) == [] and feed.state <= before + 1


class Kept:
    """A state, and the calls to it, each of which is a message to the JVM."""

    def __init__(self):
        self.values, self.calls, self.timers = {"vessel": None, "waiting": []}, [], []

    def variable(self, name, schema):
        def call(kind, act):
            return lambda *a: self.calls.append((name, kind)) or act(*a)

        held = self.values
        return SimpleNamespace(
            get=call("get", lambda: iter(list(held[name])) if name == "waiting" else held[name]),
            exists=call("exists", lambda: bool(held[name])),
            appendList=call("appendList", lambda v: held[name].extend(v)),
            put=call("put", lambda v: held.update({name: list(v)})),
            update=call("update", lambda v: held.update({name: v})),
            clear=call("clear", lambda: held.update({name: [] if name == "waiting" else None})),
        )

    getValueState = getListState = variable  # noqa: N815

    def registerTimer(self, ms):  # noqa: N802
        self.timers.append(ms)


def test_ordered_rows_wait_packed_and_a_timer_without_rows_costs_one_call(monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 100)
    kept, nan = Kept(), float("nan")
    detector = ordered._Ordered(Thresholds(), None)
    detector.init(kept)
    rows = [(1_700_000_000_000 + i * 20 * MINUTE, 45.0 * (i % 8) if i % 3 else nan, (0.0, 9.0)[i % 2], nan if i % 5 else 4.0 + i % 7) for i in range(250)]
    for some in (rows[1::2], rows[::2]):
        detector.handleInputRows((7,), iter([pd.DataFrame(some, columns=["ms", "COG", "SOG", "Draft"])]), None)
    assert len(kept.values["waiting"]) == 4 and len(kept.timers) == 2
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: rows[199][0])
    got = [e for f in detector.handleExpiredTimer((7,), now, None) for e in f.astype(object).where(f.notna(), None).to_dict("records")]
    kept.calls.clear()
    assert not list(detector.handleExpiredTimer((7,), now, None)) and kept.calls == [("waiting", "get")]
    assert kept.timers[-1] == rows[200][0]
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: rows[-1][0])
    got += [e for f in detector.handleExpiredTimer((7,), now, None) for e in f.astype(object).where(f.notna(), None).to_dict("records")]
    want = plain(process_stream([{"MMSI": 7, "ts": ms, "COG": c, "SOG": s, "Draft": d} for ms, c, s, d in rows]))
    key = lambda e: tuple((v is not None, v or 0) for v in e[1:])
    assert sorted(plain_of(got), key=key) == sorted(want, key=key) and kept.values["waiting"] == []


def plain_of(events):
    return [tuple(e[k] for k in ("type", "MMSI", "ts", "delta_deg", "duration_min", "delta_m", "gap_s")) for e in events]


def through(quiet_ms, key, rows, batches):
    """Events and calls of one key whose rows come in batches, each with the watermark after it; timers fire as Spark's do."""
    kept, out = Kept(), []
    detector = ordered._Ordered(Thresholds(), quiet_ms)
    detector.init(kept)
    for at, watermark in batches:
        some = [r for r in rows if r[5] == at]
        if some:
            detector.handleInputRows(key, iter([pd.DataFrame([r[:5] for r in some], columns=["MMSI", "ms", "COG", "SOG", "Draft"])]), None)
        fired = {ms for ms in kept.timers if ms <= watermark}
        kept.timers = [ms for ms in kept.timers if ms > watermark]
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda w=watermark: w)
        for _ in sorted(fired):
            for frame in detector.handleExpiredTimer(key, now, None):
                out += plain_of(frame.astype(object).where(frame.notna(), None).to_dict("records"))
    return sorted(out, key=str), kept


@pytest.mark.parametrize("quiet_ms", [None, 60 * MINUTE])
def test_vessels_of_a_part_share_its_calls_and_give_the_events_they_give_alone(monkeypatch, quiet_ms):
    monkeypatch.setattr(ordered, "FRAME_EVENTS", 7)
    rng, start = random.Random(3), 1_700_000_000_000
    rows = []
    for vessel in range(60):
        ms = start
        for _ in range(rng.randrange(1, 40)):
            ms += rng.choice((0, 1, 9, 20, 90)) * MINUTE
            at = min(max(0, (ms - start) // (200 * MINUTE) + rng.choice((0, 0, 1))), 4)
            rows.append((vessel, ms, rng.choice((10.0, 50.0, None)), rng.choice((0.0, 0.2, 6.0, None)), rng.choice((5.0, 5.5, None)), at))
    rng.shuffle(rows)
    # A row comes at most 200 minutes after the watermark could pass it.
    batches = [(at, start + (at - 1) * 200 * MINUTE - 1) for at in range(5)] + [(5, start + 10**10)]
    got, kept = through(quiet_ms, (0,), rows, batches)
    want, alone = [], 0
    for vessel in range(60):
        events, one = through(quiet_ms, (0,), [r for r in rows if r[0] == vessel], batches)
        want, alone = want + events, alone + len(one.calls)
    assert got == sorted(want, key=str) and {e[0] for e in got} == {"gap", "sharp_turn", "stop", "draft_change"}
    assert len(kept.calls) < 60 < alone / 4 and kept.values["waiting"] == []
    if quiet_ms is None:
        known = lambda v: (v is not None, v or 0.0)
        ordered_rows = sorted(rows, key=lambda r: (r[0], r[1], *map(known, r[2:5])))
        assert got == sorted(plain(process_stream([dict(zip(("MMSI", "ts", "COG", "SOG", "Draft"), r[:5], strict=True)) for r in ordered_rows])), key=str)
    else:
        assert kept.values["vessel"] is None and not kept.timers


def test_vessels_are_dealt_to_few_keys(spark, tmp_path, rocksdb):
    start = 1_700_000_000_000
    feed = Feed(spark, tmp_path, lambda df: detect_events_in_order(df, lateness="10 minutes", parts=2))
    rows = [(v, start + i * 20 * MINUTE, 5.0, 10.0 + 60 * i, 3.0) for v in range(50) for i in range(2)]
    assert feed.batch(rows) == []
    # Two values of rows that wait, and a few numbers for each timer.
    assert feed.state <= 10
    found = feed.batch([(99, start + 900 * MINUTE, 4.0, 5.0, 3.0)])
    assert sorted((e["type"], e["MMSI"]) for e in found) == sorted((kind, v) for v in range(50) for kind in ("gap", "sharp_turn"))


def test_sessions_and_late_rows(spark, tmp_path):
    start = 1_700_000_000_000
    feed = Feed(spark, tmp_path, lambda df: sessions_stream(df, "30 minutes", "1 hour"))
    row = lambda m, minute, sog=2.0: (m, start + minute * MINUTE, sog, None, None)
    assert feed.batch([row(1, 40), row(1, 0, 4.0), row(1, 20), row(2, 5, None), row(1, 200), (None, start, 1.0, None, None)]) != []
    rows = feed.batch([row(1, 25)]) + feed.batch([row(5, 500)])
    assert late_rows(feed.query) == 0
    assert [(r.MMSI, r.points, r.avg_sog) for r in rows] == [(1, 1, 2.0)]
    assert feed.batch([row(1, 210)]) == [] and late_rows(feed.query) == 1


def test_sliding_windows(spark, tmp_path):
    start = 1_700_006_400_000  # a whole hour
    feed = Feed(spark, tmp_path, lambda df: windows_stream(df, "1 hour", "30 minutes", "10 minutes", by_vessel=False))
    rows = feed.batch([(1, start + 5 * MINUTE, 2.0, None, None), (2, start + 35 * MINUTE, 4.0, None, None), (2, start + 40 * MINUTE, None, None, None)])
    rows += feed.batch([(3, start + 600 * MINUTE, 1.0, None, None)])
    assert sorted((int(r.start.timestamp() * 1000) - start, r.points, r.vessels, r.avg_sog) for r in rows) == [(-30 * MINUTE, 1, 1, 2.0), (0, 3, 2, 3.0), (30 * MINUTE, 2, 1, 4.0)]


def test_files_of_the_shuffled_stream_grow_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries_time, "FILE_ROWS", 500)
    spark.range(8000).selectExpr("id % 7 as MMSI", "timestamp_millis(id * 60000) as ts", "1D as COG", "2D as SOG", "3D as Draft").write.parquet(str(tmp_path / "points"))
    stream = queries_time._shuffled(spark, spark.read.parquet(str(tmp_path / "points")), str(tmp_path))
    rows = [r.n for r in spark.read.parquet(str(tmp_path / "in")).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(rows) == 8001 and len(rows) == 17 and max(rows) < 1000
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    out = queries_time.run_through(windows_stream(stream, "6 hours", "6 hours", lateness="3650 days"), str(tmp_path))
    assert out.where("MMSI >= 0").agg(F.sum("points")).first()[0] == 8000
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


@pytest.mark.parametrize("bucket", [None, "day", "hour"])
def test_asof_join(spark, bucket):
    rng = random.Random(1)
    base = 1_700_000_000
    left = [(rng.choice((1, 1, 1, 1, 2, 3, None)), base + rng.randrange(0, 5 * 86_400, 60), i) for i in range(300)] + [(1, None, 300), (None, None, 301)]
    right = [(rng.choice((1, 1, 1, 2, 9, None)), base + rng.randrange(-86_400, 6 * 86_400, 60), rng.choice((None, 5, 7)), i) for i in range(200)]
    right += [(1, base + 60, 8, 1000), (1, base + 60, 9, 1001), (1, None, 1, 1002)]
    lf = spark.createDataFrame(left, "MMSI bigint, ts bigint, n int").withColumn("ts", F.timestamp_seconds("ts"))
    rf = spark.createDataFrame(right, "MMSI bigint, ts bigint, depth int, n int").withColumn("ts", F.timestamp_seconds("ts"))
    for tolerance in (None, 7200):
        df = asof_join(lf, rf, tolerance_s=tolerance, ties=("n",), bucket=bucket)
        assert df.columns == ["MMSI", "ts", "n", "ts_right", "depth", "n_right"]
        want = []
        for m, ts, n in left:
            options = sorted((t, k, d) for rm, t, d, k in right if rm == m is not None and t is not None)
            at = bisect.bisect_right(options, (ts, 10**9, 0)) if ts is not None and m is not None else 0
            t, k, d = options[at - 1] if at else (None, None, None)
            want.append((n, *((t, d, k) if t is not None and (tolerance is None or ts - t <= tolerance) else (None, None, None))))
        got = [(r.n, r.ts_right and int(r.ts_right.timestamp()), r.depth, r.n_right) for r in df.collect()]
        assert sorted(got) == sorted(want)


def test_asof_join_plan_and_errors(spark):
    df = spark.sql("select 1L as MMSI, timestamp'2024-01-01' as ts, 2 as v")
    plan = asof_join(df, df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert asof_join(df, df).first().v_right == 2 and asof_join(df, df.limit(0)).first().v_right is None
    with pytest.raises(ValueError):
        asof_join(df.drop("ts"), df)
    with pytest.raises(ValueError):
        asof_join(df.withColumn("v_right", F.lit(1)), df)
