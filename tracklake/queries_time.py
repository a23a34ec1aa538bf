"""Queries on streams in event time and on joins by time, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions.parsing import with_timestamp
from tracklake.operators.asof import asof_join
from tracklake.operators.sketches import daily_sketches, estimates, merged
from tracklake.operators.trips import resample, trips
from tracklake.scratch import scratch
from tracklake.streaming.ordered import detect_events_in_order
from tracklake.streaming.sources import read_csv_stream, use_rocksdb
from tracklake.streaming.windows import sessions_stream, windows_stream

Query = Callable[[SparkSession, str], DataFrame]

#: Rows of one file of a shuffled stream, at most so many on average, and files at least.
FILE_ROWS, FEWEST_FILES = 250_000, 4
#: What one task of a stream reads at most, beside a file's opening cost: one or two such files.
READ_AT_ONCE = "16m"
#: Its single row, long after all others, lets the watermark pass them.
LAST_VESSEL, LAST_TIME = -1, "2100-01-01"


def run_through(stream: DataFrame, base: str) -> DataFrame:
    """What a stream gives until its source is read, as a table.

    The session uses the RocksDB state store meanwhile, and no task reads more
    than ``READ_AT_ONCE``: what a task groups before the shuffle is then bounded.
    """
    spark = stream.sparkSession
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.files.maxPartitionBytes")
    before = {name: spark.conf.get(name) for name in names}
    use_rocksdb(spark)
    spark.conf.set(names[1], READ_AT_ONCE)
    try:
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
        query.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _shuffled(spark: SparkSession, points: DataFrame, base: str) -> DataFrame:
    """The points as a stream of files in which no order is left, half of them in each of two batches, and a last row.

    Files grow in number with the points, not in size: each is sorted and written by one task.
    """
    v = points.select("MMSI", "ts", "COG", "SOG", "Draft")
    files = max(FEWEST_FILES, -(-v.count() // FILE_ROWS))
    v.repartition(files, F.xxhash64("ts")).sortWithinPartitions(F.xxhash64("ts", "MMSI")).write.parquet(f"{base}/in")
    last = spark.range(1).select(*(F.lit(x).cast(v.schema[c].dataType).alias(c) for c, x in zip(v.columns, (LAST_VESSEL, LAST_TIME, None, None, None), strict=True)))
    last.write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(v.schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(f"{base}/in")


def _in_order(valid: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = scratch(spark, "in-order")
        return run_through(detect_events_in_order(_shuffled(spark, valid(spark, sf_dir), base), lateness="3650 days"), base)

    return run


def _in_order_quiet(valid: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = scratch(spark, "in-order-quiet")
        stream = detect_events_in_order(_shuffled(spark, valid(spark, sf_dir), base), lateness="3650 days", quiet_min=480)
        return run_through(stream, base).where("type in ('stop', 'gap')").select("type", "MMSI", "ts", "duration_min", "gap_s")

    return run


def _quiet_sql(view: str) -> str:
    """Stops that end by a rise of speed, or with the last row before eight hours of silence; gaps within a stretch."""
    return f"""with {view},
    r as (select MMSI, datesub('millisecond', timestamp '1970-01-01', ts) as ms, SOG from p),
    s as (select *, case when ms - lag(ms) over w < 28800000 then 0 else 1 end as fresh, ms - lag(ms) over w as dt from r window w as (partition by MMSI order by ms)),
    t as (select *, sum(fresh) over (partition by MMSI order by ms) as stretch from s),
    u as (select *, sum(case when SOG >= 0.5 then 1 else 0 end) over (partition by MMSI, stretch order by ms rows unbounded preceding) as rises, lead(ms) over (partition by MMSI, stretch order by ms) as nxt from t),
    -- a stop: rows below the limit between two rises; it ends at the rise, or with the stretch's last row
    stops as (
      select MMSI, stretch, rises, min(ms) filter (where SOG < 0.5) as t1, max(ms) as last_ms, max(nxt) as rise from u group by all having count(*) filter (where SOG < 0.5) > 0)
    select 'stop' as type, MMSI, coalesce(rise, last_ms) as ts, ((coalesce(rise, last_ms) - t1 + 300) // 600) / 100.0::double as duration_min, null::bigint as gap_s
    from stops where coalesce(rise, last_ms) - t1 >= 900000
    union all select 'gap', MMSI, ms, null, (dt // 1000)::bigint from s where fresh = 0 and dt > 600000"""


def _sessions(valid: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = scratch(spark, "sessions")
        out = run_through(sessions_stream(_shuffled(spark, valid(spark, sf_dir), base), "3 hours", lateness="3650 days"), base)
        times = {c: F.col(c).cast("timestamp_ntz") for c in ("start", "end", "first_time", "last_time")}
        return out.withColumns(times | {"avg_sog": F.round("avg_sog", 6)})

    return run


def _windows(valid: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = scratch(spark, "windows")
        out = run_through(windows_stream(_shuffled(spark, valid(spark, sf_dir), base), "6 hours", "2 hours", lateness="3650 days"), base)
        times = {c: F.col(c).cast("timestamp_ntz") for c in ("start", "end", "first_time", "last_time")}
        return out.withColumns(times | {"avg_sog": F.round("avg_sog", 6)})

    return run


def _late_file(points: Query) -> Query:
    """A stream of CSV files that another file, of other columns and separator, joins after a stop."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base, v = scratch(spark, "late-file"), points(spark, sf_dir)
        text = v.select("event_id", "MMSI", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("BaseDateTime"), "SOG", "COG")
        text.where("event_id % 3 > 0").write.option("header", True).csv(f"{base}/in/a")
        stream = read_csv_stream(spark, f"{base}/in", "*/*.csv")
        kinds = {"event_id": "bigint", "MMSI": "bigint", "SOG": "double", "COG": "double"}
        rows = with_timestamp(stream).select("ts", *(F.col(c).try_cast(k).alias(c) for c, k in kinds.items()))
        run_through(rows, base)
        turned = text.where("event_id % 3 = 0").select("COG", F.col("SOG").alias("speed over ground"), F.lit("x").alias("note"), "event_id", F.col("MMSI").alias("mmsi"), F.col("BaseDateTime").alias("Time"))
        turned.write.option("header", True).option("sep", "|").csv(f"{base}/in/b")
        return run_through(rows, base)

    return run


# -- as-of joins


def _asof(valid: Query, **how: object) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = valid(spark, sf_dir)
        left = v.where("event_type = 'click'").select("event_id", "MMSI", "ts", "LAT")
        right = v.where("event_type <> 'click'").select("event_id", "MMSI", "ts", "SOG")
        return asof_join(left, right, ties=("event_id",), **how)

    return run


def _asof_sql(view: str, tolerance_s: int | None = None) -> str:
    fits = "true" if tolerance_s is None else f"datesub('microsecond', r.ts, l.ts) <= {tolerance_s * 1_000_000}"
    value = lambda c, n: f"case when {fits} then r.{c} end as {n}"
    return f"""with {view},
    r as (select MMSI, ts, max(event_id) as event_id, arg_max(SOG, event_id) as SOG from p where event_type <> 'click' group by all)
    select l.event_id, l.MMSI, l.ts, l.LAT, {value("event_id", "event_id_right")}, {value("ts", "ts_right")}, {value("SOG", "SOG")}
    from (select * from p where event_type = 'click') l asof left join r on l.MMSI = r.MMSI and l.ts >= r.ts"""


# -- trips, regular times, sketches


def _trips(valid: Query) -> Query:
    return lambda s, d: trips(valid(s, d), gap_min=240).withColumns({c: F.round(c, 6) for c in ("distance_km", "avg_sog")})


def _trips_sql(view: str, hav: Callable[[str, str, str, str], str]) -> str:
    return f"""with {view},
    s as (
      select *, coalesce(datesub('millisecond', lag(ts) over w, ts) > 240 * 60000, true) as begins, {hav("lag(LAT) over w", "lag(LON) over w", "LAT", "LON")} as km
      from p window w as (partition by MMSI order by ts, event_id)),
    t as (select *, sum(begins::int) over (partition by MMSI order by ts, event_id rows unbounded preceding) as trip from s)
    select MMSI, trip, min(ts) as start, max(ts) as "end", count(*) as points, round(sum(case when begins then 0 else km end), 6) as distance_km, round(avg(SOG), 6) as avg_sog
    from t group by MMSI, trip"""


def _resampled(valid: Query) -> Query:
    return lambda s, d: resample(valid(s, d), step_s=900, max_gap_s=3 * 3600).withColumns({c: F.round(c, 6) for c in ("LAT", "LON", "SOG")})


def _resampled_sql(view: str) -> str:
    """By way of vectors: the point between is the sum of both, weighed by sines."""
    return f"""with {view},
    s as (select MMSI, datesub('millisecond', timestamp '1970-01-01', ts) as ms, LAT, LON, SOG from p qualify row_number() over (partition by MMSI, ts order by event_id desc) = 1),
    n as (select *, lead(ms) over w as ms2, lead(LAT) over w as lat2, lead(LON) over w as lon2, lead(SOG) over w as sog2 from s window w as (partition by MMSI order by ms)),
    g as (
      select *, unnest(range(((ms + 899999) // 900000) * 900000, ms2, 900000)) as tick from n where ms2 - ms <= 10800000
      union all select *, ms as tick from n where ms % 900000 = 0 and (ms2 is null or ms2 - ms > 10800000)),
    f as (
      select *, case when ms2 is null then 0.0 else (tick - ms) / (ms2 - ms) end as f,
        acos(greatest(-1, least(1, sin(radians(LAT)) * sin(radians(lat2)) + cos(radians(LAT)) * cos(radians(lat2)) * cos(radians(lon2 - LON))))) as w from g),
    xyz as (
      select *, sin((1 - f) * w) * cos(radians(LAT)) * cos(radians(LON)) + sin(f * w) * cos(radians(lat2)) * cos(radians(lon2)) as x,
        sin((1 - f) * w) * cos(radians(LAT)) * sin(radians(LON)) + sin(f * w) * cos(radians(lat2)) * sin(radians(lon2)) as y,
        sin((1 - f) * w) * sin(radians(LAT)) + sin(f * w) * sin(radians(lat2)) as z from f)
    select MMSI, timestamp '1970-01-01' + to_milliseconds(tick) as ts, round(case when tick = ms then LAT else degrees(atan2(z, sqrt(x * x + y * y))) end, 6) as LAT,
      round(case when tick = ms then LON else degrees(atan2(y, x)) end, 6) as LON, round(case when tick = ms then SOG else SOG + (sog2 - SOG) * f end, 6) as SOG
    from xyz"""


def _weeks(valid: Query) -> Query:
    """Sketches by cell and day, stored, and merged to weeks: within their bounds of the exact numbers, which are beside them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v, path = valid(spark, sf_dir), scratch(spark, "sketches")
        daily_sketches(v, 2).write.parquet(path)
        week = F.date_trunc("week", F.col("day")).cast("date").alias("week")
        rolled = estimates(merged(spark.read.parquet(path), week), (0.5, 0.9))
        own = F.date_trunc("week", F.col("ts")).cast("date").alias("week")
        exact = v.groupBy(own).agg(F.count_distinct("MMSI").alias("exact"), F.count("SOG").alias("n"))
        # A quantile is within its bound if its rank is: the share of the speeds that don't exceed it.
        ranked = v.join(rolled.select("week", "sog_p50", "sog_p90"), own == F.col("week")).groupBy("week").agg(
            *(F.avg((F.col("SOG") <= F.col(f"sog_p{q}")).cast("double")).alias(f"rank_{q}") for q in (50, 90))
        )
        found = rolled.join(exact, "week").join(ranked, "week")
        close = lambda q: F.abs(F.col(f"rank_{q}") - q / 100) <= 0.015 + 1 / F.col("n")
        return found.select(
            "week", "points", F.col("exact").alias("vessels"), (F.abs(F.col("vessels") - F.col("exact")) <= 0.03 * F.col("exact")).alias("vessels_close"),
            close(50).alias("p50_close"), close(90).alias("p90_close"),
        )

    return run


def catalogue(valid: Query, points: Query, view: str, online_sql: str, hav: Callable[[str, str, str, str], str]) -> dict[str, tuple[Query, str | None]]:
    sums = "count(*) as points, min(ts) as first_time, max(ts) as last_time, round(avg(SOG), 6) as avg_sog, max(SOG) as max_sog"
    return {
        "online_events_in_order": (_in_order(valid), online_sql),
        "online_events_in_order_quiet": (_in_order_quiet(valid), _quiet_sql(view)),
        "sessions_stream": (
            _sessions(valid),
            f"""with {view}, s as (select *, case when ts - lag(ts) over w <= interval 3 hours then 0 else 1 end as fresh from p window w as (partition by MMSI order by ts)),
            t as (select *, sum(fresh) over (partition by MMSI order by ts) as island from s)
            select MMSI, min(ts) as start, max(ts) + interval 3 hours as "end", {sums} from t group by MMSI, island""",
        ),
        "windows_stream": (
            _windows(valid),
            f"""with {view}, w as (select *, unnest(range(3)) as k from p), b as (select *, time_bucket(interval 2 hours, ts, timestamp '1970-01-01') - k * interval 2 hours as start from w)
            select MMSI, start, start + interval 6 hours as "end", {sums} from b group by MMSI, start""",
        ),
        "csv_stream_late_file": (_late_file(points), f"with {view} select ts, event_id, MMSI, SOG, COG from v"),
        "trips": (_trips(valid), _trips_sql(view, hav)),
        "resample": (_resampled(valid), _resampled_sql(view)),
        "sketches_by_week": (
            _weeks(valid),
            f"with {view} select date_trunc('week', ts)::date as week, count(*) as points, count(distinct MMSI) as vessels, true as vessels_close, true as p50_close, true as p90_close from p group by 1",
        ),
        "asof_join": (_asof(valid), _asof_sql(view)),
        "asof_join_by_day": (_asof(valid, bucket="day"), _asof_sql(view)),
        "asof_join_tolerance": (_asof(valid, tolerance_s=3600), _asof_sql(view, 3600)),
    }
