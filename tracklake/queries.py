"""The driver's queries over an AIS-shaped view of ``events``, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake import queries_space, queries_time
from tracklake.dataset import TrackDataset, valid_geo
from tracklake.functions import angle_diff_deg, epoch_ms, haversine_km
from tracklake.functions.parsing import with_timestamp
from tracklake.operators.events import detect_events
from tracklake.operators.spatial import geofence, grid_features
from tracklake.operators.stats import compute_stats, row_and_vessel_counts, timing_summary
from tracklake.plans.tracks import carried_forward, track_window
from tracklake.schema import existing_columns, normalize_columns
from tracklake.scratch import scratch
from tracklake.sources.files import scan_many, scan_parquet
from tracklake.sources.sinks import write_partitioned, write_table
from tracklake.streaming import detect_events_stream
from tracklake.streaming.sources import event_json, read_csv_stream, use_rocksdb

Query = Callable[[SparkSession, str], DataFrame]

START, END = "2024-01-05", "2024-01-20T12:00:00"
VESSELS = (1, 2, 3, 5, 8, 13)
RECTANGLE = [(18.25, 54.25), (18.75, 54.25), (18.75, 54.75), (18.25, 54.75)]
#: Not convex, with a hole.
POLYGON = [
    [(18.1, 54.1), (18.9, 54.1), (18.9, 54.9), (18.5, 54.5), (18.1, 54.9)],
    [(18.4, 54.2), (18.6, 54.2), (18.6, 54.4), (18.4, 54.4)],
]


# -- the view


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id")
    draft = 5.0 + F.regexp_extract("props", "([0-9]+)", 1).try_cast("bigint") % 10 / 10.0
    return e.select(
        F.col("user_id").alias("MMSI"), "ts", "event_id", "event_type",
        F.when(n % 97 == 0, 91.0).otherwise(54.0 + (n * 37) % 1000 / 1000.0).alias("LAT"),
        (18.0 + (n * 53) % 1000 / 1000.0).alias("LON"),
        (F.col("value") / 50.0).alias("SOG"),
        F.when(F.col("event_type") == "error", None).otherwise((n * 47) % 3600 / 10.0).alias("COG"),
        F.when(F.col("event_type") == "view", None).otherwise(draft).alias("Draft"),
    )


VIEW = """v as (
  select user_id as MMSI, ts, event_id, event_type,
    case when event_id % 97 = 0 then 91.0::double else 54.0::double + ((event_id * 37) % 1000) / 1000.0::double end as LAT,
    18.0::double + ((event_id * 53) % 1000) / 1000.0::double as LON,
    value / 50.0::double as SOG,
    case when event_type = 'error' then null else ((event_id * 47) % 3600) / 10.0::double end as COG,
    case when event_type = 'view' then null
      else 5.0::double + (try_cast(regexp_extract(props, '([0-9]+)', 1) as bigint) % 10) / 10.0::double end as Draft
  from events),
p as (select * from v where LAT between -90 and 90 and LON between -180 and 180)"""


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where(valid_geo())


def _hav(a: str, b: str, c: str, d: str) -> str:
    h = f"pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)"
    return f"(2 * 6371.0088 * asin(sqrt(case when {h} > 1 then 1.0::double else {h} end)))"


def _turn(cur: str, prev: str) -> str:
    d = f"(radians({cur}) - radians({prev}))"
    return f"abs(degrees(atan2(sin({d}), cos({d}))))"


# -- statistics


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("avg_sog", F.round("avg_sog", 6))


def _first_rows(df: DataFrame) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("MMSI").orderBy("ts", "event_id"))
    return df.withColumn("rn", first).where("rn = 1").drop("rn")


def _stats_sql(source: str, key: bool = True, eager: bool = False) -> str:
    part = "partition by MMSI " if key else ""
    course = f"last_value(COG ignore nulls) over ({part}order by ts, event_id rows unbounded preceding)" if eager else "COG"
    group = "MMSI" if key else "1"
    single = "when points = 1 then"
    tort = "s_d / greatest(s_s, 1e-6)"
    return f"""
    with {VIEW}, src as ({source}),
    f as (select *, {course} as course from src),
    l as (
      select *, lag(LAT) over w as la, lag(LON) over w as lo, lag(course) over w as lc,
        max(case when course is null then 1 else 0 end) over (w rows unbounded preceding) as lost
      from f window w as ({part}order by ts, event_id)),
    g as (
      select {"MMSI, " if key else ""}count(*) as points, sum(coalesce({_hav("la", "lo", "LAT", "LON")}, 0)) as s_d,
        sum({"case when lost = 1 then 0 else" if eager else ""} coalesce({_turn("course", "lc")}, 0) {"end" if eager else ""}) as s_t,
        avg(SOG) as a, max(SOG) as max_sog,
        arg_min(LAT, (ts, event_id)) as la1, arg_min(LON, (ts, event_id)) as lo1,
        arg_max(LAT, (ts, event_id)) as la2, arg_max(LON, (ts, event_id)) as lo2
      from l {"group by MMSI" if key else ""}),
    h as (select *, {_hav("la1", "lo1", "la2", "lo2")} as s_s from g)
    select {"MMSI, " if key else ""}points, round(s_d, 3) as distance_km, round(s_s, 3) as straight_km,
      round({f"case {single} 1.0 else {tort} end" if eager else tort}, 3) as tortuosity,
      {"case when points = 1 then null else round(s_t, 1) end" if eager else "round(s_t, 1)"} as turn_index_deg,
      round(a, 6) as avg_sog, max_sog
    from h""".replace("group by 1", f"group by {group}")


# -- events

DEFAULTS = {"turn_deg": 30.0, "stop_sog": 0.5, "stop_min": 15.0, "draft_jump_m": 0.3, "gap_s": 600}
CUSTOM = {"turn_deg": 90.0, "stop_sog": 1.0, "stop_min": 60.0, "draft_jump_m": 0.5, "gap_s": 86_400}


def _events_sql(kinds: str = "sharp_turn stop draft_change gap", key: bool = True, **limits: float) -> str:
    """Common table expressions that end in ``ev``, written independently as islands and lags."""
    x = DEFAULTS | limits
    part = "partition by MMSI " if key else ""
    m = "MMSI" if key else "null::bigint as MMSI"
    parts = {
        "sharp_turn": f"select 'sharp_turn' as type, {m}, ts, round(turn, 3) as delta_deg, null::double as duration_min, null::double as delta_m, null::bigint as gap_s from d where turn >= {x['turn_deg']}",
        "draft_change": f"select 'draft_change', {m}, ts, null, null, round(abs(Draft - pd), 3), null from d where abs(Draft - pd) >= {x['draft_jump_m']}",
        "gap": f"select 'gap', {m}, ts, null, null, null, gs from d where gs > {x['gap_s']}",
        "stop": f"select 'stop', {m}, t2, null, ((datesub('millisecond', t1, t2) + 300) // 600) / 100.0::double, null, null from isl where n >= 2 and datesub('millisecond', t1, t2) >= {x['stop_min']} * 60000",
    }
    chosen = ["select type, MMSI, ts, delta_deg, duration_min, delta_m, gap_s from (" + parts["sharp_turn"] + ("" if "sharp_turn" in kinds else " and false") + ")"]
    chosen += [parts[k] for k in kinds.split() if k != "sharp_turn"]
    return f"""with {VIEW},
    f as (
      select *, last_value(COG ignore nulls) over w as cf, last_value(SOG ignore nulls) over w as sf,
        row_number() over (w) as rn, lag(Draft) over (w) as pd, datesub('second', lag(ts) over (w), ts) as gs
      from p window w as ({part}order by ts, event_id)),
    d as (select *, {_turn("cf", "lag(cf) over w2")} as turn from f window w2 as ({part}order by ts, event_id)),
    low as (select *, rn - row_number() over ({part}order by ts, event_id) as isle from f where sf < {x['stop_sog']}),
    isl as (select {"MMSI, " if key else ""}isle, count(*) as n, min(ts) as t1, max(ts) as t2 from low group by all),
    ev as ({" union all ".join(chosen)})"""


def _events(**limits: object) -> Query:
    return lambda spark, d: detect_events(valid(spark, d), **limits)


def _only(kind: str) -> Query:
    return lambda spark, d: detect_events(valid(spark, d)).where(F.col("type") == kind)


# -- queries on files


def _dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view written as two differing CSV dialects and read back."""
    base, v = scratch(spark, "dialects"), points(spark, sf_dir)
    text = v.select("event_id", "MMSI", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("BaseDateTime"), "LAT", "LON", "SOG", "COG", "Draft")
    lower = text.where("event_id % 2 = 0").toDF("event_id", "mmsi", "base_date_time", "latitude", "longitude", "speed_over_ground", "cog", "draught")
    lower.write.option("header", True).option("sep", ";").csv(f"{base}/a")
    text.where("event_id % 2 = 1").write.option("header", True).csv(f"{base}/b")
    read = scan_many(spark, base, "*/*.csv")
    read = with_timestamp(read)
    kinds = {"event_id": "bigint", "MMSI": "bigint", "LAT": "double", "LON": "double", "SOG": "double", "COG": "double", "Draft": "double"}
    return read.select("ts", *(F.col(c).try_cast(k).alias(c) for c, k in kinds.items()))


def _partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "partitioned")
    write_partitioned(valid(spark, sf_dir), path, "year/month/day")
    back = scan_parquet(spark, path)
    return with_timestamp(back).select("event_id", "MMSI", "ts", "LAT", "LON", *(F.col(c).cast("bigint").alias(c) for c in ("year", "month", "day")))


def _csv_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "stats") + ".csv"
    write_table(compute_stats(valid(spark, sf_dir)).select("MMSI", "points", "distance_km"), path)
    read = scan_many(spark, path, "*.csv")
    return read.select(F.col("MMSI").try_cast("bigint").alias("MMSI"), F.col("points").try_cast("bigint").alias("points"), F.col("distance_km").try_cast("double").alias("distance_km"))


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return points(spark, sf_dir).select(
        "event_id",
        F.when(n % 7 == 0, "garbage").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("BaseDateTime"),
        F.when(n % 5 == 0, F.concat(F.lit("IMO"), n.cast("string"))).otherwise(n.cast("string")).alias("IMO"),
        F.when(n % 11 == 0, "n/a").otherwise((n % 100 / 4.0).cast("string")).alias("SOG"),
    )


def _online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view in time order as files, streamed through the stateful operator into a table that is read back."""
    base, before = scratch(spark, "online"), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    v = valid(spark, sf_dir).select("MMSI", "ts", "COG", "SOG", "Draft")
    v.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(f"{base}/in")
    use_rocksdb(spark)
    try:
        events = detect_events_stream(spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 3).parquet(f"{base}/in"))
        query = events.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
        query.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(events.schema).parquet(f"{base}/out")


def _csv_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as two CSV dialects of differing column order, streamed into a table that is read back."""
    base, v = scratch(spark, "csv-stream"), points(spark, sf_dir)
    text = v.select("event_id", "MMSI", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("BaseDateTime"), "LAT", "LON", "SOG", "COG")
    turned = text.where("event_id % 2 = 0").select("COG", "SOG", "event_id", "LON", "LAT", "MMSI", F.col("BaseDateTime").alias("timestamp"))
    turned.write.option("header", True).option("sep", ";").csv(f"{base}/in/a")
    text.where("event_id % 2 = 1").write.option("header", True).csv(f"{base}/in/b")
    rows = read_csv_stream(spark, f"{base}/in", "*/*.csv")
    kinds = {"event_id": "bigint", "MMSI": "bigint", "LAT": "double", "LON": "double", "SOG": "double", "COG": "double"}
    rows = with_timestamp(rows).select("ts", *(F.col(c).try_cast(k).alias(c) for c, k in kinds.items()))
    query = rows.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
    query.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


_ONLINE_SQL = f"""with {VIEW},
    r as (
      select MMSI, datesub('millisecond', timestamp '1970-01-01', ts) as ms, COG, SOG, Draft,
        lag(datesub('millisecond', timestamp '1970-01-01', ts)) over w as pm,
        last_value(COG ignore nulls) over (w rows between unbounded preceding and 1 preceding) as pc,
        last_value(Draft ignore nulls) over (w rows between unbounded preceding and 1 preceding) as pd,
        lag(SOG) over w as ps,
        row_number() over w as rn
      from p window w as (partition by MMSI order by ts)),
    s as (select *, max(case when SOG >= 0.5 then rn end) over (partition by MMSI order by rn rows between unbounded preceding and 1 preceding) as high from r),
    b as (
      select s.MMSI, s.ms, (select min(t.ms) from r t where t.MMSI = s.MMSI and t.rn > coalesce(s.high, 0) and t.rn < s.rn and t.SOG < 0.5) as since
      from s where s.SOG >= 0.5 and s.ps < 0.5)
    select 'gap' as type, MMSI, ms as ts, null::double as delta_deg, null::double as duration_min, null::double as delta_m, ((ms - pm) // 1000)::bigint as gap_s
    from r where ms - pm > 600000
    union all select 'sharp_turn', MMSI, ms, round({_turn("COG", "pc")}, 2), null, null, null from r where {_turn("COG", "pc")} >= 30
    union all select 'draft_change', MMSI, ms, null, null, round(abs(Draft - pd), 3), null from r where abs(Draft - pd) >= 0.3
    union all select 'stop', MMSI, ms, null, ((ms - since + 300) // 600) / 100.0::double, null, null from b where ms - since >= 900000"""


def _crossings(x: str, y: str, rings: list[list[tuple[float, float]]]) -> str:
    edges = [(a, b) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]
    count = " + ".join(
        f"(case when ({a[1]}::double > {y}) <> ({b[1]}::double > {y}) and {x} < ({b[0]}::double - {a[0]}::double) * ({y} - {a[1]}::double) / ({b[1]}::double - {a[1]}::double) + {a[0]}::double then 1 else 0 end)"
        for a, b in edges if a[1] != b[1]
    )
    on = " or ".join(
        f"(({b[0]}::double - {a[0]}::double) * ({y} - {a[1]}::double) = ({x} - {a[0]}::double) * ({b[1]}::double - {a[1]}::double) and {x} between {min(a[0], b[0])}::double and {max(a[0], b[0])}::double and {y} between {min(a[1], b[1])}::double and {max(a[1], b[1])}::double)"
        for a, b in edges
    )
    return f"(({count}) % 2 = 1 and not ({on}))"


_W = "partition by MMSI order by ts, event_id"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    w = track_window("MMSI", ["ts", "event_id"])
    km = haversine_km(F.lag("LAT").over(w), F.lag("LON").over(w), F.col("LAT"), F.col("LON"))
    return valid(spark, d).select("event_id", "MMSI", F.round(km, 6).alias("segment_km"), F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts")).alias("dt_s"))


def _course_change(spark: SparkSession, d: str) -> DataFrame:
    w = track_window("MMSI", ["ts", "event_id"])
    return valid(spark, d).select("event_id", F.round(angle_diff_deg(F.col("COG"), F.lag("COG").over(w)), 6).alias("turn_deg"))


def _locf(spark: SparkSession, d: str) -> DataFrame:
    w = track_window("MMSI", ["ts", "event_id"])
    return valid(spark, d).select("event_id", *(carried_forward(F.col(c), w).alias(c.lower()) for c in ("COG", "SOG")))


def _ids() -> list[Column]:
    return [F.col(c) for c in ("event_id", "MMSI", "ts", "LAT", "LON")]


def _shimmed(spark: SparkSession, d: str) -> TrackDataset:
    return TrackDataset.from_frame(points(spark, d).withColumns({"IMO": F.col("event_id") + 9_000_000, "CallSign": F.col("event_type")}))


def _vendor(spark: SparkSession, d: str) -> DataFrame:
    v = points(spark, d).select("event_id", F.col("LAT").alias("Latitude"), F.col("LON").alias("Longitude"), F.col("SOG").alias("Speed"), F.col("COG").alias("Course"))
    return normalize_columns(v)


def _existing(spark: SparkSession, d: str) -> DataFrame:
    v = points(spark, d)
    return v.select(*existing_columns(v.columns, ["MMSI", "Heading", "SOG"], ["event_id", "Draft"]))


def _epochs(spark: SparkSession, d: str) -> DataFrame:
    s = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    n = F.col("event_id")
    raw = F.when(n % 3 == 0, s).when(n % 3 == 1, s * 1000).otherwise(s * 1_000_000_000)
    return points(spark, d).select("event_id", epoch_ms(raw).alias("ms"))


def _with_nulls(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    return valid(spark, d).withColumns({"MMSI": F.when(n % 13 != 0, F.col("MMSI")), "ts": F.when(n % 17 != 0, F.col("ts"))})


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Reports as if they were timed runs."""
    runs = valid(spark, d).select(F.col("event_type").alias("task"), (F.col("MMSI") % 3).cast("string").alias("engine"), F.col("SOG").alias("seconds"))
    return timing_summary(runs).withColumns({c: F.round(c, 6) for c in ("median_s", "mean_s", "sd_s")})


_IDS = "event_id, MMSI, ts, LAT, LON"
_NULLS_VIEW = "p as (select * replace (case when event_id % 13 <> 0 then MMSI end as MMSI) from v where LAT between -90 and 90 and LON between -180 and 180 and event_id % 13 <> 0 and event_id % 17 <> 0)"
#: An event as JSON text without null fields.
_JSON_SQL = """'{"type":"' || type || '","MMSI":' || MMSI || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '"'
    || coalesce(',"delta_deg":' || delta_deg, '') || coalesce(',"duration_min":' || duration_min, '') || coalesce(',"delta_m":' || delta_m, '')
    || coalesce(',"gap_s":' || gap_s, '') || '}' as json"""


def _catalogue() -> dict[str, tuple[Query, str | None]]:
    ev = _events_sql()
    allev = "select * from ev"
    found: dict[str, tuple[Query, str | None]] = {
        "traj_stats": (lambda s, d: _rounded(compute_stats(valid(s, d))), _stats_sql("select * from p")),
        "traj_stats_eager": (lambda s, d: _rounded(compute_stats(valid(s, d), mode="eager")), _stats_sql("select * from p", eager=True)),
        "traj_stats_global": (lambda s, d: _rounded(compute_stats(valid(s, d).drop("MMSI"))), _stats_sql("select * from p", key=False)),
        "traj_stats_global_eager": (lambda s, d: _rounded(compute_stats(valid(s, d).drop("MMSI"), mode="eager")), _stats_sql("select * from p", key=False, eager=True)),
        "traj_stats_single_point": (
            lambda s, d: _rounded(compute_stats(_first_rows(valid(s, d)), mode="eager")),
            _stats_sql(f"select * from p qualify row_number() over ({_W}) = 1", eager=True),
        ),
        "top_distance": (
            lambda s, d: compute_stats(valid(s, d)).select("MMSI", "distance_km").orderBy(F.desc("distance_km"), "MMSI").limit(10),
            f"select MMSI, distance_km from ({_stats_sql('select * from p')}) order by distance_km desc, MMSI limit 10",
        ),
        "segments": (_segments, f"with {VIEW} select event_id, MMSI, round({_hav('lag(LAT) over w', 'lag(LON) over w', 'LAT', 'LON')}, 6) as segment_km, datesub('second', lag(ts) over w, ts) as dt_s from p window w as ({_W})"),
        "course_change": (_course_change, f"with {VIEW} select event_id, round({_turn('COG', 'lag(COG) over w')}, 6) as turn_deg from p window w as ({_W})"),
        "locf_course_speed": (_locf, f"with {VIEW} select event_id, last_value(COG ignore nulls) over w as cog, last_value(SOG ignore nulls) over w as sog from p window w as ({_W} rows unbounded preceding)"),
        **{f"events_{k}": (_only(k), f"{_events_sql(k)} {allev}") for k in ("sharp_turn", "stop", "draft_change", "gap")},
        "events_all": (_events(), f"{ev} {allev}"),
        "events_split_by_day": (_events(split="day"), f"{ev} {allev}"),
        "traj_stats_split_by_day": (lambda s, d: _rounded(compute_stats(valid(s, d), split="day")), _stats_sql("select * from p")),
        "traj_stats_eager_split_by_hour": (lambda s, d: _rounded(compute_stats(valid(s, d), mode="eager", split="hour")), _stats_sql("select * from p", eager=True)),
        "events_no_draft": (_events(include_draft_changes=False), f"{_events_sql('sharp_turn stop gap')} {allev}"),
        "events_custom_thresholds": (_events(**CUSTOM), f"{_events_sql(**CUSTOM)} {allev}"),
        "events_ungrouped": (lambda s, d: detect_events(valid(s, d).drop("MMSI")), f"{_events_sql(key=False)} {allev}"),
        "event_type_counts": (lambda s, d: detect_events(valid(s, d)).groupBy("type").agg(F.count(F.lit(1)).alias("n")), f"{ev} select type, count(*) as n from ev group by type"),
        "events_per_vessel_day": (
            lambda s, d: detect_events(valid(s, d)).groupBy("MMSI", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n")),
            f"{ev} select MMSI, strftime(ts, '%Y-%m-%d') as day, count(*) as n from ev group by all",
        ),
        "filter_time_range": (lambda s, d: TrackDataset.from_frame(points(s, d)).between(START, END).lazy().select(*_ids()), f"with {VIEW} select {_IDS} from p where ts >= timestamp '{START}' and ts < timestamp '{END}'"),
        "filter_mmsi": (lambda s, d: TrackDataset.from_frame(points(s, d)).filter(mmsi=VESSELS).lazy().select(*_ids()), f"with {VIEW} select {_IDS} from p where MMSI in {VESSELS}"),
        "filter_imo": (lambda s, d: _shimmed(s, d).filter(imo=[9_000_001, "IMO9000005", 9_000_096]).lazy().select(*_ids()), f"with {VIEW} select {_IDS} from p where event_id in (1, 5, 96)"),
        "filter_callsign": (lambda s, d: _shimmed(s, d).filter(callsign="error").lazy().select(*_ids()), f"with {VIEW} select {_IDS} from p where event_type = 'error'"),
        "valid_geo": (lambda s, d: valid(s, d).select(*_ids()), f"with {VIEW} select {_IDS} from p"),
        "derive_ts": (
            lambda s, d: with_timestamp(_dirty(s, d)).select("event_id", "ts"),
            f"with {VIEW} select event_id, case when event_id % 7 = 0 then null else date_trunc('second', ts)::timestamp end as ts from v",
        ),
        "coerce_numeric": (
            lambda s, d: TrackDataset.from_frame(_dirty(s, d)).lazy().select("event_id", "IMO", "SOG"),
            f"with {VIEW} select event_id, case when event_id % 5 = 0 then null else event_id end as IMO, case when event_id % 11 = 0 then null else (event_id % 100) / 4.0::double end as SOG from v",
        ),
        "scan_csv_dialects": (_dialects, f"with {VIEW} select ts, event_id, MMSI, LAT, LON, SOG, COG, Draft from v"),
        "normalize_columns": (_vendor, f"with {VIEW} select event_id, LAT, LON, SOG, COG from v"),
        "select_existing": (_existing, f"with {VIEW} select MMSI, SOG, event_id, Draft from v"),
        "write_read_parquet_partitioned": (_partitioned, f"with {VIEW} select {_IDS}, year(ts) as year, month(ts) as month, day(ts) as day from p"),
        "write_read_csv": (_csv_back, f"select MMSI, points, distance_km from ({_stats_sql('select * from p')})"),
        "row_and_vessel_counts": (lambda s, d: row_and_vessel_counts(valid(s, d)), f"with {VIEW} select count(*) as rows, count(distinct MMSI) as vessels from p"),
        "grid_square": (
            lambda s, d: grid_features(valid(s, d), 5, "square").withColumns({c: F.round(c, 6) for c in ("avg_sog", "avg_cog")}),
            f"with {VIEW} select floor(LAT * 32)::bigint::varchar || '_' || floor(LON * 32)::bigint::varchar as cell, count(*) as points, round(avg(SOG), 6) as avg_sog, round(avg(COG), 6) as avg_cog from p group by 1",
        ),
        "geofence_rect": (lambda s, d: geofence(valid(s, d), RECTANGLE).select(*_ids()), f"with {VIEW} select {_IDS} from p where {_crossings('LON', 'LAT', [RECTANGLE])}"),
        "geofence_polygon": (lambda s, d: geofence(valid(s, d), POLYGON).select(*_ids()), f"with {VIEW} select {_IDS} from p where {_crossings('LON', 'LAT', POLYGON)}"),
        "epoch_ms": (_epochs, "select event_id, datesub('second', timestamp '1970-01-01', ts) * 1000 as ms from events"),
        "online_events_stream": (_online, _ONLINE_SQL),
        "event_json": (lambda s, d: event_json(detect_events(valid(s, d))), f"{ev} select {_JSON_SQL} from ev"),
        "csv_stream_dialects": (_csv_stream, f"with {VIEW} select ts, event_id, MMSI, LAT, LON, SOG, COG from v"),
        "events_null_keys": (lambda s, d: detect_events(_with_nulls(s, d)), ev.replace(VIEW.partition("p as (")[1] + VIEW.partition("p as (")[2], _NULLS_VIEW) + allev),
        "dataset_projection": (
            lambda s, d: TrackDataset.from_frame(points(s, d)).with_columns(["MMSI", "Heading", "SOG", "event_id", "ts"]).lazy(),
            f"with {VIEW} select MMSI, SOG, event_id, ts from v",
        ),
        "dataset_sorted": (lambda s, d: TrackDataset.from_frame(points(s, d)).lazy(sort_rows=True).select(*_ids()), f"with {VIEW} select {_IDS} from p"),
        "dataset_events": (
            lambda s, d: TrackDataset.from_frame(points(s, d)).between(START, END).detect_events(gap_s=3600, turn_deg=45),
            _events_sql(gap_s=3600, turn_deg=45).replace("from v where", f"from v where ts >= timestamp '{START}' and ts < timestamp '{END}' and") + allev,
        ),
        "timing_summary": (
            _runs,
            f"with {VIEW} select event_type as task, (MMSI % 3)::varchar as engine, count(*) as runs, round(median(SOG), 6) as median_s, round(avg(SOG), 6) as mean_s, round(stddev_samp(SOG), 6) as sd_s from p group by all",
        ),
    }
    return found | queries_space.catalogue(valid, VIEW) | queries_time.catalogue(valid, points, VIEW, _ONLINE_SQL, _hav)


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _catalogue().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _catalogue().items() if sql}
