"""Navigational events of finished tracks.

All four kinds are expressions over one window on the vessel: one shuffle, one
sort, and one pass that turns each row into at most four events. Rows without
vessels, one single track, are windowed hour by hour instead, and so are
vessels if ``split`` asks for it, by the unit it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.functions.geo import angle_diff_deg, is_finite
from tracklake.functions.parsing import with_timestamp
from tracklake.plans.tracks import (
    HOUR, TIES, by_hour, carried_forward, first_of, handed, hours, hours_before, last_known, last_of, track_window,
)
from tracklake.schema import EVENT_SCHEMA


def _event(kind: str, ts: Column, **metric: Column) -> Column:
    """A struct of the event schema without the key, which is added later."""
    values = {"type": F.lit(kind), "ts": ts, **metric}
    fields = [f for f in EVENT_SCHEMA.fields if f.name != "MMSI"]
    return F.struct(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def _is_stopped(speed: Column, stop_sog: float) -> Column:
    return F.coalesce(is_finite(speed) & (speed < stop_sog), F.lit(False))


def _begin() -> Column:
    return F.when(F.col("stopped") & ~F.col("was_stopped"), F.col("ts"))


def _of_vessels(rows: DataFrame, order: list[str], measures: list[str], stop_sog: float) -> DataFrame:
    """Rows with previous_ts, course, previous_course, previous_draft, stopped, was_stopped, stays_stopped and begin (of the stop)."""
    w = track_window("vessel", order)
    derived: dict[str, Column] = {"previous_ts": F.lag("ts").over(w)}
    if "COG" in measures:
        rows = rows.withColumn("course", carried_forward(F.col("COG"), w))
        derived["previous_course"] = F.lag("course").over(w)
    if "Draft" in measures:
        derived["previous_draft"] = F.lag("Draft").over(w)
    if "SOG" in measures:
        rows = rows.withColumn("stopped", _is_stopped(carried_forward(F.col("SOG"), w), stop_sog))
        derived["was_stopped"] = F.coalesce(F.lag("stopped").over(w), F.lit(False))
        derived["stays_stopped"] = F.coalesce(F.lead("stopped").over(w), F.lit(False))
    rows = rows.withColumns(derived)
    return rows.withColumn("begin", carried_forward(_begin(), w)) if "SOG" in measures else rows


def _by_spans(rows: DataFrame, order: list[str], measures: list[str], stop_sog: float, key: str | None, unit: str) -> DataFrame:
    """The same for tracks dealt by hour: what an hour needs of the track's others is handed to it."""
    keys = [key] if key else []
    rows, w, nothing = by_hour(rows, unit), track_window([*keys, HOUR], order), F.lit(None).cast("double")
    cog, sog, draft = (F.col(c) if c in measures else nothing for c in ("COG", "SOG", "Draft"))
    table = rows.groupBy(*keys, HOUR).agg(
        last_of(F.struct(F.col("ts").alias("ts"), draft.alias("draft")), order).alias("last"), last_known(cog, order).alias("cog"),
        last_known(sog, order).alias("sog"), first_of(F.struct(sog.alias("sog")), order).alias("first"),
    )
    speed_before = F.last("sog", ignorenulls=True).over(hours_before(key))
    table = table.select(
        *keys, HOUR, F.lag("last").over(hours(key)).alias("h_last"), F.last("cog", ignorenulls=True).over(hours_before(key)).alias("h_course"), speed_before.alias("h_speed"),
        # The next hour's first speed, or, if it has none of its own, what is carried on from this hour.
        F.lead("first").over(hours(key)).alias("h_next"), F.coalesce(F.col("sog"), speed_before).alias("h_end"),
    )
    rows = handed(rows, table, key)
    is_first, is_last = F.lag("ts").over(w).isNull(), F.lead("ts").over(w).isNull()
    rows = rows.withColumns({
        "course": F.coalesce(carried_forward(cog, w), "h_course"),
        "stopped": _is_stopped(F.coalesce(carried_forward(sog, w), "h_speed"), stop_sog),
        "is_first": is_first, "is_last": is_last,
    })
    next_stopped = F.col("h_next").isNotNull() & _is_stopped(F.coalesce(F.col("h_next.sog"), F.col("h_end")), stop_sog)
    rows = rows.withColumns({
        "previous_ts": F.coalesce(F.lag("ts").over(w), F.col("h_last.ts")),
        "previous_course": F.when(F.col("is_first"), F.col("h_course")).otherwise(F.lag("course").over(w)),
        "previous_draft": F.when(F.col("is_first"), F.col("h_last.draft")).otherwise(F.lag(draft).over(w)),
        "was_stopped": F.when(F.col("is_first"), _is_stopped(F.col("h_speed"), stop_sog)).otherwise(F.lag("stopped").over(w)),
        "stays_stopped": F.when(F.col("is_last"), next_stopped).otherwise(F.lead("stopped").over(w)),
    })
    begins = rows.groupBy(*keys, HOUR).agg(F.max(_begin()).alias("begin"))
    begins = begins.select(*keys, HOUR, F.last("begin", ignorenulls=True).over(hours_before(key)).alias("h_begin"))
    return handed(rows.withColumn("own_begin", carried_forward(_begin(), w)), begins, key).withColumn("begin", F.coalesce("own_begin", "h_begin"))


def detect_events(
    df: DataFrame,
    turn_deg: float = 30.0,
    stop_sog: float = 0.5,
    stop_min: float = 15,
    draft_jump_m: float = 0.3,
    gap_s: float = 600,
    group_col: str = "MMSI",
    include_draft_changes: bool = True,
    sort_output: bool = False,
    split: str | None = None,
) -> DataFrame:
    """Events sharp_turn, stop, draft_change and gap, in the event schema.

    * sharp_turn: the course, carried forward over nulls, turns by at least ``turn_deg``;
    * stop: two or more rows in a row with a speed, carried forward, below ``stop_sog``,
      over at least ``stop_min`` minutes; reported at its last row, also if the data end there;
    * draft_change: the draught differs by at least ``draft_jump_m`` from the row before;
    * gap: more than ``gap_s`` whole seconds since the row before.

    Rows without a key or timestamp are left out; without ``group_col`` all
    rows are one track with a null MMSI; without any timestamp there are no
    events. NaN and infinite values never fire.

    By default one task walks a vessel's whole track. ``split``, a unit such as
    day, hour or minute, deals it by that span and hands on what a span needs of
    those before, for tables in which one vessel has a large share of all rows.
    """
    df = with_timestamp(df)
    if "ts" not in df.columns:
        return df.sparkSession.createDataFrame([], EVENT_SCHEMA)
    key = group_col if group_col in df.columns else None
    order = ["ts", *(c for c in TIES if c in df.columns)]
    measures = [c for c in ("COG", "SOG", "Draft") if c in df.columns]
    rows = df.select(*dict.fromkeys([*([key] if key else []), *order, *measures])).where(F.col("ts").isNotNull())
    rows = rows.withColumns({c: F.col(c).try_cast("double") for c in measures})
    if key:
        rows = rows.withColumn("vessel", F.col(key).try_cast("bigint")).where(F.col("vessel").isNotNull())
    else:
        rows = rows.withColumn("vessel", F.lit(None).cast("bigint"))
    ts = F.col("ts")
    if key and not split:
        rows = _of_vessels(rows, order, measures, stop_sog)
    else:
        rows = _by_spans(rows, order, measures, stop_sog, "vessel" if key else None, split or "hour")
    events = []
    if "COG" in measures:
        turn = angle_diff_deg(F.col("course"), F.col("previous_course"))
        fires = is_finite(turn) & (turn >= turn_deg)
        events.append(F.when(fires, _event("sharp_turn", ts, delta_deg=F.round(turn, 3))))
    if "SOG" in measures:
        ms = F.timestamp_diff("MILLISECOND", F.col("begin"), ts)
        fires = F.col("stopped") & F.col("was_stopped") & ~F.col("stays_stopped") & (ms >= stop_min * 60_000)
        events.append(F.when(fires, _event("stop", ts, duration_min=F.round(ms / 60_000, 2))))
    if "Draft" in measures and include_draft_changes:
        change = F.abs(F.col("Draft") - F.col("previous_draft"))
        fires = is_finite(change) & (change >= draft_jump_m)
        events.append(F.when(fires, _event("draft_change", ts, delta_m=F.round(change, 3))))
    gap = F.timestamp_diff("SECOND", F.col("previous_ts"), ts)
    events.append(F.when(gap > gap_s, _event("gap", ts, gap_s=gap)))
    fired = rows.select("vessel", F.array_compact(F.array(*events)).alias("events")).where(F.size("events") > 0)
    out = fired.select(F.col("vessel").alias("MMSI"), F.inline("events")).select(*EVENT_SCHEMA.names)
    return out.orderBy("MMSI", "ts", "type") if sort_output else out
