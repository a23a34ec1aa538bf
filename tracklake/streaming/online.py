"""Online events: a state of four numbers for each vessel.

One step function serves both the plain iterator and the stateful stream
operator, so a stream gives the same events as a fold over its records,
however it is cut into micro-batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracklake.functions.parsing import epoch_ms, millis_of

ONLINE_SCHEMA = "type string, MMSI bigint, ts bigint, delta_deg double, duration_min double, delta_m double, gap_s bigint"
STATE_SCHEMA = "last_ts bigint, course double, stop_start bigint, draft double"


class Thresholds(NamedTuple):
    turn_deg: float = 30.0
    stop_sog: float = 0.5
    stop_min: float = 15
    draft_jump_m: float = 0.3
    gap_s: float = 600


class VesselState(NamedTuple):
    last_ts: int | None = None
    course: float | None = None
    stop_start: int | None = None
    draft: float | None = None


def to_ms(value: Any) -> int:
    """Epoch milliseconds from seconds, milliseconds or nanoseconds, told apart by magnitude."""
    if value >= 1e15:
        return int(value // 1_000_000)
    return int(value) if value >= 1e12 else int(value * 1000)


def _number(value: Any) -> float | None:
    return None if value is None or value != value else float(value)


def step(state: VesselState, mmsi: int, ms: int, cog: Any, sog: Any, draft: Any, limits: Thresholds) -> tuple[VesselState, list[dict]]:
    """The state after one record, and its events in the order gap, turn, stop, draught."""
    cog, sog, draft = _number(cog), _number(sog), _number(draft)
    events: list[dict] = []

    def emit(kind: str, **metric: float) -> None:
        events.append({"type": kind, "MMSI": mmsi, "ts": ms, **metric})

    if state.last_ts is not None and ms - state.last_ts > limits.gap_s * 1000:
        emit("gap", gap_s=(ms - state.last_ts) // 1000)
    course, stop_start, last_draft = state.course, state.stop_start, state.draft
    if cog is not None:
        if course is not None:
            d = math.radians(cog) - math.radians(course)
            turn = abs(math.degrees(math.atan2(math.sin(d), math.cos(d)))) if math.isfinite(d) else 0.0
            if turn >= limits.turn_deg:
                emit("sharp_turn", delta_deg=round(turn, 2))
        course = cog
    if sog is not None:
        if sog < limits.stop_sog:
            stop_start = ms if stop_start is None else stop_start
        elif stop_start is not None:
            if ms - stop_start >= limits.stop_min * 60_000:
                emit("stop", duration_min=(ms - stop_start + 300) // 600 / 100)  # minutes, two decimals, half up
            stop_start = None
    if draft is not None:
        if last_draft is not None and abs(draft - last_draft) >= limits.draft_jump_m:
            emit("draft_change", delta_m=round(abs(draft - last_draft), 3))
        last_draft = draft
    return VesselState(ms, course, stop_start, last_draft), events


def process_stream(records: Iterable[dict], **limits: float) -> Iterator[dict]:
    """Events of records in the order they come. Records without MMSI or ts are skipped."""
    thresholds, states = Thresholds(**limits), {}
    for r in records:
        if r.get("MMSI") is None or r.get("ts") is None:
            continue
        mmsi = int(r["MMSI"])
        states[mmsi], events = step(
            states.get(mmsi, VesselState()), mmsi, to_ms(r["ts"]), r.get("COG"), r.get("SOG"), r.get("Draft"), thresholds
        )
        yield from events


class _Online(StatefulProcessor):
    def __init__(self, limits: Thresholds):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("vessel", STATE_SCHEMA)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # One vessel's rows of one micro-batch; they come in no order, so they are sorted by time here.
        batch = pd.concat(list(rows), ignore_index=True)
        sort_by = ["ms", *(c for c in ("COG", "SOG", "Draft") if c in batch)]
        batch = batch.sort_values(sort_by, kind="stable")
        state = VesselState(*(None if v != v else v for v in self.state.get())) if self.state.exists() else VesselState()
        out: list[dict] = []
        for ms, cog, sog, draft in zip(*(batch[c].tolist() for c in ("ms", "COG", "SOG", "Draft")), strict=True):
            state, events = step(state, int(key[0]), int(ms), cog, sog, draft, self.limits)
            out += events
        self.state.update(tuple(state))
        if out:
            columns = [c.split()[0] for c in ONLINE_SCHEMA.split(", ")]
            frame = pd.DataFrame(out).reindex(columns=columns)
            frame["gap_s"] = frame["gap_s"].astype("Int64")
            yield frame

    def close(self) -> None:
        pass


def online_records(df: DataFrame) -> DataFrame:
    """MMSI, ms, COG, SOG, Draft of any point stream; rows without vessel or time are left out."""
    kinds = dict(df.dtypes)
    source = "ts" if "ts" in kinds else "BaseDateTime"
    time = F.col(source)
    if kinds[source] in ("timestamp_ntz", "timestamp", "date"):
        ms = millis_of(time.cast("timestamp_ntz"))
    elif kinds[source] == "string":
        ms = F.coalesce(epoch_ms(time), millis_of(time.try_cast("timestamp_ntz")))
    else:
        ms = epoch_ms(time)
    measures = [(F.col(c).try_cast("double") if c in kinds else F.lit(None).cast("double")).alias(c) for c in ("COG", "SOG", "Draft")]
    rows = df.select(F.col("MMSI").try_cast("bigint").alias("MMSI"), ms.alias("ms"), *measures)
    return rows.where(F.col("MMSI").isNotNull() & F.col("ms").isNotNull())


def detect_events_stream(df: DataFrame, **limits: float) -> DataFrame:
    """Online events of a stream of points, with state kept by vessel across micro-batches.

    Needs the RocksDB state store provider. A late record is handled when it
    comes, as in the plain fold; sort or watermark the source first if order
    matters.
    """
    return (
        online_records(df)
        .groupBy("MMSI")
        .transformWithStateInPandas(
            statefulProcessor=_Online(Thresholds(**limits)), outputStructType=ONLINE_SCHEMA, outputMode="Append", timeMode="None"
        )
    )
