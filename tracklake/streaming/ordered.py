"""Online events in the order of event time, whatever the order of arrival.

Rows wait in a list state until the watermark has passed them; a timer
of the earliest one then hands all that are due, sorted, to the same step that
the plain fold uses. A second deadline, ``quiet_min`` after a vessel's last row,
reports a stop that is still open and forgets the vessel, so the state holds
only vessels that were heard of lately and rows younger than the lateness.

Each call to the state is a message to the JVM, and so is each value in it. So
vessels are dealt by a hash to parts, and a part is one key: its rows wait
packed, many in one value, its vessels are packed in another, and what is known
to be unchanged isn't written. Calls grow with the parts, not with the vessels.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracklake.streaming.online import ONLINE_SCHEMA, Thresholds, VesselState, online_records, step

CHUNK_SCHEMA, PACKED_SCHEMA = "rows binary", "vessels binary"
#: What waits, one row after the other; measures are NaN if not known.
_ROW = np.dtype([("mmsi", "<i8"), ("ms", "<i8"), ("COG", "<f8"), ("SOG", "<f8"), ("Draft", "<f8")])
#: A vessel's state; what is not known is NaN, or ``_NEVER`` for a time.
_VESSEL = np.dtype([("mmsi", "<i8"), ("last_ts", "<i8"), ("course", "<f8"), ("stop_start", "<i8"), ("draft", "<f8")])
_NEVER = -(2**63)
#: Rows that one value of the state holds at most, and events that one frame holds, or a few more.
CHUNK_ROWS = FRAME_EVENTS = 10_000
#: Into how many parts vessels are dealt.
PARTS = 1024
MEASURES = ["COG", "SOG", "Draft"]
COLUMNS = [c.split()[0] for c in ONLINE_SCHEMA.split(", ")]


def _packed(rows: np.ndarray) -> list[tuple[bytes]]:
    """The rows as values of the state."""
    return [(rows[i : i + CHUNK_ROWS].tobytes(),) for i in range(0, len(rows), CHUNK_ROWS)]


def _unpacked(chunks: Iterable[tuple]) -> np.ndarray:
    return np.frombuffer(b"".join(chunk for (chunk,) in chunks), _ROW)


def _sorted(rows: np.ndarray) -> np.ndarray:
    """By vessel, time, course, speed and draught, missing ones first."""
    keys = [rows["mmsi"], rows["ms"]]
    for c in MEASURES:
        known = ~np.isnan(rows[c])
        keys += [known, np.where(known, rows[c], 0.0)]
    return rows[np.lexsort(keys[::-1])]


def _vessels(value: tuple | None) -> dict[int, VesselState]:
    """The states of a part's vessels."""
    found = np.frombuffer(b"" if value is None else bytes(value[0]), _VESSEL).tolist()
    return {
        mmsi: VesselState(ms, None if course != course else course, None if stop == _NEVER else stop, None if draft != draft else draft)
        for mmsi, ms, course, stop, draft in found
    }


def _together(vessels: dict[int, VesselState]) -> tuple[bytes]:
    nan = float("nan")
    rows = [
        (mmsi, s.last_ts, nan if s.course is None else s.course, _NEVER if s.stop_start is None else s.stop_start, nan if s.draft is None else s.draft)
        for mmsi, s in vessels.items()
    ]
    return (np.array(rows, _VESSEL).tobytes(),)


class _Events:
    """Events as frames, which take less room than the events themselves."""

    def __init__(self) -> None:
        self.frames: list[pd.DataFrame] = []
        self.open: list[dict] = []

    def add(self, events: list[dict]) -> None:
        self.open += events
        if len(self.open) >= FRAME_EVENTS:
            self._close()

    def _close(self) -> None:
        if self.open:
            columns = {c: [e.get(c) for e in self.open] for c in COLUMNS}
            self.frames.append(pd.DataFrame(columns | {"gap_s": pd.array(columns["gap_s"], dtype="Int64")}))
            self.open = []

    def all(self) -> Iterator[pd.DataFrame]:
        self._close()
        return iter(self.frames)


class _Ordered(StatefulProcessor):
    """The vessels of a part, which is the key; rows without MMSI are of the vessel that the key names."""

    def __init__(self, limits: Thresholds, quiet_ms: int | None):
        self.limits, self.quiet_ms = limits, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.vessel = handle.getValueState("vessel", PACKED_SCHEMA)
        self.waiting = handle.getListState("waiting", CHUNK_SCHEMA)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        earliest = None
        for batch in rows:
            if len(batch):
                found = np.empty(len(batch), _ROW)
                found["mmsi"] = batch["MMSI"].to_numpy("int64") if "MMSI" in batch else key[0]
                found["ms"] = batch["ms"].to_numpy("int64")
                for c in MEASURES:
                    found[c] = batch[c].to_numpy("float64", na_value=float("nan"))
                self.waiting.appendList(_packed(found))
                first = int(found["ms"].min())
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self.handle.registerTimer(max(earliest, 1))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        rows = _unpacked(self.waiting.get())
        due, later = _sorted(rows[rows["ms"] <= passed]), rows[rows["ms"] > passed]
        if not len(due) and self.quiet_ms is None:  # an earlier timer took them; what waits has one of its own
            return iter(())
        known = self.vessel.get()
        vessels, events = _vessels(known), _Events()
        for mmsi, ms, cog, sog, draft in due.tolist():
            state = vessels.get(mmsi, VesselState())
            if self._is_quiet(state, ms):
                state, found = self._closed(state, mmsi)
                events.add(found)
            vessels[mmsi], found = step(state, mmsi, ms, cog, sog, draft, self.limits)
            events.add(found)
        if len(due) and len(later):
            self.waiting.put(_packed(later))
        elif len(due):
            self.waiting.clear()
        if len(later):
            self.handle.registerTimer(int(later["ms"].min()))
        left = vessels if self.quiet_ms is None else self._left(vessels, set(later["mmsi"].tolist()), passed, events)
        if left and (len(due) or len(left) < len(vessels)):
            self.vessel.update(_together(left))
        elif not left and known is not None:
            self.vessel.clear()
        return events.all()

    def _left(self, vessels: dict[int, VesselState], waits: set[int], passed: int, events: _Events) -> dict[int, VesselState]:
        """The vessels without those that are silent for long, with a timer for the next one to be; one with rows that wait isn't silent yet."""
        left = {}
        for mmsi, state in vessels.items():
            if mmsi not in waits and self._is_quiet(state, passed):
                events.add(self._closed(state, mmsi)[1])
            else:
                left[mmsi] = state
        if times := [state.last_ts for mmsi, state in left.items() if mmsi not in waits]:
            self.handle.registerTimer(min(times) + self.quiet_ms)
        return left

    def _is_quiet(self, state: VesselState, now: int) -> bool:
        return self.quiet_ms is not None and state.last_ts is not None and now >= state.last_ts + self.quiet_ms

    def _closed(self, state: VesselState, mmsi: int) -> tuple[VesselState, list[dict]]:
        """A vessel that fell silent: its open stop ends at its last row."""
        if state.stop_start is None or state.last_ts - state.stop_start < self.limits.stop_min * 60_000:
            return VesselState(), []
        minutes = (state.last_ts - state.stop_start + 300) // 600 / 100
        return VesselState(), [{"type": "stop", "MMSI": mmsi, "ts": int(state.last_ts), "duration_min": minutes}]

    def close(self) -> None:
        pass


def detect_events_in_order(df: DataFrame, lateness: str = "1 hour", quiet_min: float | None = None, parts: int = PARTS, **limits: float) -> DataFrame:
    """Online events of a stream as if its rows came sorted by time.

    Rows may be late by ``lateness``; those that come after the watermark has
    passed them are left out, and count among the progress' rows dropped by
    watermark. After ``quiet_min`` minutes without a row, in event time, a
    vessel is forgotten: a stop that was open is reported, and what comes later
    starts anew, without a gap. Rows of one vessel and time are taken by
    ascending course, speed and draught, missing ones first. Vessels are
    dealt to ``parts`` keys, which must stay as they are for a checkpoint; what
    waits of one of them is held in memory. Needs the RocksDB state store
    provider.
    """
    rows = online_records(df).withColumn("time", F.timestamp_millis("ms")).withWatermark("time", lateness)
    quiet = None if quiet_min is None else int(quiet_min * 60_000)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("MMSI"), F.lit(parts)).cast("int"))
    return rows.groupBy("part").transformWithStateInPandas(
        statefulProcessor=_Ordered(Thresholds(**limits), quiet), outputStructType=ONLINE_SCHEMA, outputMode="Append", timeMode="EventTime"
    )
