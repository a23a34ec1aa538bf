"""The dataset builder: files, filters, analytics and output in one place."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from datetime import date, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tracklake.functions.parsing import number_from_text, to_long, with_timestamp
from tracklake.operators.events import detect_events
from tracklake.operators.stats import compute_stats
from tracklake.schema import NUMERIC, TYPED, available_message, existing_columns
from tracklake.sources.files import discover_files, scan_files, scan_parquet
from tracklake.sources.sinks import write_partitioned
from tracklake.viz import plot_track_html


def parse_temporal(value: str | date | datetime) -> datetime:
    """An ISO date or date and time as a naive timestamp."""
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    try:
        return datetime.fromisoformat(str(value).strip()).replace(tzinfo=None)
    except ValueError:
        raise ValueError(f"Could not parse datetime literal: {value!r}") from None


def _listed(value: Any) -> list:
    return [v for v in value if v is not None] if isinstance(value, (list, tuple, set, frozenset)) else [value]


def valid_geo() -> Column:
    return F.col("LAT").between(-90, 90) & F.col("LON").between(-180, 180)


@dataclass(frozen=True)
class TrackDataset:
    """Position reports under a folder. Every method gives a new dataset; nothing runs until output is asked for.

    ``merge_schema`` is for Parquet files that differ in columns; CSV files may always.
    """

    root: str | os.PathLike | None = None
    pattern: str = "*.csv"
    spark: SparkSession | None = None
    source: DataFrame | None = None
    typed: bool = False
    files: tuple[str, ...] = ()
    _selected: tuple[str, ...] | None = None
    _filters: tuple[tuple[str, Any], ...] = field(default=())
    _time: tuple[tuple[datetime, datetime], ...] = field(default=())
    merge_schema: bool = False

    def __post_init__(self) -> None:
        if self.source is not None:
            return
        spark = self.spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        files = discover_files(self.root, self.pattern, spark)
        frame = scan_parquet(spark, files, self.merge_schema) if self.pattern.endswith(".parquet") else scan_files(spark, files)
        for name, value in (("spark", spark), ("files", tuple(files)), ("source", frame)):
            object.__setattr__(self, name, value)

    @classmethod
    def from_frame(cls, df: DataFrame) -> TrackDataset:
        return cls(spark=df.sparkSession, source=df)

    # -- configuration

    def with_columns(self, cols: Iterable[str]) -> TrackDataset:
        """Keep only these columns; replaces an earlier choice. Filters may use any column."""
        return replace(self, _selected=tuple(cols))

    def between(self, start: str | date | datetime, end: str | date | datetime) -> TrackDataset:
        """Rows with start <= ts < end."""
        return replace(self, _time=(*self._time, (parse_temporal(start), parse_temporal(end))))

    def filter(self, mmsi: Any = None, imo: Any = None, callsign: Any = None) -> TrackDataset:
        """Rows of one or several vessels. An IMO number may be given with its prefix."""
        added: list[tuple[str, Any]] = []
        if mmsi is not None:
            added.append(("MMSI", [int(v) for v in _listed(mmsi)]))
        if imo is not None:
            added.append(("IMO", [int(str(v).upper().removeprefix("IMO")) for v in _listed(imo)]))
        if callsign is not None:
            added.append(("CallSign", [str(v) for v in _listed(callsign)]))
        return replace(self, _filters=(*self._filters, *added))

    # -- the plan

    def lazy(self, sort_rows: bool = False, with_ts: bool = False) -> DataFrame:
        """The plan: filters, projection, casts, valid coordinates; ``ts`` if needed or wanted."""
        df = self.source
        need_ts = bool(self._time) or with_ts or (self._selected is not None and "ts" in self._selected)
        if need_ts:
            df = with_timestamp(df)
            if self._time and "ts" not in df.columns:
                raise ValueError(f"No timestamp column. {available_message(df.columns)}")
        for column, values in self._filters:
            if column not in df.columns:
                raise ValueError(f"No column {column} to filter by. {available_message(df.columns)}")
            own = F.col(column) if column == "CallSign" else to_long(F.col(column))
            if column == "IMO" and dict(df.dtypes)[column] == "string":
                own = to_long(F.regexp_replace(F.col(column), "(?i)^IMO", ""))
            df = df.where(own.isin(values))
        for start, end in self._time:
            df = df.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
            df = _prune_folders(df, start, end)
        if self._selected is not None:
            df = df.select(*existing_columns(df.columns, self._selected, ("ts",) if need_ts else ()))
        kinds = NUMERIC | TYPED if self.typed else NUMERIC
        have = dict(df.dtypes)
        df = df.withColumns({
            c: number_from_text(F.col(c), k) if have[c] == "string" and k in ("bigint", "int", "double") else F.col(c).try_cast(k)
            for c, k in kinds.items() if c in have and have[c] != k
        })
        if {"LAT", "LON"} <= set(df.columns):
            df = df.where(valid_geo())
        if sort_rows:
            df = df.orderBy(*(c for c in ("MMSI", "ts") if c in df.columns))
        return df

    def columns(self) -> list[str]:
        return self.lazy().columns

    # -- output

    def collect(self, sort_rows: bool = False) -> list[Row]:
        return self.lazy(sort_rows).collect()

    def to_pandas(self, sort_rows: bool = False):
        return self.lazy(sort_rows).toPandas()

    def head(self, n: int = 5) -> list[Row]:
        return self.lazy().take(n)

    def write_parquet(self, path: str | os.PathLike, partition: str | None = None, *, sort_rows: bool = False) -> Path:
        """Parquet, in folders if ``partition`` is year, year/month or year/month/day."""
        df = self.lazy(with_ts=bool(partition))
        order = tuple(c for c in ("MMSI", "ts") if c in df.columns) if sort_rows else ()
        return write_partitioned(df, path, partition, order)

    def stats(self, level: str = "mmsi", mode: str = "lazy", split: str | None = None) -> DataFrame:
        return compute_stats(self.lazy(with_ts=True), level, mode, split)

    def detect_events(
        self,
        turn_deg: float = 30.0,
        stop_sog: float = 0.5,
        stop_min: float = 15,
        draft_jump_m: float = 0.3,
        gap_s: float = 600,
        include_draft_changes: bool = True,
        sort_output: bool = True,
        split: str | None = None,
    ) -> DataFrame:
        df = self.lazy(with_ts=True)
        return detect_events(df, turn_deg, stop_sog, stop_min, draft_jump_m, gap_s, "MMSI", include_draft_changes, sort_output, split)

    def plot_map(self, out_html: str | os.PathLike, mmsi: int | Sequence[int] | None = None, every_point: bool = False) -> Path:
        df = self.lazy(with_ts=True)
        if mmsi is not None:
            df = df.where(F.col("MMSI").isin([int(v) for v in _listed(mmsi)]))
        return plot_track_html(df, out_html, every_point=every_point)


def _prune_folders(df: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """For a table laid out by year, month and day: a predicate on the folders, so files outside the range are not opened."""
    kinds, code, low, high = dict(df.dtypes), F.lit(0), 0, 0
    for part in ("year", "month", "day"):
        if kinds.get(part) not in ("int", "bigint"):
            break
        code, low, high = code * 100 + F.col(part), low * 100 + getattr(start, part), high * 100 + getattr(end, part)
        # One predicate for each depth: those on columns that are no folders don't keep the others from pruning.
        df = df.where(code.between(low, high))
    return df
