"""One window for everything that looks at a vessel's neighbouring rows.

Statistics and events share this specification, so each needs a single shuffle
on the vessel and a single sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracklake.functions.parsing import with_timestamp

#: Order of rows that have no timestamp at all: as scanned.
SEQUENCE = "__track_sequence"
#: What breaks ties of equal timestamps, as far as present.
TIES = ("event_id", "LAT", "LON", "SOG", "COG", "Draft")


def with_order(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The frame with ``ts`` if it has a source for it, and the columns that order a track."""
    df = with_timestamp(df)
    if "ts" in df.columns:
        return df, ["ts", *(c for c in TIES if c in df.columns)]
    return df.withColumn(SEQUENCE, F.monotonically_increasing_id()), [SEQUENCE]


def track_window(key: str | Sequence[str] | None, order: Sequence[str]) -> WindowSpec:
    """Without a key all rows are one track, which one task must walk through."""
    keys = [key] if isinstance(key, str) else list(key or ())
    return Window.partitionBy(*keys).orderBy(*order)


def running(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carried_forward(column: Column, window: WindowSpec) -> Column:
    """The last value that was not null, up to this row."""
    return F.last(column, ignorenulls=True).over(running(window))


#: The span of time by which long tracks are dealt: an hour, or another unit.
HOUR = "__hour"


def by_hour(rows: DataFrame, unit: str = "hour") -> DataFrame:
    """Rows with the hour (or day, minute) they belong to, in which they are windowed; a track's hours are then tied together by ``handed``."""
    return rows.withColumn(HOUR, F.date_trunc(unit, F.col("ts").cast("timestamp_ntz")))


def last_of(value: Column, order: Sequence[str]) -> Column:
    """The value of an hour's last row."""
    return F.max_by(value, F.struct(*order))


def last_known(value: Column, order: Sequence[str]) -> Column:
    """The last value of an hour that is not null."""
    return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))


def first_of(value: Column, order: Sequence[str]) -> Column:
    """The value of an hour's first row."""
    return F.min_by(value, F.struct(*order))


def hours(key: str | None = None) -> WindowSpec:
    """The table of a track's hours in order: a row for each hour, so one task holds a track's."""
    return track_window(key, [HOUR])


def hours_before(key: str | None = None) -> WindowSpec:
    return hours(key).rowsBetween(Window.unboundedPreceding, -1)


def handed(rows: DataFrame, summary: DataFrame, key: str | None = None) -> DataFrame:
    """``rows`` with what ``summary``, a table with a row for each track and hour only, holds for theirs."""
    names = {c: f"__from_{c}" for c in ([key] if key else []) + [HOUR]}
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return rows.join(summary.withColumnsRenamed(names), same).drop(*names.values())


def with_previous(rows: DataFrame, order: Sequence[str], value: Column, name: str = "previous", key: str | None = None, unit: str = "hour") -> DataFrame:
    """Each row with ``value`` (not null) of the row before it in its track, without one task for all of a track.

    The last value of each hour is handed to the first row of the next one.
    """
    rows, keys = by_hour(rows, unit), [key] if key else []
    tails = rows.groupBy(*keys, HOUR).agg(last_of(value, order).alias("tail"))
    own = F.lag(value).over(track_window([*keys, HOUR], order))
    joined = handed(rows.withColumn(name, own), tails.select(*keys, HOUR, F.lag("tail").over(hours(key)).alias("__before")), key)
    return joined.withColumn(name, F.coalesce(F.col(name), F.col("__before"))).drop(HOUR, "__before")
