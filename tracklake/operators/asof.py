"""As-of join: to each row of one table the last row of another, by key and time.

Both tables are united and walked in one window by key and time, in which the
last row of the right table is carried forward: one exchange, no range join and
no candidate pairs. A key with a large share of all rows would be one task, so
with ``bucket`` the window is dealt by key and time bucket, and a small table
with the last right row of each bucket, carried from bucket to bucket, hands
each bucket what it needs of the ones before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: str | Sequence[str] = "MMSI",
    time: str = "ts",
    tolerance_s: float | None = None,
    suffix: str = "_right",
    ties: Sequence[str] = (),
    bucket: str | None = None,
) -> DataFrame:
    """Every row of ``left`` with the columns of the last row of ``right`` that has its key and is not later; nulls if there is none.

    Rows of ``right`` without key or time match nothing, and rows of ``left``
    without them are kept with nulls. Of right rows of one key and time the one
    greatest by ``ties``, then by its columns, counts. With ``tolerance_s``
    older matches are left out. Columns of ``right`` that ``left`` has too get
    ``suffix``; its time always does. ``bucket`` is a unit of date_trunc, such
    as day or hour.
    """
    keys = [by] if isinstance(by, str) else list(by)
    values = [c for c in right.columns if c not in keys]
    if missing := [c for c in (*keys, time) if c not in left.columns or c not in right.columns]:
        raise ValueError(f"Both tables need the columns {missing}")
    named = {c: c + suffix if c in left.columns else c for c in values}
    if clash := [n for c, n in named.items() if n != c and n in left.columns]:
        raise ValueError(f"Columns {clash} would be there twice; choose another suffix")
    orderable = [c for c in values if c not in (time, *ties) and not dict(right.dtypes)[c].startswith(("map", "variant"))]
    row = F.struct(*(F.col(c).alias(named[c]) for c in values))
    right_rows = right.where(F.col(time).isNotNull()).select(
        *keys, F.col(time).alias("__time"), F.lit(0).alias("__side"), F.struct(*(F.col(c) for c in (*ties, *orderable))).alias("__tie"), row.alias("__right")
    )
    left_rows = left.select(*keys, F.col(time).alias("__time"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"))
    rows = right_rows.unionByName(left_rows, allowMissingColumns=True)
    order = ["__time", "__side", "__tie"]
    parts = list(keys)
    if bucket:
        rows = rows.withColumn("__bucket", F.date_trunc(bucket, F.col("__time").cast("timestamp")))
        parts.append("__bucket")
    carried = F.last("__right", ignorenulls=True).over(Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = rows.withColumn("__match", carried).where("__side = 1")
    if bucket:
        joined = _from_before(joined, rows, keys)
    joined = joined.withColumn("__match", _known(keys, tolerance_s, named[time]))
    return joined.select("__left.*", *(F.col("__match").getField(named[c]).alias(named[c]) for c in values))


def _known(keys: list[str], tolerance_s: float | None, right_time: str) -> Column:
    """The match, if the keys are there and it is not too old."""
    fits = F.col("__time").isNotNull()
    for k in keys:
        fits = fits & F.col(k).isNotNull()
    if tolerance_s is not None:
        age = F.timestamp_diff("MICROSECOND", F.col("__match").getField(right_time), F.col("__time"))
        fits = fits & (age <= round(tolerance_s * 1_000_000))
    return F.when(fits, F.col("__match"))


def _from_before(joined: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a match in their bucket get the last right row of the buckets before.

    The table of buckets has a row for each key and bucket; a window by key
    walks it.
    """
    last = F.max_by("__right", F.when(F.col("__side") == 0, F.struct("__time", "__tie"))).alias("__last")
    buckets = rows.where(F.col("__bucket").isNotNull()).groupBy(*keys, "__bucket").agg(last)
    before = F.last("__last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    table = buckets.select(*keys, "__bucket", before.alias("__before"))
    return joined.join(table, [*keys, "__bucket"], "left").withColumn("__match", F.coalesce("__match", "__before"))
