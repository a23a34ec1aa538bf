"""Tolerant casts: what can't be read becomes null, under ANSI mode too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_double(x: Column) -> Column:
    return x.try_cast("double")


def to_long(x: Column) -> Column:
    return x.try_cast("bigint")


def number_from_text(x: Column, kind: str) -> Column:
    """``x.try_cast(kind)`` of a text column.

    Spark reads a malformed number by raising and catching an error, which costs
    a hundred times the cast; texts that can't begin a number are told by their
    first character instead.
    """
    first = F.substring(F.ltrim(x), 1, 1)
    may = first.between("0", "9") | first.isin("+", "-")
    if kind in ("double", "float"):
        may |= first.isin(".", "n", "N", "i", "I")
    return F.when(may | ~first.between(" ", "~"), x.try_cast(kind))


def parse_timestamp(x: Column, kind: T.DataType) -> Column:
    """A naive timestamp from text, a date or a timestamp of either kind."""
    if isinstance(kind, T.StringType):
        ntz = F.trim(x).try_cast("timestamp_ntz")
        return F.coalesce(ntz, *(F.try_to_timestamp(x, F.lit(f)).try_cast("timestamp_ntz") for f in ("MM/dd/yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss")))
    return x.try_cast("timestamp_ntz")


def with_timestamp(df: DataFrame) -> DataFrame:
    """Add or cast ``ts``: from ``ts`` itself if present, else from ``BaseDateTime``, else leave the frame as it is."""
    for source in ("ts", "BaseDateTime"):
        if source in df.columns:
            return df.withColumn("ts", parse_timestamp(F.col(source), df.schema[source].dataType))
    return df


def epoch_ms(x: Column) -> Column:
    """Epoch milliseconds from seconds, milliseconds or nanoseconds, told apart by magnitude."""
    n = x.try_cast("double")
    exact = x.try_cast("bigint")
    return (
        F.when(n >= 1e15, F.floor(exact / F.lit(1_000_000)))
        .when(n >= 1e12, exact)
        .otherwise((n * 1000).cast("bigint"))
        .cast("bigint")
    )


def millis_of(ts: Column) -> Column:
    """Epoch milliseconds of a naive timestamp, read as UTC."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts).cast("bigint")
