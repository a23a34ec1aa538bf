"""Writers. All write in parallel, one file or more for each task."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Layouts of partitioned output, by name; a fixed set.
LAYOUTS = {"year": 1, "year/month": 2, "year/month/day": 3}


def write_parquet(df: DataFrame, path: str | os.PathLike) -> Path:
    df.write.mode("overwrite").parquet(os.fspath(path))
    return Path(path)


def write_partitioned(df: DataFrame, path: str | os.PathLike, partition: str | None = None, sort_by: tuple[str, ...] = ()) -> Path:
    """Parquet with year, month and day columns, in folders to the depth that ``partition`` names.

    Rows of one folder go to one task for each of its folders' share, so a day
    makes few files. Without ``ts``, or for an unknown ``partition``, the output
    is not partitioned.
    """
    depth = LAYOUTS.get((partition or "").lower(), 0) if "ts" in df.columns else 0
    if not depth:
        df = df.orderBy(*sort_by) if sort_by else df
        return write_parquet(df, path)
    ts = F.col("ts")
    df = df.withColumns({"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts)})
    folders = ["year", "month", "day"][:depth]
    # Adaptive rebalancing splits a folder that holds most of the rows.
    df = df.hint("rebalance", *folders)
    if sort_by:
        df = df.sortWithinPartitions(*folders, *sort_by)
    df.write.mode("overwrite").partitionBy(*folders).parquet(os.fspath(path))
    return Path(path)


def write_table(df: DataFrame, path: str | os.PathLike) -> Path:
    """CSV with a header if the path ends in .csv, else Parquet."""
    if os.fspath(path).lower().endswith(".csv"):
        df.write.mode("overwrite").option("header", True).csv(os.fspath(path))
        return Path(path)
    return write_parquet(df, path)
