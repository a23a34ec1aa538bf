"""Stream sources and sinks."""

from __future__ import annotations

import json
import os
import sys
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracklake.schema import canonical_names
from tracklake.sources.files import _as_path, _dialects, discover_files
from tracklake.streaming.paged import CsvPages

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _columns(files: list[str], spark: SparkSession) -> list[str]:
    """Canonical names of all files' columns."""
    return list(dict.fromkeys(name for _, header in _dialects(files, spark) for name in canonical_names(header)))


def read_csv_stream(
    spark: SparkSession, folder: str | os.PathLike, pattern: str = "*.csv", rows_per_batch: int | None = None, log: str | None = None
) -> DataFrame:
    """A stream over the CSV files of a folder, oldest first, as text columns with canonical names.

    Files may differ in separator, header and columns, also those that come
    later; columns are those of the files that are there now. A batch takes all
    files that wait. With ``rows_per_page`` it takes exactly so many rows, or
    those left, by a log in the folder ``log`` that must be kept with the
    query's checkpoint; start such a query with a trigger of its own (the
    trigger availableNow ends after one page) and ``drain`` it.
    """
    columns = _columns(discover_files(folder, pattern, spark), spark)
    if not columns:
        raise ValueError(f"No file with a header matches {pattern} in {folder}")
    spark.dataSource.register(CsvPages)
    reader = spark.readStream.format(CsvPages.name()).options(folder=_as_path(os.fspath(folder)), pattern=pattern, columns=json.dumps(columns))
    if rows_per_batch and log:
        reader = reader.options(rows=rows_per_batch, log=log)
    return reader.load()


def drain(query: StreamingQuery) -> None:
    """Wait until a query has read what there is, and stop it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def event_json(events: DataFrame) -> DataFrame:
    """One JSON text for each event, without null fields."""
    return events.select(F.to_json(F.struct("*")).alias("json"))


def write_json_lines(events: DataFrame, out: TextIO | None = None, checkpoint: str | None = None, pages: bool = False) -> StreamingQuery:
    """Start a query that prints each event as a JSON line and ends when the source is read; with ``pages`` it goes on until it is drained."""

    def show(batch: DataFrame, _: int) -> None:
        for row in event_json(batch).toLocalIterator():
            print(row.json, file=out or sys.stdout, flush=True)

    writer = events.writeStream.outputMode("append").foreachBatch(show)
    writer = writer.trigger(processingTime="0 seconds") if pages else writer.trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()
