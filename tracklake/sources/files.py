"""Discovery and tolerant reading of CSV files with differing separators and headers.

Only the head of each file is read to tell its dialect, by the driver if there
are few files and else by tasks. Files that share separator and header are read
by one scan with an explicit all-text schema, so Spark infers nothing and prunes
columns; scans are then united by name.
"""

from __future__ import annotations

import csv
import glob
import os
from collections import defaultdict
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tracklake.schema import canonical_names, normalize_header

SEPARATORS = (",", ";", "\t", "|")
HEAD_BYTES = 8192
#: Files whose heads the driver reads itself, and of those that a task reads beyond that.
HEADS_ON_DRIVER = 256
HEADS_PER_TASK = 500


def _is_remote(path: str) -> bool:
    return "://" in path or path.startswith("file:")


def discover_files(root: str | os.PathLike, pattern: str = "*.csv", spark: SparkSession | None = None) -> list[str]:
    """Sorted paths that match; a path with a scheme is listed through Hadoop's file system."""
    where = os.path.join(os.fspath(root), pattern)
    if _is_remote(where):
        spark = spark or SparkSession.getActiveSession()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files = []
        for found in fs.globStatus(path) or []:
            inner = fs.listStatus(found.getPath()) if found.isDirectory() else [found]
            files += [f.getPath().toString() for f in inner if f is found or f.getPath().getName()[0] not in "._"]
        files.sort()
    else:
        files = []
        for found in sorted(glob.glob(where)):  # a folder written by Spark stands for its files
            inner = sorted(os.listdir(found)) if os.path.isdir(found) else None
            files += [found] if inner is None else [os.path.join(found, f) for f in inner if f[0] not in "._"]
    if not files:
        raise FileNotFoundError(f"No files match: {where}")
    return files


def _head(path: str, size: int, spark: SparkSession | None) -> str:
    if not _is_remote(path):
        with open(path, "rb") as file:
            raw = file.read(size)
    else:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
        try:
            raw = bytes(stream.readNBytes(size))
        finally:
            stream.close()
    return raw.decode("utf-8-sig", errors="replace")


def _header_line(head: str) -> str:
    return next((line for line in head.splitlines() if line.strip()), "")


def separator_of(line: str) -> str:
    """The most frequent separator of a line; of equals the earlier in the list; a comma if there is none."""
    best = max(SEPARATORS, key=lambda s: (line.count(s), -SEPARATORS.index(s)))
    return best if line.count(best) else ","


def sniff_separator(path: str | os.PathLike, sample_bytes: int = HEAD_BYTES, spark: SparkSession | None = None) -> str:
    return separator_of(_header_line(_head(os.fspath(path), sample_bytes, spark)))


def _dialect(path: str, spark: SparkSession | None) -> tuple[str, tuple[str, ...]]:
    size = HEAD_BYTES
    while True:
        head = _head(path, size, spark)
        line = _header_line(head)
        if len(head.splitlines()) > 1 or len(head.encode()) < size - 4 or size > 1 << 24:
            break
        size *= 8  # the header itself is longer than the sample
    sep = separator_of(line)
    return sep, tuple(next(csv.reader([line], delimiter=sep), []))


def _dialects(files: Sequence[str], spark: SparkSession) -> list[tuple[str, tuple[str, ...]]]:
    """The dialect of each file. Heads of many files that any task can open are read by tasks."""
    if len(files) <= HEADS_ON_DRIVER or any(map(_is_remote, files)):
        with ThreadPoolExecutor(min(32, len(files))) as pool:
            return list(pool.map(lambda f: _dialect(f, spark), files))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_dialect(path, None) for path in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found]), pa.array([list(f[1]) for f in found], pa.list_(pa.string()))], ["n", "sep", "header"]
            )

    table = spark.createDataFrame(list(enumerate(files)), "n bigint, path string").repartition(-(-len(files) // HEADS_PER_TASK))
    rows = sorted(table.mapInArrow(read, "n bigint, sep string, header array<string>").collect(), key=lambda r: r.n)
    return [(r.sep, tuple(r.header)) for r in rows]


def _as_path(path: str) -> str:
    return path if _is_remote(path) else "file://" + os.path.abspath(path)


def scan_files(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """All files as text columns with canonical names; columns that a file lacks are null."""
    files = [os.fspath(f) for f in files]
    if not files:
        raise FileNotFoundError("No files match: the list of files is empty")
    groups: dict[tuple[str, tuple[str, ...]], list[str]] = defaultdict(list)
    for path, dialect in zip(files, _dialects(files, spark), strict=True):
        groups[dialect].append(path)
    frames = []
    for (sep, header), paths in groups.items():
        if not header:
            continue
        names = canonical_names(header)  # names are set for each file before the union, so spellings never split a column
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        frames.append(
            spark.read.schema(schema)
            .options(header=True, sep=sep, mode="PERMISSIVE", enforceSchema=True)
            .csv([_as_path(p) for p in paths])
        )
    if not frames:
        return spark.createDataFrame([], "MMSI string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def scan_many(spark: SparkSession, root: str | os.PathLike, pattern: str = "*.csv") -> DataFrame:
    return scan_files(spark, discover_files(root, pattern, spark))


def scan_parquet(spark: SparkSession, paths: str | Sequence[str], merge_schema: bool = False) -> DataFrame:
    """Parquet files or folders, with canonical names.

    Columns are those of one file; ``merge_schema`` reads the footers of all, for files that differ in columns.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    return normalize_header(spark.read.option("mergeSchema", merge_schema).parquet(*map(_as_path, paths)))
