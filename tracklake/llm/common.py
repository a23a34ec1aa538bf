"""Helpers shared by the operators: reading, shared tables, filtering by id.

Everything that must outlive a stage is written as Parquet under the folder
named by ``spark.checkpoint.dir``, which every executor and the driver can
reach. A lost executor then costs a reread, never a recomputation of the whole
lineage.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids are broadcast up to this many rows (8 bytes each, so about 64 MB as a
#: hash relation); above it the same join runs as a shuffle.
BROADCAST_ROWS = 1_000_000

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by all executors; a local one is set only if a local session names none."""
    place = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="tracklake-")
        spark.conf.set("spark.checkpoint.dir", place)
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tracklake/{tag}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def _clean() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended; the folder is scratch
            return


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver forget finished plans, and wait a little, so that Spark removes their shuffle files before the next large shuffle.

    What Python lets go of is released to the JVM by a thread that looks every
    second; a collection there before it has looked finds the plans still in use.
    """
    gc.collect()
    time.sleep(2)
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def salts(spark: SparkSession) -> int:
    """Into how many parts a hot key is split: a few per shuffle partition."""
    return max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))


def one_of_each(docs: DataFrame, decided: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (doc_id, key, kept) keeps, one for each doc_id and ``key``.

    Rows are named by their doc_id, which may be null, and by ``key``, a hash of
    their text. What goes is written and joined away, broadcast only if a count
    shows at most ``BROADCAST_ROWS`` of them, so the large table is not shuffled;
    otherwise the join is a sort-merge anti-join. Only rows that repeat both
    names are brought together.
    """
    given = F.col("doc_id").cast("bigint")
    named = decided.select(given.alias("__id"), F.col("key").alias("__key"), "kept")
    gone = materialize(named.where(~F.col("kept")).select("__id", "__key").distinct(), "gone-rows")
    repeated = named.where("kept").groupBy("__id", "__key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = materialize(repeated.select("__id", "__key"), "repeated-rows")
    rows = docs.withColumns({"__doc": given, "__hash": key})
    same = F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__key"))

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        small = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        return left.join(F.broadcast(right) if small else right.hint("merge"), same, how)

    out = joined(rows, gone, "left_anti")
    if not repeated.isEmpty():
        once = joined(out, repeated, "left_semi").dropDuplicates(["__doc", "__hash"])
        out = joined(out, repeated, "left_anti").unionByName(once)
    return out.select(*docs.columns)


def only_ids(docs: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is in ``keep``; broadcast under the same check."""
    small = keep.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(keep) if small else keep.hint("merge"), key, "left_semi")
