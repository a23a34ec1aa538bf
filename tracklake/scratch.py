"""What a job needs of its session: folders for what it writes for itself, and a Java option."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


#: Java option: also compile methods beyond 8,000 bytes of code, as Spark generates for scans of many columns.
COMPILE_ALL = "-XX:-DontCompileHugeMethods"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which the driver and all executors can reach.

    Only a local session may leave the setting out; it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tracklake-")
    return f"{base.rstrip('/')}/tracklake/{tag}-{uuid.uuid4().hex}"
