"""Times the three published tasks on point files: scan and write, statistics, events.

Every task reads the files, computes and writes Parquet. Results of each run and
a summary by task are written as CSV and JSON.
"""

from __future__ import annotations

import argparse
import csv
import json
import os
import resource
import time
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.dataset import TrackDataset
from tracklake.operators.stats import row_and_vessel_counts, timing_summary
from tracklake.scratch import scratch
from tracklake.sources.sinks import write_parquet

#: The columns of a US position file.
COLUMNS = "MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading,IMO,CallSign,VesselName,VesselType,Status,Length,Width,Draft,Cargo,TransceiverClass"
#: Rows and vessels of the published day.
ROWS, VESSELS = 7_293_408, 14_857
ENGINE = "spark"


def day_of_points(spark: SparkSession, path: str, rows: int = ROWS, vessels: int = VESSELS) -> str:
    """One day of position reports as CSV files under ``path``; the same for the same size."""
    n, place = F.col("id"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003
    second = F.floor(n * F.lit(86_400.0) / rows).cast("bigint")
    course = F.pmod(n / vessels + F.pmod(n, F.lit(360)) + F.when(place < 0.1, 90).otherwise(0), F.lit(360.0))
    table = spark.range(rows).select(
        (F.pmod(n * 7919, F.lit(vessels)) + 200_000_000).alias("mmsi"),
        F.date_format(F.timestamp_seconds(second + 1_704_067_200), "yyyy-MM-dd'T'HH:mm:ss").alias("base_date_time"),
        F.round(-120 + F.pmod(n, F.lit(vessels)) / 300 + place / 100, 5).alias("longitude"),
        F.round(25 + F.pmod(n * 31, F.lit(vessels)) / 900 + place / 100, 5).alias("latitude"),
        F.round(F.when(F.pmod(F.floor(n / vessels), F.lit(7)) == 0, 0.1).otherwise(place * 20), 1).alias("sog"),
        F.round(course, 1).alias("cog"), F.lit(511).alias("heading"), F.concat(F.lit("VESSEL "), F.pmod(n, F.lit(vessels))).alias("vessel_name"),
        F.concat(F.lit("IMO"), F.pmod(n, F.lit(vessels)) + 9_000_000).alias("imo"), F.lit("WX1").alias("call_sign"), F.lit(70).alias("vessel_type"),
        F.lit(0).alias("status"), F.lit(100).alias("length"), F.lit(20).alias("width"),
        F.round(5 + F.when(place < 0.01, 1).otherwise(0), 1).alias("draft"), F.lit(70).alias("cargo"), F.lit("A").alias("transceiver"),
    )
    table.write.mode("overwrite").option("header", True).csv(path)
    return path


def _tasks(args: argparse.Namespace, spark: SparkSession) -> dict[str, Callable[[], DataFrame]]:
    def dataset(columns: str) -> TrackDataset:
        ds = TrackDataset(args.root, args.pattern, spark).with_columns([c.strip() for c in columns.split(",") if c.strip()])
        return ds.between(args.date_from, args.date_to) if args.date_from else ds

    limits = {k: getattr(args, k) for k in ("turn_deg", "stop_sog", "stop_min", "draft_jump_m", "gap_s")}
    found: dict[str, Callable[[], DataFrame]] = {
        "scan_write_parquet": lambda: dataset(args.cols).lazy(),
        "trajectory_stats": lambda: dataset("MMSI,BaseDateTime,LAT,LON,SOG,COG").stats(),
        "events": lambda: dataset("MMSI,BaseDateTime,SOG,COG,Draft").detect_events(**limits, sort_output=False),
    }
    if args.skip_events:
        del found["events"]
    return found


def run(args: argparse.Namespace, spark: SparkSession) -> list[dict[str, object]]:
    """A row for each task and repeat, after one run of each task that isn't counted."""
    rows: list[dict[str, object]] = []
    for task, make in _tasks(args, spark).items():
        for n in range(args.repeats + 1):
            path = scratch(spark, task)
            began = time.perf_counter()
            write_parquet(make(), path)
            seconds = time.perf_counter() - began
            if n:
                out = spark.read.parquet(path).count()
                peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
                rows.append({"task": task, "engine": ENGINE, "run": n, "seconds": round(seconds, 3), "output_rows": out, "driver_python_peak_mb": round(peak, 1)})
    return rows


def _write_rows(rows: list[dict], stem: Path) -> None:
    with stem.with_suffix(".csv").open("w", newline="", encoding="utf-8") as file:
        writer = csv.DictWriter(file, fieldnames=list(rows[0]))
        writer.writeheader()
        writer.writerows(rows)
    stem.with_suffix(".json").write_text(json.dumps(rows, indent=2), encoding="utf-8")


def write_results(rows: list[dict], out_dir: str | os.PathLike, spark: SparkSession) -> list[dict]:
    """benchmark_results and benchmark_summary under ``out_dir``, each as CSV and JSON; returns the summary."""
    out = Path(out_dir)
    out.mkdir(parents=True, exist_ok=True)
    _write_rows(rows, out / "benchmark_results")
    runs = spark.createDataFrame([(r["task"], r["engine"], float(r["seconds"])) for r in rows], "task string, engine string, seconds double")
    summary = [r.asDict() for r in timing_summary(runs).orderBy("task").collect()]
    _write_rows(summary, out / "benchmark_summary")
    return summary


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracklake.benchmark", description="Times scan, statistics and events on position files.")
    p.add_argument("--root", required=True)
    p.add_argument("--pattern", default="*.csv")
    p.add_argument("--from", dest="date_from")
    p.add_argument("--to", dest="date_to")
    p.add_argument("--cols", default=COLUMNS, help="columns of the scan task")
    p.add_argument("--out-dir", default="results/benchmark")
    p.add_argument("--repeats", type=int, default=3)
    p.add_argument("--include-pandas", action="store_true", help="accepted for old scripts; there is one engine")
    p.add_argument("--skip-events", action="store_true")
    for name, kind, default in (("turn-deg", float, 30.0), ("stop-sog", float, 0.5), ("stop-min", float, 15.0), ("draft-jump-m", float, 0.3), ("gap-s", float, 600.0)):
        p.add_argument(f"--{name}", type=kind, default=default)
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if args.repeats < 1:
        p.error("--repeats must be 1 at least")
    if bool(args.date_from) != bool(args.date_to):
        p.error("--from and --to must be given together")
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.appName("tracklake benchmark").getOrCreate()
    counts = row_and_vessel_counts(TrackDataset(args.root, args.pattern, spark).lazy()).first()
    print(f"{counts['rows']} rows of {counts['vessels']} vessels")
    for row in write_results(run(args, spark), args.out_dir, spark):
        print(row)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
