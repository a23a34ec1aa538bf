"""Commands: scan, stats, events, stream-csv."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracklake.dataset import TrackDataset
from tracklake.scratch import COMPILE_ALL, scratch
from tracklake.sources.files import _as_path
from tracklake.sources.sinks import write_table
from tracklake.streaming import detect_events_stream, drain, read_csv_stream, write_json_lines
from tracklake.streaming.sources import use_rocksdb


def parse_mmsi(text: str | None) -> list[int] | None:
    """Numbers separated by commas; blanks are skipped."""
    if not text:
        return None
    try:
        return [int(p) for p in text.split(",") if p.strip()]
    except ValueError:
        raise argparse.ArgumentTypeError(f"MMSI must be numbers separated by commas: {text!r}") from None


def _session() -> tuple[SparkSession, bool]:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active, False
    builder = SparkSession.builder.appName("tracklake").config("spark.sql.session.timeZone", "UTC")
    # Wide scans make methods that the JVM would only interpret.
    builder = builder.config("spark.driver.extraJavaOptions", COMPILE_ALL).config("spark.executor.extraJavaOptions", COMPILE_ALL)
    return builder.config("spark.ui.showConsoleProgress", "false").getOrCreate(), True


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tracklake")
    commands = parser.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("root")
    common.add_argument("--pattern", default="*.csv")
    common.add_argument("--from", dest="start")
    common.add_argument("--to", dest="end")
    common.add_argument("--mmsi", type=parse_mmsi)
    limits = argparse.ArgumentParser(add_help=False)
    for name, default in (("turn-deg", 30.0), ("stop-sog", 0.5), ("stop-min", 15.0), ("draft-jump-m", 0.3), ("gap-s", 600.0)):
        limits.add_argument(f"--{name}", type=float, default=default)
    engines = ("polars", "polars-stream", "dask", "spark")  # accepted for old scripts; one engine serves all
    scan = commands.add_parser("scan", parents=[common])
    scan.add_argument("--cols")
    scan.add_argument("--to-parquet")
    scan.add_argument("--partition")
    scan.add_argument("--html")
    scan.add_argument("--engine", choices=engines, default="spark")
    scan.add_argument("--stream", action=argparse.BooleanOptionalAction, default=False)
    scan.add_argument("--sort-output", action=argparse.BooleanOptionalAction, default=False)
    stats = commands.add_parser("stats", parents=[common])
    stats.add_argument("--level", default="mmsi")
    stats.add_argument("--mode", choices=("lazy", "eager"), default="lazy")
    stats.add_argument("--engine", choices=engines, default="spark")
    stats.add_argument("--out")
    events = commands.add_parser("events", parents=[common, limits])
    draft = events.add_mutually_exclusive_group()
    draft.add_argument("--include-draft-events", dest="draft", action="store_true", default=True)
    draft.add_argument("--skip-draft-events", dest="draft", action="store_false")
    events.add_argument("--out")
    stream = commands.add_parser("stream-csv", parents=[limits])
    stream.add_argument("path")
    stream.add_argument("--pattern", default="*.csv")
    stream.add_argument("--chunk-size", type=int, default=10_000, help="rows of a batch")
    stream.add_argument("--checkpoint", help="a folder for the state; a later run with it goes on where this one ends")
    stream.add_argument("--mmsi", type=parse_mmsi)
    return parser


def _dataset(args: argparse.Namespace, spark: SparkSession) -> TrackDataset:
    ds = TrackDataset(args.root, args.pattern, spark)
    if args.start:
        ds = ds.between(args.start, args.end)
    return ds.filter(mmsi=args.mmsi) if args.mmsi else ds


def _limits(args: argparse.Namespace) -> dict[str, float]:
    return {k: getattr(args, k) for k in ("turn_deg", "stop_sog", "stop_min", "draft_jump_m", "gap_s")}


def _run(args: argparse.Namespace, spark: SparkSession) -> None:
    if args.command == "stream-csv":
        use_rocksdb(spark)
        folder, pattern = (args.path, args.pattern) if os.path.isdir(args.path) else os.path.split(os.path.abspath(args.path))
        state = args.checkpoint or scratch(spark, "stream-csv")
        points = read_csv_stream(spark, folder, pattern, rows_per_batch=args.chunk_size, log=f"{_as_path(state)}/pages")
        if args.mmsi:
            points = points.where(F.col("MMSI").try_cast("bigint").isin(args.mmsi))
        drain(write_json_lines(detect_events_stream(points, **_limits(args)), checkpoint=state, pages=True))
        return
    ds = _dataset(args, spark)
    if args.command == "scan":
        if args.cols:
            ds = ds.with_columns([c.strip() for c in args.cols.split(",") if c.strip()])
        if args.stream:
            ds.stats().show(5)
        if args.to_parquet:
            print(f"Wrote {ds.write_parquet(args.to_parquet, args.partition, sort_rows=args.sort_output)}")
        if args.html:
            print(f"Wrote {ds.plot_map(args.html)}")
        if not (args.to_parquet or args.html or args.stream):
            ds.lazy()
            print(f"{len(ds.files)} file(s), columns: {', '.join(ds.columns())}")
        return
    if args.command == "stats":
        result = ds.stats(args.level, args.mode)
    else:
        result = ds.detect_events(**_limits(args), include_draft_changes=args.draft, sort_output=not args.out)
    if args.out:
        print(f"Wrote {write_table(result, args.out)}")
    else:
        result.show(20)


def main(argv: Sequence[str] | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    if bool(getattr(args, "start", None)) != bool(getattr(args, "end", None)):
        parser.error("--from and --to must be given together")
    spark, own = _session()
    try:
        _run(args, spark)
    except (ValueError, FileNotFoundError) as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 2
    finally:
        if own:
            spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
