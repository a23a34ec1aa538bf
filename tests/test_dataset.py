"""Files, headers, the dataset builder, output, the command line and the stream."""

import json

import pytest

from tracklake import TrackDataset, normalize_columns, process_stream, write_parquet
from tracklake.cli import main
from tracklake.dataset import parse_temporal
from tracklake.schema import canonical_names, existing_columns
from tracklake.sources import discover_files, sniff_separator, write_table
from tracklake.streaming import detect_events_stream
from tracklake.streaming.sources import use_rocksdb

HEADER = "MMSI,BaseDateTime,LAT,LON,SOG,COG,Draft\n"
A = "111,2024-01-01T00:00:00,54.0,18.0,10.0,90.0,7.0\n111,2024-01-01T00:10:00,54.001,18.001,12.0,100.0,7.0\n"
B = "222;2024-01-01T01:00:00;55.0;19.0;0.1;10.0;5.0\n222;2024-01-01T02:00:00;95.0;19.0;0.1;10.0;5.0\n"


@pytest.fixture
def folder(tmp_path):
    place = tmp_path / "data"
    place.mkdir()
    (place / "a.csv").write_text("\ufeff" + HEADER + A, encoding="utf-8")
    (place / "b.csv").write_text(" mmsi ;base_date_time;latitude;longitude;sog;cog;draught\n" + B)
    return place


def test_discovery_and_separators(folder, spark):
    assert [f.rpartition("/")[2] for f in discover_files(folder)] == ["a.csv", "b.csv"]
    assert [f.rpartition("/")[2] for f in discover_files(f"file://{folder}", spark=spark)] == ["a.csv", "b.csv"]
    assert sniff_separator(folder / "b.csv") == ";" and sniff_separator(folder / "a.csv") == ","
    with pytest.raises(FileNotFoundError):
        discover_files(folder, "*.txt")


def test_header_names():
    assert canonical_names(["mmsi", "MMSI", "x"]) == ["mmsi_2", "MMSI", "x"]
    assert canonical_names(["ts", "lng", "class", "Speed"]) == ["BaseDateTime", "LON", "TransceiverClass", "Speed"]
    assert canonical_names(["timestamp", "time"]) == ["BaseDateTime", "time"]


def test_vendor_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "Longitude double, Latitude double, Speed double, LAT double")
    assert normalize_columns(df).columns == ["LON", "Latitude", "SOG", "LAT"]


def test_existing_columns():
    assert existing_columns(["a", "b", "c"], ["c", "x", "a", "c"], ["b", "a"]) == ["c", "a", "b"]
    with pytest.raises(ValueError, match="None of the requested columns.*a, b"):
        existing_columns(["a", "b"], ["x"])


def test_spellings_are_united(folder, spark):
    df = TrackDataset(folder, spark=spark).lazy()
    assert {r.MMSI for r in df.collect()} == {111, 222}
    assert df.count() == 3  # one row has a latitude of 95


def test_filters(folder, spark):
    ds = TrackDataset(folder, spark=spark)
    assert ds.filter(mmsi=222).lazy().count() == 1 and ds.filter(mmsi={"111", None}).lazy().count() == 2
    assert ds.between("2024-01-01", "2024-01-01T00:10:00").lazy().count() == 1
    assert ds.lazy().count() == 3  # the first dataset is unchanged
    cut = ds.with_columns(["SOG"]).filter(mmsi=222)
    assert cut.columns() == ["SOG"] and cut.lazy().count() == 2  # no coordinates, no check of them
    with pytest.raises(ValueError):
        ds.filter(callsign="x").lazy()
    with pytest.raises(ValueError, match="Could not parse"):
        parse_temporal("yesterday")


def test_imo_filter(spark, tmp_path):
    (tmp_path / "i.csv").write_text("MMSI,IMO,CallSign\n1,IMO0000007,AB\n2,8,CD\n")
    ds = TrackDataset(tmp_path, spark=spark)
    assert [r.IMO for r in ds.lazy().orderBy("MMSI").collect()] == [None, 8]
    assert ds.filter(imo="IMO0000007").lazy().first().MMSI == 1 and ds.filter(imo=8).lazy().first().MMSI == 2
    assert ds.filter(callsign=["CD", "XX"]).lazy().first().MMSI == 2


def test_ragged_and_empty_fields(spark, tmp_path):
    (tmp_path / "r.csv").write_text("MMSI,SOG,x\n1,,a,b,c\n2\n3,fast\n")
    rows = {r.MMSI: r for r in TrackDataset(tmp_path, spark=spark).lazy().collect()}
    assert set(rows) == {1, 2, 3} and rows[1].SOG is None and rows[3].SOG is None and rows[2].x is None


def test_analytics_and_output(folder, spark, tmp_path):
    ds = TrackDataset(folder, spark=spark)
    assert ds.stats().count() == 2 and ds.detect_events(gap_s=60).count() >= 1
    out = ds.write_parquet(tmp_path / "deep" / "out", "year/month", sort_rows=True)
    assert (out / "year=2024" / "month=1").is_dir()
    back = TrackDataset.from_frame(spark.read.parquet(str(out)))
    assert back.between("2024-01-01", "2024-01-02").lazy().count() == 3
    assert TrackDataset.from_frame(spark.read.parquet(str(ds.write_parquet(tmp_path / "flat")))).lazy().count() == 3
    parquet = TrackDataset(tmp_path / "flat", "*.parquet", spark=spark)
    assert parquet.filter(mmsi=111).lazy().count() == 2
    assert write_parquet(ds.stats(), tmp_path / "s").is_dir()
    csv = write_table(ds.stats(), tmp_path / "s.csv")
    assert spark.read.option("header", True).csv(str(csv)).count() == 2


def test_map(folder, spark, tmp_path):
    ds = TrackDataset(folder, spark=spark)
    page = ds.plot_map(tmp_path / "m" / "map.html", mmsi=111).read_text()
    assert "polyline" in page and 'data-zoom="8"' in page and "[54.0, 18.0]" in page
    with pytest.raises(ValueError):
        ds.plot_map(tmp_path / "x.html", mmsi=5)
    with pytest.raises(ValueError):
        ds.with_columns(["SOG"]).plot_map(tmp_path / "x.html")


def test_commands(folder, spark, tmp_path, capsys):
    where = str(folder)
    assert main(["scan", where]) == 0 and "2 file(s)" in capsys.readouterr().out
    assert main(["scan", where, "--from", "2024-01-01", "--to", "2024-01-02", "--mmsi", "111,", "--to-parquet", str(tmp_path / "p"), "--html", str(tmp_path / "p.html")]) == 0
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert main(["stats", where, "--out", str(tmp_path / "st.csv")]) == 0 and (tmp_path / "st.csv").exists()
    assert main(["stats", where, "--engine", "polars-stream"]) == 0
    assert main(["events", where, "--gap-s", "60", "--skip-draft-events"]) == 0 and "gap" in capsys.readouterr().out
    assert main(["scan", str(tmp_path / "none")]) == 2
    for bad in (["scan", where, "--from", "2024-01-01"], ["scan", where, "--mmsi", "x"]):
        with pytest.raises(SystemExit):
            main(bad)


RECORDS = [
    (v, 1_710_000_000_000 + i * 500_000 + (i * v) % 3 * 200_000, float(i * 47 * v % 360), [0.1, 5.0, 0.2, 0.3][(i // 3 + v) % 4], 5 + (i * v % 4) / 4)
    for v in (1, 2, 3)
    for i in range(40)
]


@pytest.mark.parametrize("files", [1, 4])
def test_stream_equals_fold_for_any_batches(spark, tmp_path, files):
    records = sorted(RECORDS, key=lambda r: r[1])
    step = -(-len(records) // files)
    schema = "MMSI bigint, ts bigint, COG double, SOG double, Draft double"
    for k in range(files):
        spark.createDataFrame(records[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    use_rocksdb(spark)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = detect_events_stream(stream, stop_min=5).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(v for v in r if v is not None) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    names = ("MMSI", "ts", "COG", "SOG", "Draft")
    want = sorted(tuple(e.values()) for e in process_stream((dict(zip(names, r, strict=True)) for r in records), stop_min=5))
    assert got == want and {e[0] for e in want} == {"gap", "sharp_turn", "stop", "draft_change"}


def test_stream_csv_command(spark, tmp_path, capsys):
    rows = [("MMSI", "BaseDateTime", "SOG", "COG", "Draft"), (1, "2024-01-01T00:00:00", 5, 0, 5), (1, "2024-01-01T00:20:00", 5, 90, 6), (2, "2024-01-01T00:00:00", 5, 0, 5)]
    (tmp_path / "s.csv").write_text("\n".join(",".join(map(str, r)) for r in rows))
    assert main(["stream-csv", str(tmp_path / "s.csv"), "--mmsi", "1"]) == 0
    found = [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert {e["type"] for e in found} == {"gap", "sharp_turn", "draft_change"}


def test_json_lines(spark):
    from tracklake.operators.events import detect_events
    from tracklake.streaming.sources import event_json

    df = spark.sql("select 1L as MMSI, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id * 20) as ts from range(2)")
    assert json.loads(event_json(detect_events(df)).first().json) == {"type": "gap", "MMSI": 1, "ts": "2024-01-01T00:20:00.000", "gap_s": 1200}


def read_stream(frame, tmp_path, tag):
    query = frame.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / f"{tag}-out"))
    query.option("checkpointLocation", str(tmp_path / f"{tag}-state")).trigger(availableNow=True).start().awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(str(tmp_path / f"{tag}-out"))


def test_stream_of_differing_files(spark, tmp_path):
    """Files whose columns stand in another order, have other names, or are missing; names with signs that patterns use."""
    from tracklake.streaming import read_csv_stream

    place = tmp_path / "in {a,b}"
    place.mkdir()
    (place / "one.csv").write_text("MMSI,BaseDateTime,SOG,COG\n1,2024-01-01T00:00:00,7,200\n")
    (place / "two [x].csv").write_text("mmsi;timestamp;cog;sog\n2;2024-01-01T00:00:00;200;7\n")
    (place / "three*.csv").write_text("MMSI,SOG\n3,7\n4,7\n")
    got = read_stream(read_csv_stream(spark, place, rows_per_batch=1), tmp_path, "mixed").collect()
    assert sorted((r.MMSI, r.SOG, r.COG, r.BaseDateTime is None) for r in got) == [("1", "7", "200", False), ("2", "7", "200", False), ("3", "7", None, True), ("4", "7", None, True)]
    with pytest.raises(FileNotFoundError):
        read_csv_stream(spark, place, "*.txt")


def test_stream_takes_later_files_of_one_kind(spark, tmp_path):
    from tracklake.streaming import read_csv_stream

    place = tmp_path / "in"
    place.mkdir()
    (place / "a.csv").write_text("MMSI,SOG\n1,7\n")
    assert read_stream(read_csv_stream(spark, place), tmp_path, "one").count() == 1
    (place / "b.csv").write_text("MMSI,SOG\n2,7\n")
    assert read_stream(read_csv_stream(spark, place), tmp_path, "one").count() == 2


def test_stream_command_goes_on_from_a_checkpoint(spark, tmp_path, capsys):
    place = tmp_path / "in"
    place.mkdir()
    args = ["stream-csv", str(place), "--chunk-size", "10", "--checkpoint", str(tmp_path / "state")]
    for name, hour in (("a", "00"), ("b", "02")):
        (place / f"{name}.csv").write_text(f"MMSI,BaseDateTime,SOG,COG\n1,2024-01-01T{hour}:00:00,5,0\n")
        assert main(args) == 0
    found = [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert [(e["type"], e["gap_s"]) for e in found] == [("gap", 7200)]


def test_days_outside_the_range_are_not_read(spark, tmp_path):
    spark.sql(
        "select 1L as MMSI, timestamp_ntz'2024-01-30' + make_dt_interval(cast(id as int), 0, 0, 0) as ts, 54.0D as LAT, 18.0D as LON from range(40)"
    ).createOrReplaceTempView("days")
    ds = TrackDataset.from_frame(spark.table("days"))
    for layout, files in (("year/month/day", 3), ("year/month", 2), ("year", 1)):
        where = tmp_path / layout.replace("/", "-")
        ds.write_parquet(where, layout)
        found = TrackDataset.from_frame(spark.read.parquet(str(where))).between("2024-01-31", "2024-02-02T12:00:00").lazy()
        assert found.count() == 3
        assert len({f.split("part-")[0] for f in found.selectExpr("_metadata.file_path as f").distinct().toPandas()["f"]}) == files
        read = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in read and "year" in read.split("PartitionFilters: [")[1].split("]")[0]


def test_benchmark_command(spark, tmp_path):
    from tracklake import benchmark

    root = benchmark.day_of_points(spark, str(tmp_path / "day"), rows=2000, vessels=50)
    out = tmp_path / "results"
    args = ["--root", root, "--from", "2024-01-01", "--to", "2024-01-02", "--repeats", "2", "--out-dir", str(out), "--include-pandas"]
    assert benchmark.main(args, spark) == 0
    runs = json.loads((out / "benchmark_results.json").read_text())
    assert {(r["task"], r["run"]) for r in runs} == {(t, n) for t in ("scan_write_parquet", "trajectory_stats", "events") for n in (1, 2)}
    assert {r["output_rows"] for r in runs if r["task"] == "trajectory_stats"} == {50}
    assert {r["output_rows"] for r in runs if r["task"] == "scan_write_parquet"} == {2000}
    assert len((out / "benchmark_summary.csv").read_text().splitlines()) == 4
    assert benchmark.main([*args[:-1], "--skip-events"], spark) == 0
    assert len(json.loads((out / "benchmark_summary.json").read_text())) == 2


def test_numbers_in_text_columns(spark):
    """The cast by first characters reads what the plain cast reads."""
    from pyspark.sql import functions as F

    from tracklake.functions.parsing import number_from_text

    texts = ["1", " 2", "+3", "-4 ", "5.5", ".5", "NaN", "nan", "Infinity", "-inf", "inf", "1e3", "IMO7", "n/a", "", " ", None, "x", "٣", "\t6", "\n7", "1 2", "0x1", "1L", "1d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for kind in ("bigint", "double"):
        rows = df.select("t", number_from_text(F.col("t"), kind).cast("string").alias("a"), F.col("t").try_cast(kind).cast("string").alias("b")).collect()
        assert [(r.t, r.a) for r in rows] == [(r.t, r.b) for r in rows]


def test_heads_of_many_files_are_read_by_tasks(spark, tmp_path, monkeypatch):
    from tracklake.sources import files, scan_many

    monkeypatch.setattr(files, "HEADS_ON_DRIVER", 3)
    monkeypatch.setattr(files, "HEADS_PER_TASK", 2)
    for i in range(7):
        header, sep = (("MMSI,SOG", ","), ("sog;mmsi", ";"), ("", ","))[i % 3]
        (tmp_path / f"{i}.csv").write_text(header + ("\n" + sep.join(("1", "7") if header[:1] == "M" else ("7", "1")) if header else ""))
    got = scan_many(spark, tmp_path).collect()
    assert sorted((r.MMSI, r.SOG) for r in got) == [("1", "7")] * 5


def test_parquet_schemas_are_merged_on_request(spark, tmp_path):
    spark.sql("select 1L as MMSI, 54.0D as LAT, 18.0D as LON").write.parquet(str(tmp_path / "a.parquet"))
    spark.sql("select 2L as MMSI, 54.0D as LAT, 18.0D as LON, 7.0D as SOG").write.parquet(str(tmp_path / "b.parquet"))
    merged = TrackDataset(tmp_path, "*.parquet", spark, merge_schema=True).lazy().collect()
    assert sorted((r.MMSI, r.SOG) for r in merged) == [(1, None), (2, 7.0)]
    assert TrackDataset(tmp_path, "*.parquet", spark).lazy().count() == 2
