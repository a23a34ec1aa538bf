"""Exact pages of rows, files of other dialects that come later, and slices of long files."""

import json
import os

import pytest

from tracklake.streaming import drain, paged, read_csv_stream
from tracklake.cli import main


def batches_of(frame, checkpoint, drained=True):
    """Rows of each micro-batch."""
    found = []
    writer = frame.writeStream.foreachBatch(lambda df, n: found.append([tuple(r) for r in df.collect()])).option("checkpointLocation", str(checkpoint))
    if drained:
        drain(writer.trigger(processingTime="0 seconds").start())
    else:
        writer.trigger(availableNow=True).start().awaitTermination()
    return [b for b in found if b]


def numbered(place, name, first, n, header="MMSI,SOG", sep=",", when=None):
    lines = [header, *(sep.join(map(str, ((first + i, 7) if header.startswith("M") else (7, first + i)))) for i in range(n))]
    (place / name).write_text("\n".join(lines))
    if when is not None:
        os.utime(place / name, ns=(when, when))


@pytest.fixture
def place(tmp_path):
    folder = tmp_path / "in {x,y}*"
    folder.mkdir()
    return folder


def test_pages_of_one_file(spark, place, tmp_path):
    numbered(place, "a.csv", 1, 10)
    got = batches_of(read_csv_stream(spark, place, rows_per_batch=3, log=str(tmp_path / "log")), tmp_path / "state")
    assert [len(b) for b in got] == [3, 3, 3, 1]
    assert [r[0] for b in got for r in sorted(b, key=lambda r: int(r[0]))] == [str(i) for i in range(1, 11)]


def test_pages_across_files_and_restarts(spark, place, tmp_path, monkeypatch):
    monkeypatch.setattr(paged, "COUNTED", 7)
    (place / "empty.csv").write_text("")
    (place / "head.csv").write_text("\n\nMMSI,SOG\n\n")
    numbered(place, "a.csv", 1, 4, when=10)
    (place / "b.csv").write_text("\n\r\nsog;mmsi\r\n7;5\r\n\r\n7;6\r\n\n")
    numbered(place, "c.csv", 7, 5)
    args = {"rows_per_batch": 5, "log": str(tmp_path / "log")}
    got = batches_of(read_csv_stream(spark, place, **args), tmp_path / "state")
    assert [len(b) for b in got] == [5, 5, 1]
    numbered(place, "d.csv", 12, 7, header="Speed Over Ground|mmsi", sep="|")
    more = batches_of(read_csv_stream(spark, place, **args), tmp_path / "state")
    assert [len(b) for b in more] == [5, 2]
    rows = sorted((int(m), s) for b in got + more for m, s in (sorted(r, key=lambda v: v == "7") for r in b))
    assert rows == [(i, "7") for i in range(1, 19)]
    assert batches_of(read_csv_stream(spark, place, **args), tmp_path / "state") == []


def test_a_file_of_another_dialect_joins_a_running_stream(spark, place, tmp_path):
    (place / "one.csv").write_text("MMSI,ts,SOG,COG\n1,2024-01-01,7,200\n")
    frame = read_csv_stream(spark, place)
    assert batches_of(frame, tmp_path / "state", drained=False) == [[("1", "2024-01-01", "7", "200")]]
    (place / "two.csv").write_text("MMSI,ts,COG,SOG,extra\n2,2024-01-02,200,7,x\n3,2024-01-02,,7\n4\n")
    (place / "three.csv").write_text("ship;mmsi\nA;5\n")
    (again,) = batches_of(frame, tmp_path / "state", drained=False)
    assert sorted(again) == [("2", "2024-01-02", "7", "200"), ("3", "2024-01-02", "7", None), ("4", None, None, None), ("5", None, None, None)]


@pytest.mark.parametrize("size", [1, 5, 64])
def test_slices_hold_each_line_once(spark, place, tmp_path, monkeypatch, size):
    (place / "a.csv").write_text("MMSI,SOG\n" + "".join(f"{i},{'9' * (i % 13)}\n" for i in range(60)) + '"60","quoted, text"')
    reader = paged._Pages({"folder": str(place), "pattern": "*.csv"}, ["MMSI", "SOG"])
    monkeypatch.setattr(paged, "SLICE", size)
    slices = reader.partitions(reader.initialOffset(), reader.latestOffset())
    rows = [r for s in slices for batch in reader.read(s) for r in batch.to_pylist()]
    assert [r["MMSI"] for r in rows] == [str(i) for i in range(61)] and rows[-1]["SOG"] == "quoted, text" and rows[0]["SOG"] is None


def test_command_takes_pages(place, spark, tmp_path, capsys):
    rows = "".join(f"1,2024-01-01T{i:02d}:00:00,5,0\n" for i in range(10))
    (place / "a.csv").write_text("MMSI,BaseDateTime,SOG,COG\n" + rows)
    assert main(["stream-csv", str(place), "--chunk-size", "3", "--checkpoint", str(tmp_path / "state")]) == 0
    found = [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert [e["gap_s"] for e in found] == [3600] * 9
    pages = [json.loads((tmp_path / "state" / "pages" / f).read_text()) for f in sorted(os.listdir(tmp_path / "state" / "pages"))]
    assert len(pages) == 4 and pages[-1]["done"] == [str(place / "a.csv")]
