"""A stream source over CSV files: exact pages of rows, and files of any dialect whenever they come.

Every task reads the head of its file itself, so a file that joins the stream
later, with other columns, spellings or separators, is read by its own header.
Columns of the stream are fixed when it is defined; a file's other columns are
left out and those it lacks are null.

Without a page size an offset is a place in the order of files, by time of
change and path, and tasks read slices of ``SLICE`` bytes. With one, an offset
is the number of a page, and each page is a list of slices, written to a log
before the offset is given out: so a page holds exactly as many rows as asked
for (the last one, what is left), across files, and a restarted stream goes on
where the log ends. To cut a page the driver reads that page's bytes and counts
lines; it keeps none of them.

A record is a line, as in the batch scan. Files must not change once they are
there; write them elsewhere and rename them into the folder.
"""

from __future__ import annotations

import csv
import glob
import io
import json
import os
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from tracklake.schema import canonical_names
from tracklake.sources.files import HEAD_BYTES, separator_of

NAME = "tracklake_csv_pages"
#: Bytes of one task, lines of one batch that it hands on, and bytes that the driver counts at a time.
SLICE = 32 << 20
BATCH_LINES = 20_000
COUNTED = 1 << 20


class Store:
    """Files of a local or mounted folder, or of a store that Arrow can reach."""

    def __init__(self, folder: str):
        local = folder.removeprefix("file://").removeprefix("file:") if folder.startswith("file:") else folder
        self.local = "://" not in local
        if self.local:
            self.files, self.root = fs.LocalFileSystem(), local
        else:
            self.files, self.root = fs.FileSystem.from_uri(folder)

    def found(self, pattern: str) -> list[tuple[int, str, int]]:
        """(time of change, path, bytes) of the files that match, in this order. A folder that matches stands for its files."""
        if self.local:
            paths = []
            for path in glob.glob(os.path.join(glob.escape(self.root), pattern)):
                paths += [os.path.join(path, f) for f in os.listdir(path) if f[0] not in "._"] if os.path.isdir(path) else [path]
            stats = [(p, os.stat(p)) for p in paths]
            return sorted((s.st_mtime_ns, p, s.st_size) for p, s in stats)
        from fnmatch import fnmatch

        listed = self.files.get_file_info(fs.FileSelector(self.root, recursive=True))
        inside = [(f, f.path.removeprefix(self.root).lstrip("/")) for f in listed if f.type == fs.FileType.File]
        kept = [f for f, name in inside if name.count("/") <= pattern.count("/") + 1 and (fnmatch(name, pattern) or fnmatch(name.rpartition("/")[0], pattern)) and f.base_name[0] not in "._"]
        return sorted((f.mtime_ns, f.path, f.size) for f in kept)

    def open(self, path: str) -> Any:
        return self.files.open_input_file(path)

    def write(self, path: str, text: str) -> None:
        self.files.create_dir(path.rpartition("/")[0])
        with self.files.open_output_stream(path) as out:
            out.write(text.encode())

    def read(self, path: str) -> str:
        with self.files.open_input_stream(path) as file:
            return file.read().decode()


def first_line(file: Any) -> tuple[str, int]:
    """The first line that isn't blank, and the byte at which the next one begins."""
    size = HEAD_BYTES
    while True:
        file.seek(0)
        head = file.read(size)
        at = 0
        while (end := head.find(b"\n", at)) >= 0 or (len(head) < size and at < len(head)):
            end = len(head) - 1 if end < 0 else end
            if head[at : end + 1].strip():
                return head[at : end + 1].decode("utf-8-sig", errors="replace").strip("\r\n"), end + 1
            at = end + 1
        if len(head) < size:
            return "", len(head)
        size *= 8


class _Slice(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class _Pages(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.store, self.pattern = Store(options["folder"]), options["pattern"]
        self.columns = columns
        self.rows = int(options.get("rows", 0))
        self.log = Store(options["log"]) if self.rows else None
        self.planned: int | None = None

    # -- offsets

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 0} if self.rows else {"changed": 0, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.rows:
            return {"page": self._plan()}
        files = self.store.found(self.pattern)
        return {"changed": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.rows:
            pages = [json.loads(self.log.read(self._entry(n))) for n in range(start["page"] + 1, end["page"] + 1)]
            return [_Slice(*s) for page in pages for s in page["slices"]]
        low, high = (start["changed"], start["path"]), (end["changed"], end["path"])
        files = [(path, size) for changed, path, size in self.store.found(self.pattern) if low < (changed, path) <= high]
        return [_Slice(path, at, min(size, at + SLICE)) for path, size in files for at in range(0, size, SLICE)]

    # -- pages

    def _entry(self, page: int) -> str:
        return f"{self.log.root}/{page:012d}.json"

    def _resume(self) -> None:
        """Pages of the log, the files that they finish, and the file and byte at which the next one begins."""
        self.planned, self.done, self.at = 0, set(), None
        listed = self.log.files.get_file_info(fs.FileSelector(self.log.root, allow_not_found=True))
        for path in sorted(f.path for f in listed if f.path.endswith(".json")):
            page = json.loads(self.log.read(path))
            self.planned = page["page"]
            self.done.update(page["done"])
            self.at = page["at"]

    def _plan(self) -> int:
        """Write the next page to the log if there are rows for it; the number of the last page."""
        if self.planned is None:
            self._resume()
        slices, done, left, at = [], [], self.rows, self.at
        for _, path, size in self.store.found(self.pattern):
            if path in self.done:
                continue
            with self.store.open(path) as file:
                start = at[1] if at and at[0] == path else first_line(file)[1]
                taken, end = self._count(file, start, size, left)
            left -= taken
            if taken:
                slices.append((path, start, end))
            if end < size:
                at = [path, end]
            else:
                done.append(path)
                at = None
            if not left:
                break
        if slices:
            self.planned += 1
            self.log.write(self._entry(self.planned), json.dumps({"page": self.planned, "slices": slices, "done": done, "at": at}))
        self.done.update(done)
        self.at = at
        return self.planned

    @staticmethod
    def _count(file: Any, start: int, size: int, most: int) -> tuple[int, int]:
        """How many lines that aren't blank, ``most`` at most, follow ``start``, and the byte after the last of them."""
        file.seek(start)
        found, at, rest = 0, start, b""
        while at < size:
            block = rest + file.read(min(COUNTED, size - at - len(rest)))
            whole = len(block) if at + len(block) >= size else block.rfind(b"\n") + 1
            place = 0
            while place < whole:
                end = block.find(b"\n", place) + 1 or whole
                if block[place:end].strip():
                    found += 1
                place = end
                if found == most:
                    return found, at + place
            at, rest = at + whole, block[whole:]
        return found, size

    # -- rows

    def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.string()) for c in self.columns])
        with self.store.open(partition.path) as file:
            header, body = first_line(file)
            sep = separator_of(header)
            names = canonical_names(next(csv.reader([header], delimiter=sep), []))
            places = [names.index(c) if c in names else None for c in self.columns]
            start = max(partition.start, body)
            if start > body:  # a line that begins before the slice belongs to the one before
                file.seek(start - 1)
                start += len(_rest_of_line(file)) - 1
            file.seek(start)
            lines = io.BufferedReader(_Raw(file))
            at = start
            while at < partition.end:
                batch = []
                while at < partition.end and len(batch) < BATCH_LINES and (line := lines.readline()):
                    at += len(line)
                    batch.append(line.decode("utf-8", errors="replace"))
                if not batch:
                    return
                rows = [r for r in csv.reader(batch, delimiter=sep) if r]
                columns = [[None] * len(rows) if i is None else [r[i] if i < len(r) and r[i] else None for r in rows] for i in places]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], schema=schema)


class _Raw(io.RawIOBase):
    """An Arrow file as Python's buffers want it."""

    def __init__(self, file: Any):
        self.file = file

    def readable(self) -> bool:
        return True

    def readinto(self, buffer: memoryview) -> int:
        found = self.file.read(len(buffer))
        buffer[: len(found)] = found
        return len(found)


def _rest_of_line(file: Any) -> bytes:
    out = b""
    while block := file.read(HEAD_BYTES):
        end = block.find(b"\n") + 1
        out += block[:end] if end else block
        if end:
            break
    return out


class CsvPages(DataSource):
    """Options: folder, pattern, columns (a JSON list), and for pages rows and log (a folder that lives as long as the checkpoint)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in json.loads(self.options["columns"])])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Pages(dict(self.options), [f.name for f in schema.fields])
