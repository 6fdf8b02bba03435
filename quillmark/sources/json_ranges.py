"""Damaged JSON files as a data source: byte ranges of a file are read by many tasks, and each finds its own first object.

A record is an object that decodes, has at most `longest` bytes and is met by a scan from the file's beginning that steps over whole records and over single bytes of
anything else. An object longer than that holds records, it is none. A range's reader needs to know where such a scan stands when it enters the range: it looks for a
clean cut, a place at or before the range that no decodable object reaches over. Any scan passes there, so a scan from the cut is the file's own, whatever the ranges are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

SCHEMA = "path string, start long, pos int, value string"
#: Rows of one batch that goes to Spark.
BATCH = 1024
_DECODER = json.JSONDecoder()
#: An object begins with a key or ends at once.
_OPEN = re.compile(r'\{[ \t\r\n]*["}]')


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


class _File:
    """Reads of a file as one character a byte, so that places are bytes."""

    def __init__(self, path: str):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self._file = system.open_input_file(at)
        self.size = self._file.size()

    def text(self, start: int, stop: int) -> str:
        return self._file.read_at(min(stop, self.size) - start, start).decode("latin-1") if start < min(stop, self.size) else ""

    def close(self) -> None:
        self._file.close()


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files of a folder whose names don't begin with . or _, by path."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(at)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ("file://" if path.startswith("file:") else "")
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def _end(text: str, at: int, longest: int) -> int | None:
    """Where the object at a place ends, if it decodes and is short enough."""
    try:
        end = _DECODER.raw_decode(text, at)[1]
    except (ValueError, RecursionError):
        return None
    return end if end - at <= longest else None


def clean_cut(file: _File, at: int, longest: int) -> int:
    """The last place at or before `at` that no object of at most `longest` bytes reaches over; the file's beginning is one."""
    # An object over `at` begins after at - longest; what begins up to `back` is known to end before the places asked for.
    back = max(at - 2 * longest, 0)
    while True:
        text = file.text(back, at + longest)
        before = takewhile(lambda i: i < at - back, (m.start() for m in _OPEN.finditer(text)))
        spans = [(i, e) for i in before if (e := _end(text, i, longest)) is not None]
        cut = at - back
        while over := [a for a, e in spans if a < cut < e]:
            cut = min(over)
        if back == 0 or cut >= longest:
            return back + cut
        back = max(back - longest, 0)


def records(file: _File, start: int, stop: int, longest: int, block: int = 1 << 22) -> Iterator[tuple[int, str]]:
    """(start, text) of the records that begin in a range."""
    at = clean_cut(file, start, longest)
    while at < stop:
        upto = min(at + max(block, longest), stop)  # objects that begin before it are whole in what is read
        text, base = file.text(at, upto + longest + 1), at
        i = 0
        while (m := _OPEN.search(text, i)) and base + m.start() < upto:
            end = _end(text, m.start(), longest)
            if end is None:
                i = m.start() + 1
                continue
            if base + m.start() >= start:
                yield base + m.start(), text[m.start() : end]
            i = end
        at = max(upto, base + i)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split, self.longest, self.wrapper = int(options.get("split", 1 << 25)), int(options.get("longest", 1 << 20)), options.get("wrapper", "questions")
        if self.split < 1 or self.longest < 2:
            raise ValueError("split must be 1 or more, longest 2 or more")
        self.only: set[str] | None = None

    def partitions(self) -> list[Range]:
        files = [(p, n) for p, n in files_of(self.path) if self.only is None or p in self.only]
        return [Range(p, a, min(a + self.split, n)) for p, n in files for a in range(0, n, self.split)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.stop == partition.start:
            return
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("pos", pa.int32()), ("value", pa.string())])
        file, rows = _File(partition.path), []
        try:
            for start, text in records(file, partition.start, partition.stop, self.longest):
                value = json.loads(text.encode("latin-1").decode("utf-8", "replace"))
                inner = value.get(self.wrapper)
                found = [x for x in inner if isinstance(x, dict)] if isinstance(inner, list) else [value]
                # Halves of a surrogate pair that stand alone can't leave as UTF-8.
                told = [json.dumps(x, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace").decode() for x in found]
                rows += [(partition.path, start, i, t) for i, t in enumerate(told)]
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
        finally:
            file.close()


class _PushingReader(_Reader):
    """Where the session lets Python sources take filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A file's path is decided here (other files are not planned), the rest by Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.only = {f.value} if self.only is None else self.only & {f.value}
            else:
                yield f


class DamagedJson(DataSource):
    """spark.read.format("damaged_json"). Options: split (bytes of a task's range), longest (bytes of a record), wrapper (a key whose list holds records)."""

    @classmethod
    def name(cls) -> str:
        return "damaged_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> _Reader:
        options = dict(self.options)
        return (_PushingReader if options.get("pushdown") == "true" else _Reader)(options)


def read_damaged(spark: SparkSession, path: str, schema: str | None = None, **options: int | str) -> DataFrame:
    """[S7, S17] The records of a file or folder: path, start (byte), pos (place in a wrapper's list, else 0) and value, JSON with sorted keys.

    With a schema its columns follow instead of value, by Spark's own from_json (only the columns in use are parsed); what doesn't fit a column's type is null. Empty files and folders
    give no rows, as do files without an object; equal objects are rows of their own; bytes that are not UTF-8 become U+FFFD, a lone surrogate `?`. An object of more than `longest` bytes
    gives the records inside it; one of at most that many with a list under `wrapper` gives the list's objects.
    """
    spark.dataSource.register(DamagedJson)
    reader = spark.read.format("damaged_json").option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower())
    for k, v in options.items():
        reader = reader.option(k, str(v))
    rows = reader.load(path)
    return rows if schema is None else rows.withColumn("__v", F.from_json("value", schema)).select("path", "start", "pos", "__v.*")
