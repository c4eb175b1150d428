"""Folders into which pages and events land, as a data source for batch and stream: spark.read.format("landed"), spark.readStream.format("landed").

A folder holds a folder for each day (2026-03-01), and that the files of the day, of JSON lines, whose names rise in the order of landing within the whole folder's order of day and name. A row is a line: day, path, line (from 0) and
value; from_json() or get_json_object() take it apart on the JVM side. A file is a partition. Filters on day are taken by the source: files of other days are not listed as partitions and never opened.
A stream's offset is the last file it has planned, so a restart reads each file that landed after it, once.

Workers open files through pyarrow's file systems, by the scheme of the path (none is a local or mounted folder).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "day string, path string, line long, value string"
TESTS = {
    EqualTo: lambda day, v: day == v, In: lambda day, v: day in v, GreaterThan: lambda day, v: day > v, GreaterThanOrEqual: lambda day, v: day >= v,
    LessThan: lambda day, v: day < v, LessThanOrEqual: lambda day, v: day <= v,
}


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def landed_files(folder: str) -> list[tuple[str, str]]:
    """(day, name) of all files in order; names that begin with a dot or an underscore are not there yet."""
    store, root = _open(folder)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    parts = [i.path[len(root.rstrip("/")) + 1:].split("/") for i in found if i.is_file]
    return sorted((p[0], p[1]) for p in parts if len(p) == 2 and p[1][0] not in "._")


@dataclass
class LandedFile(InputPartition):
    folder: str
    day: str
    name: str


def _lines(part: LandedFile, rows_at_once=10_000) -> Iterator[pa.RecordBatch]:
    store, root = _open(part.folder)
    path = f"{root.rstrip('/')}/{part.day}/{part.name}"
    held, at = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"day": pa.array([part.day] * len(held), pa.string()), "path": pa.array([path] * len(held), pa.string()), "line": pa.array(range(at, at + len(held)), pa.int64()), "value": pa.array(held, pa.string())})

    with store.open_input_stream(path) as raw:
        rest = b""
        while data := raw.read(1 << 20):
            *whole, rest = (rest + data).split(b"\n")
            held += [x.decode(errors="replace") for x in whole]
            while len(held) >= rows_at_once:
                held, more = held[:rows_at_once], held[rows_at_once:]
                yield batch()
                at, held = at + len(held), more
        if rest:
            held.append(rest.decode(errors="replace"))
    if held:
        yield batch()


class LandedReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.tests = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute == ("day",) and f.value is not None:
                self.tests.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[LandedFile]:
        return [LandedFile(self.folder, day, name) for day, name in landed_files(self.folder) if all(TESTS[kind](day, v) for kind, v in self.tests)]

    def read(self, partition: LandedFile | None) -> Iterator[pa.RecordBatch]:
        return _lines(partition) if partition else iter([])  # without any file Spark asks once


class LandedStream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"day": "", "name": ""}

    def latestOffset(self) -> dict:
        day, name = max(landed_files(self.folder), default=("", ""))
        return {"day": day, "name": name}

    def partitions(self, start: dict, end: dict) -> list[LandedFile]:
        low, high = (start["day"], start["name"]), (end["day"], end["name"])
        return [LandedFile(self.folder, *f) for f in landed_files(self.folder) if low < f <= high]

    def read(self, partition: LandedFile) -> Iterator[pa.RecordBatch]:
        return _lines(partition)

    def commit(self, end: dict) -> None:
        pass


class Landed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LandedReader:
        return LandedReader(self.options["path"])

    def streamReader(self, schema: StructType) -> LandedStream:
        return LandedStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Landed)
