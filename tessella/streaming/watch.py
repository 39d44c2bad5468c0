"""Changes of files as a stream. Spark's file source sees new paths; this one also sees files written again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from tessella.streaming.requests import debounce


class ChangeReader(SimpleDataSourceStreamReader):
    """Polls a folder. The offset is the time of the newest change seen, in nanoseconds, and the paths of that time."""

    def __init__(self, folder: str):
        self.folder = folder

    def _scan(self) -> list[tuple[str, int, int]]:
        local = self.folder.startswith(("/", "file:"))
        fs, at = (pyarrow.fs.LocalFileSystem(), self.folder.removeprefix("file://")) if local else pyarrow.fs.FileSystem.from_uri(self.folder)
        found = fs.get_file_info(pyarrow.fs.FileSelector(at, allow_not_found=True, recursive=True))
        return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == pyarrow.fs.FileType.File)

    def initialOffset(self) -> dict:
        return {"ns": -1, "paths": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, seen = [], set(start["paths"].split("\n"))
        newest, at = start["ns"], seen
        for ns, path, size in self._scan():
            if ns < start["ns"] or (ns == start["ns"] and path in seen):
                continue
            rows.append((path, ns // 1000, size))
            if ns > newest:
                newest, at = ns, set()
            at.add(path)
        return iter(rows), {"ns": newest, "paths": "\n".join(sorted(at))}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        seen = set(start["paths"].split("\n"))
        return iter([(p, ns // 1000, s) for ns, p, s in self._scan() if start["ns"] <= ns <= end["ns"] and not (ns == start["ns"] and p in seen)])


class FileChanges(DataSource):
    """``spark.readStream.format("file_changes").option("path", folder)``: path, time of the change in microseconds, size."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return "path string, changed_us long, size long"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return ChangeReader(self.options["path"])


def reloads(changes: DataFrame, gap: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(path, fires, events): when a changed file is to be read again, once for each burst of changes. A file that can't be read then tells so in its index row."""
    return debounce(changes.select("path", F.timestamp_micros("changed_us").alias("ts")), "path", "ts", gap, late)
