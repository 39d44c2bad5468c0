"""The ``raster`` data source: ``spark.read.format("raster").load(folder)`` gives the directories of its files."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessella.sources import container
from tessella.sources.ranges import source

ENDINGS = ("*.tif", "*.tiff", "*.TIF", "*.TIFF", "*.btf", "*.tf8", "*.tf2")


class Paths(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class RasterReader(DataSourceReader):
    def __init__(self, folder: str, group: int):
        self.folder, self.group = folder, group

    def partitions(self) -> list[InputPartition]:
        local = self.folder.startswith(("/", "file:"))
        fs, at = (pyarrow.fs.LocalFileSystem(), self.folder.removeprefix("file://")) if local else pyarrow.fs.FileSystem.from_uri(self.folder)
        scheme = "" if local else self.folder.split("://")[0] + "://"
        paths = sorted(scheme + f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=True)) if any(fnmatch.fnmatchcase(f.base_name, e) for e in ENDINGS))
        return [Paths(paths[i : i + self.group]) for i in range(0, len(paths), self.group)] or [Paths([])]

    def read(self, partition: Paths) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                ranges = source(path)
                for d in container.directories(ranges):
                    yield path, ranges.size, d.ifd, d.one(container.SUBFILE, 0), d.width, d.height, d.spp, d.bits, d.one(container.COMPRESSION, 1), None
            except Exception as e:  # noqa: BLE001  the file's own row tells
                yield path, None, None, None, None, None, None, None, None, str(e)


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return "path string, size long, ifd int, subfile int, width long, height long, spp long, bits int, compression int, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RasterReader(self.options["path"], int(self.options.get("filesPerPartition", 64)))
