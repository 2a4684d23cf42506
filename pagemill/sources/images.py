"""Image files as a Spark data source: decoded pixels, one partition a group of files.

    spark.dataSource.register(ImageSource)
    spark.read.format("pagemill_images").option("path", folder).load()

Rows: path, length, width, height, stride, pixels (BGRA) and error. A file that can't be read is a row with an error and no
pixels; files of other types are left out. Paths are of any file system that pyarrow knows. The driver lists names and sizes;
bytes are read and decoded by the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagemill.sources.decode import MOST_PIXELS, ImageError, decoded
from pagemill.sources.layout import IMAGE_TYPES

SCHEMA = "path string, length long, width int, height int, stride int, pixels binary, error string"
ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("stride", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])
#: Bytes of files that a partition reads, and of pixels that a batch holds, about.
GROUP, BATCH = 64 << 20, 32 << 20


@dataclass
class FileGroup(InputPartition):
    files: list[tuple[str, int]]


def row_of(path: str, length: int, data: bytes | None, most: int, error: str | None = None) -> dict:
    found = {"path": path, "length": length, "width": None, "height": None, "stride": None, "pixels": None, "error": error}
    if error is None:
        try:
            pixels = decoded(data, most)
            found |= {"height": pixels.shape[0], "width": pixels.shape[1], "stride": 4 * pixels.shape[1], "pixels": pixels.tobytes()}
        except ImageError as e:
            found["error"] = str(e)
    return found


class ImageReader(DataSourceReader):
    def __init__(self, path: str, group: int, most: int):
        self.path, self.group, self.most = path, group, most

    def partitions(self) -> list[FileGroup]:
        """Files in the order of their names, in groups of about ``group`` bytes."""
        system, at = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(fs.FileSelector(at, recursive=True)) if system.get_file_info(at).type == fs.FileType.Directory else system.get_file_info([at])
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.rpartition(".")[2].lower() in IMAGE_TYPES)
        groups: list[FileGroup] = []
        held = self.group
        for name, size in files:
            if held + size > self.group:
                groups.append(FileGroup([]))
                held = 0
            groups[-1].files.append((name, size))
            held += size
        return groups or [FileGroup([])]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        rows, held = [], 0
        for name, size in partition.files:
            try:
                with system.open_input_stream(name) as f:
                    row = row_of(name, size, f.read(), self.most)
            except OSError as e:
                row = row_of(name, size, None, self.most, f"unreadable: {e}")
            rows.append(row)
            held += len(row["pixels"] or b"")
            if held > BATCH:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class ImageSource(DataSource):
    """Options: path; group, the bytes of files a partition; most, the pixels of an image at most."""

    @classmethod
    def name(cls) -> str:
        return "pagemill_images"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ImageReader:
        return ImageReader(self.options["path"], int(self.options.get("group", GROUP)), int(self.options.get("most", MOST_PIXELS)))


def read_images(spark: SparkSession, path: str, **options) -> DataFrame:
    """The images under a path, decoded."""
    spark.dataSource.register(ImageSource)
    return spark.read.format(ImageSource.name()).options(path=path, **options).load()
