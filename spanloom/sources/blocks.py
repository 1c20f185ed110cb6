"""Files of any size by blocks: sizes, digests and line counts without a file in memory."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size_bytes long, sha256 string, line_count long, error string"


class FileDigests(DataSource):
    """A row for each path of the option ``paths`` (one per line): its size, SHA-256 and number of line ends."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return DigestReader(self.options["paths"].split("\n"), int(self.options.get("block", 1 << 20)))


class DigestReader(DataSourceReader):
    def __init__(self, paths: list[str], block: int):
        self.paths, self.block = paths, block

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        path = partition.value
        try:
            if "://" in path and not path.startswith("file:"):
                store, at = fs.FileSystem.from_uri(path)
            else:
                store, at = fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
            digest, size, lines = hashlib.sha256(), 0, 0
            with store.open_input_stream(at, compression=None) as f:
                while data := f.read(self.block):
                    digest.update(data)
                    size += len(data)
                    lines += data.count(b"\n")
            yield path, size, digest.hexdigest(), lines, None
        except FileNotFoundError:
            yield path, None, None, None, "missing"


def digests(spark: SparkSession, paths: list[str], block: int = 1 << 20) -> DataFrame:
    """path, size_bytes, sha256, line_count and error of each path, one task a file, which holds ``block`` bytes at a time.

    Paths are local ones or URIs that Arrow's file systems open; a file that isn't
    there has only its path and an error.
    """
    spark.dataSource.register(FileDigests)
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.format("file_digests").option("paths", "\n".join(paths)).option("block", str(block)).load()
