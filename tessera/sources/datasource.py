"""``spark.read.format("nested")``: documents of text, binary or JSON files, a partition for each, with filters on the key pushed down.

Files are listed and read by pyarrow's file systems. Options: path (a file or folder), form (text, binary or json).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow.fs as pfs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tessera.sources.documents import SCHEMA, rows_of


@dataclass
class File(InputPartition):
    path: str


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("the nested source needs a path")
        path = options["path"]
        self.fs, self.path = pfs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pfs.LocalFileSystem(), path)
        self.form = options.get("form", "text")
        self.keys: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps to itself what names keys; the rest is Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("key",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keys = wanted if self.keys is None else self.keys & wanted
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        info = self.fs.get_file_info(self.path)
        files = [info] if info.is_file else self.fs.get_file_info(pfs.FileSelector(self.path, recursive=True))
        return [File(f.path) for f in sorted((f for f in files if f.is_file), key=lambda f: f.path)] or [File("")]

    def read(self, partition: File) -> Iterator[tuple]:
        if partition.path:
            with self.fs.open_input_stream(partition.path) as f:
                # A row of a file that can't be read has no key, so no filter on the key keeps it.
                yield from (r for r in rows_of(partition.path, f.read(), self.form, None if self.keys is None else sorted(self.keys)) if self.keys is None or r[2] is not None)


class NestedDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nested"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session and switches the pushing of filters on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NestedDocuments)
