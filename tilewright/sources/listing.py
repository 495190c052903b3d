"""Folder listing as a Spark data source.

Spark's own file sources skip empty files, so they cannot count them. Top-level
sub-folders are walked by separate tasks on the shared file system.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class FolderReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]

    def partitions(self) -> list[InputPartition]:
        with os.scandir(self.root) as entries:
            folders = sorted(e.path for e in entries if e.is_dir())
        return [Folder(self.root, False), *[Folder(f, True) for f in folders]]

    def read(self, partition: Folder) -> Iterator[tuple]:
        for at, _, names in os.walk(partition.path):
            for n in names:
                path = os.path.join(at, n)
                yield path, os.path.getsize(path)
            if not partition.deep:
                break


class FolderFiles(DataSource):
    """``spark.read.format("folder_files")``: every file below a folder with its length."""

    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return "path string, length bigint"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def folder_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every file below ``root``, empty ones included."""
    spark.dataSource.register(FolderFiles)
    return spark.read.format("folder_files").load(root)
