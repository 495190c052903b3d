"""Image members of ``.tar`` archives: a Spark data source for their blocks, read by place."""

from __future__ import annotations

import glob
import json
import os
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tilewright.constants import MEMBER_SUFFIXES

SPLIT_BYTES = 512 * 1024 * 1024
#: Tasks that read members, unless all archives hold more than as many SPLIT_BYTES.
READ_TASKS = 200
#: Member bytes that a task holds before it passes them on (a larger member alone).
FRAME_BYTES = 8 * 1024 * 1024
MEMBER_SCHEMA = "tar_stem string, member_no bigint, member string, image_stem string, length bigint, content binary"
MEMBER_FIELDS = [f.split(" ")[0] for f in MEMBER_SCHEMA.split(", ")]


def visible_image(member: str) -> bool:
    base = os.path.basename(re.sub(r"^[./]+", "", member))
    return bool(base) and not base.startswith(".") and os.path.splitext(base)[1].lower() in MEMBER_SUFFIXES


def _sized(pattern: str) -> list[tuple[int, str]]:
    """(bytes, path) of the archives of a folder or glob, largest first, so that long tasks start early."""
    found = glob.glob(os.path.join(pattern, "*.tar") if os.path.isdir(pattern) else pattern)
    return sorted(((os.path.getsize(f), f) for f in found), reverse=True)


class WholeArchive(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class BlockReader(DataSourceReader):
    def __init__(self, options):
        self.pattern = options["path"]
        self.block_bytes = int(options["blockBytes"])

    def partitions(self) -> list[InputPartition]:
        return [WholeArchive(f) for _, f in _sized(self.pattern)]

    def read(self, partition: WholeArchive) -> Iterator[tuple]:
        """Walk the headers once (seeking over data) and cut the image members into runs of about ``blockBytes``."""
        with tarfile.open(partition.path) as tf:
            number = count = start = 0
            pax = "{}"
            while (m := tf.next()) is not None:
                tf.members = []  # keep no header list in memory
                if not m.isfile() or not visible_image(m.name):
                    continue
                if count and m.offset - start >= self.block_bytes:
                    yield partition.path, start, number, count, pax
                    number, count = number + count, 0
                if not count:
                    start, pax = m.offset, json.dumps(tf.pax_headers)
                count += 1
            if count:
                yield partition.path, start, number, count, pax


class TarBlocks(DataSource):
    """``spark.read.format("tar_blocks")``: runs of image members, by the place of their first header; options path (folder or glob), blockBytes."""

    @classmethod
    def name(cls) -> str:
        return "tar_blocks"

    def schema(self) -> str:
        return "path string, start bigint, first_no bigint, members bigint, pax string"

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options)


def _block_members(path: str, start: int, first_no: int, members: int, pax: str, with_content: bool) -> Iterator[tuple]:
    tar_stem = os.path.splitext(os.path.basename(path))[0]
    with tarfile.open(path) as tf:
        tf.fileobj.seek(start)
        tf.offset, tf.firstmember, tf.pax_headers = start, None, json.loads(pax)
        number = first_no
        while number < first_no + members:
            m = tf.next()
            tf.members = []
            if not m.isfile() or not visible_image(m.name):
                continue
            name = re.sub(r"^[./]+", "", m.name)
            yield tar_stem, number, name, os.path.splitext(os.path.basename(name))[0], m.size, tf.extractfile(m).read() if with_content else None
            number += 1


def _block_reader(with_content: bool):
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for frame in frames:
            for block in frame.itertuples(index=False):
                for row in _block_members(*block, with_content):
                    rows.append(row)
                    held += len(row[-1] or b"") + 200
                    if held >= FRAME_BYTES:
                        yield pd.DataFrame(rows, columns=MEMBER_FIELDS)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=MEMBER_FIELDS)

    return read


def archive_members(spark: SparkSession, path: str, content: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Image members with ``unq_id`` = archive stem + image stem.

    One task walks an archive's headers and cuts it into blocks; blocks of ``split_bytes``, or a READ_TASKS-th of all
    archives where that is more, are dealt out and read from their first header on, so no header is read more than twice.
    """
    total = sum(size for size, _ in _sized(path))
    tasks = max(1, min(-(-total // split_bytes), max(READ_TASKS, -(-total // SPLIT_BYTES))))
    spark.dataSource.register(TarBlocks)
    blocks = spark.read.format("tar_blocks").option("blockBytes", str(max(split_bytes, -(-total // tasks)))).load(path)
    df = blocks.repartition(tasks).mapInPandas(_block_reader(content), MEMBER_SCHEMA)
    return df.withColumn("unq_id", F.concat_ws("_", "tar_stem", "image_stem"))
