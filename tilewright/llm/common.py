"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every operator: ASCII space and \t \n \v \f \r.
SPACES = " \t\n\x0b\f\r"
WORD = "[^\\x20\\x09-\\x0D]+"
#: UTF-8 bytes of texts that a task turns into Python objects at a time (one text at least).
SLICE_BYTES = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5 (a null id counts as empty text)."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5).cast("int")


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; ``bytes.split`` knows exactly the characters of SPACES."""
    return text.encode().split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """As :func:`words`, A-Z lower-cased and no other letter (``bytes.lower`` knows ASCII only)."""
    return text.encode().lower().split() if text else []


def text_slices(column, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, UTF-8 texts) of an Arrow string column, about ``most`` bytes at a time."""
    raw = column.cast(pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    at = 0
    while at < len(raw):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, raw.slice(at, to - at).to_pylist()
        at = to


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so (letters in either case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; on one machine (local master) without a setting, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and executors may be lost."""
    path = f"{shared_dir(df.sparkSession)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(batches) -> batches`` over Arrow record batches of every partition."""
    return df.mapInArrow(fn, schema)


def rows_of(batches: Iterator, *names: str) -> Iterator[tuple]:
    """Rows of Arrow record batches as tuples of Python values, batch by batch."""
    for b in batches:
        yield from zip(*[b.column(n).to_pylist() for n in names])
