"""Operator 9: best-fit packing of document pieces by matching large items (Spark groups, lengths only)."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import documents, stored, text_slices
from tilewright.llm.tokens import CACHED_WORDS, WordIds, default_tokenizer

CAPACITY = 4096
END_ID = 1
GROUP_PIECES = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Token pieces of every document: ids of the text (null: empty), then END_ID, cut at ``capacity``.

    Rows are independent: repeated rows and null ids give their own pieces; an empty text is one piece of length 1.
    """
    path = tokenizer or default_tokenizer()
    columns = PIECES.split(", ")

    def run(batches):
        ids_of = WordIds(path, cached_words)
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            for at, texts in text_slices(b.column("text")):
                found = []
                for d, ids in zip(doc_ids[at:at + len(texts)], ids_of.encode([t.split() if t else [] for t in texts])):
                    ids += end
                    n = len(ids) // 4
                    for k, s in enumerate(range(0, n, capacity)):
                        part = ids[4 * s:4 * (s + capacity)]
                        found.append((d, k, s, len(part) // 4, zlib.crc32(part)))
                data = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(data[0], pa.int64()), pa.array(data[1], pa.int32()), *[pa.array(x, pa.int64()) for x in data[2:]]],
                    [c.split()[0] for c in columns])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


class Fenwick:
    """Counts of open bins by free capacity, with the smallest capacity at or above a value in O(log n)."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.tree = [0] * (self.size + 1)
        self.bins: dict[int, list[int]] = {}

    def _add(self, i: int, by: int) -> None:
        i += 1
        while i <= self.size:
            self.tree[i] += by
            i += i & -i

    def push(self, free: int, bin_no: int) -> None:
        self.bins.setdefault(free, []).append(bin_no)
        self._add(free, 1)

    def pop(self, free: int) -> int:
        self._add(free, -1)
        return self.bins[free].pop()

    def at_least(self, need: int) -> int | None:
        """Smallest free capacity >= need that some open bin has."""
        i, rank = need, 0
        while i > 0:  # bins with less room than needed
            rank += self.tree[i]
            i -= i & -i
        pos, step = 0, self.size
        while step:
            if pos + step <= self.size and self.tree[pos + step] <= rank:
                pos += step
                rank -= self.tree[pos]
            step >>= 1
        return pos if pos < self.size and self.bins.get(pos) else None


def best_fit_matching(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin number per item.

    Items above a third of the capacity are *large*, and a bin holds two of them at most. From the
    longest on, each large item takes the longest still free large item that fits beside it (greedy
    matching). Smaller items, longest first, go to the open bin with the least sufficient room. Ties
    are broken by position. Every item must fit an empty bin.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order].tolist()
    n_large = int((lengths * 3 > capacity).sum())
    out = np.empty(len(lengths), np.int64)
    room = Fenwick(capacity)
    free_large = Fenwick(capacity)  # keyed by capacity - length: at_least(length) finds the longest partner
    for i in range(n_large - 1, -1, -1):
        free_large.push(capacity - sizes[i], i)
    taken = [False] * n_large
    bins = 0
    for i in range(n_large):
        if taken[i]:
            continue
        free_large.pop(capacity - sizes[i])  # item i itself: equal lengths leave in order
        taken[i], out[order[i]], left = True, bins, capacity - sizes[i]
        key = free_large.at_least(sizes[i])
        if key is not None:
            j = free_large.pop(key)
            taken[j], out[order[j]], left = True, bins, left - sizes[j]
        room.push(left, bins)
        bins += 1
    for i in range(n_large, len(sizes)):
        size = sizes[i]
        key = room.at_least(size)
        if key is None:
            number, left = bins, capacity - size
            bins += 1
        else:
            number, left = room.pop(key), key - size
        out[order[i]] = number
        room.push(left, number)
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset to a piece table (columns of PIECES).

    Pieces are dealt by a hash into groups of about ``group_pieces``; every group is matched on its own, which
    costs less than one partly filled sequence per group. Only lengths travel, never texts or ids.
    """
    n = items.count()
    groups = max(1, round(n / group_pieces))
    # Equal rows (many empty texts without an id) differ in the random draw only; the seed makes reruns over a stored table agree.
    spread = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.rand(9)), F.lit(groups)).cast("long")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "length", "ids_crc32"], kind="stable", na_position="first", ignore_index=True)
        bins = best_fit_matching(pdf["length"].to_numpy(np.int64), capacity)
        by_bin = np.argsort(bins, kind="stable")
        length = pdf["length"].to_numpy(np.int64)[by_bin]
        before = np.cumsum(length) - length
        first = np.r_[True, np.diff(bins[by_bin]) > 0]
        offset = np.empty(len(pdf), np.int64)
        offset[by_bin] = before - np.maximum.accumulate(np.where(first, before, 0))
        pdf["sequence_id"] = (int(pdf["grp"].iloc[0]) << 32) + bins
        pdf["offset"] = offset
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        return pdf.drop(columns="grp")

    return items.select(*[c.split()[0] for c in PIECES.split(", ")], spread.alias("grp")).groupBy("grp").applyInPandas(fit, PACKED)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, cached_words: int = CACHED_WORDS) -> DataFrame:
    """All documents packed into sequences of at most ``capacity`` tokens; one row per piece (columns of PACKED).

    Documents longer than ``capacity`` are cut into full pieces and a last one; nothing else is cut and nothing is
    lost. Nulls, empty texts and repeated rows: see :func:`pieces`; an empty table gives no rows. Other columns of
    ``docs`` are ignored, whatever their names. A task remembers the ids of ``cached_words`` words (memory against speed).
    """
    return pack(stored(pieces(docs, capacity, tokenizer, cached_words), "pieces"), capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
