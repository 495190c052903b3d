"""Operator 4: packed token-id matrices, best-fit decreasing with a segment tree over bin capacities."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import documents, text_slices
from tilewright.llm.tokens import WordIds, default_tokenizer

CAPACITY = 4096
END_ID = 1
PAD_ID = 0
#: Tokens that a task holds before it packs them: 8 MB of ids, about 512 sequences.
BUFFER_TOKENS = 2_097_152
MATRIX = ("sequence_id long, input_ids binary, position_ids binary, cu_seqlens array<int>, n_tokens int, "
          "doc_ids array<long>, starts array<long>")


class CapacityTree:
    """Segment tree over free capacities 0..capacity; a leaf counts the open bins with that much room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, free: int, by: int) -> None:
        i = free + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, free: int, number: int) -> None:
        self.bins[free].append(number)
        self._change(free, 1)

    def take_best(self, need: int) -> tuple[int, int] | None:
        """The bin with the least room >= need, taken out of the tree: (room, number)."""
        i = need + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):  # up, until a right neighbour has bins
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i *= 2
                if not self.count[i]:
                    i += 1
        free = i - self.leaves
        self._change(free, -1)
        return free, self.bins[free].pop()


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins as lists of item numbers; longest items first, each to the fullest bin that still holds it."""
    tree, bins = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take_best(lengths[i])
        if found is None:
            free, number = capacity, len(bins)
            bins.append([])
        else:
            free, number = found
        bins[number].append(i)
        tree.put(free - lengths[i], number)
    return bins


def token_matrices(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None,
                   buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """Packed rows: ids padded to ``capacity`` (binary, little-endian unsigned 32-bit), positions that restart in every
    segment (binary, little-endian unsigned 16-bit: ``capacity`` is 65,536 at most), cumulative segment lengths.

    A document is its token ids and END_ID (null text: END_ID alone); longer ones are cut losslessly into
    ``capacity`` pieces (``starts`` has each segment's place in its document, so ids concatenated by start give the
    document back). Padding has id PAD_ID and position 0 and lies outside cu_seqlens. Each task packs bounded
    buffers of its own partition, so ids are never shuffled; a buffer leaves about one sequence partly filled.
    Repeated rows and null ids keep their own segments; an empty table gives no rows; other columns are ignored.
    """
    path = tokenizer or default_tokenizer()
    steps = np.arange(capacity, dtype="<u2").tobytes()
    padding = np.full(capacity, PAD_ID, "<u4").tobytes()
    end = np.array([END_ID], "<u4").tobytes()

    def emit(held: list, base: int) -> tuple[pa.RecordBatch, int]:
        bins = best_fit_decreasing([len(x[2]) // 4 for x in held], capacity)
        ids, pos, cu, doc_ids, starts = [], [], [], [], []
        for members in bins:
            row = b"".join([held[m][2] for m in members])
            sizes = [len(held[m][2]) // 4 for m in members]
            ids.append(row + padding[len(row):])
            pos.append(b"".join([steps[:2 * n] for n in sizes]) + bytes(2 * (capacity - sum(sizes))))
            cu.append([0, *accumulate(sizes)])
            doc_ids.append([held[m][0] for m in members])
            starts.append([held[m][1] for m in members])
        return pa.RecordBatch.from_arrays([
            pa.array(np.arange(base, base + len(bins)), pa.int64()),
            pa.array(ids, pa.binary()), pa.array(pos, pa.binary()),
            pa.array(cu, pa.list_(pa.int32())), pa.array([c[-1] for c in cu], pa.int32()),
            pa.array(doc_ids, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64())),
        ], [c.split()[0] for c in MATRIX.split(", ")]), base + len(bins)

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        ids_of, held, total = WordIds(path), [], 0
        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            for at, texts in text_slices(b.column("text")):
                for d, raw in zip(doc_ids[at:at + len(texts)], ids_of.encode([t.split() if t else [] for t in texts])):
                    raw += end
                    for s in range(0, len(raw), 4 * capacity):
                        held.append((d, s // 4, raw[s:s + 4 * capacity]))
                        total += len(held[-1][2]) // 4
                        if total >= buffer_tokens:
                            out, base = emit(held, base)
                            yield out
                            held, total = [], 0
        if held:
            yield emit(held, base)[0]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, MATRIX)


def op4_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_matrices(documents(spark, sf_dir))
