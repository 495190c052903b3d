"""Operator 13: spelling variants by a trie over letter-group counts, searched with a budget of one surplus and one deficit."""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import documents, stored

LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A word's form occurs at least so many times as often.
FORM_RATIO = 5
#: Runs whose hash this divides lose a letter.
DELETES = 199
#: Letters of a trie level, in the order of the levels; all other letters make a last level.
GROUPS = ("e", "a", "i", "n", "r", "t", "o", "s", "l", "ud", "cmp", "bghv", "fjkqwxyz")
LEVELS = len(GROUPS) + 1
#: Words of a task's trie, entries of a search block, distinct words that a counting task holds.
TRIE_WORDS = 20_000
BLOCK = 200_000
HELD_WORDS = 200_000
#: Longer candidates are compared one by one instead of in padded rows.
PADDED = 64

GROUP_OF = np.full(256, LEVELS - 1, np.uint8)
for _i, _letters in enumerate(GROUPS):
    GROUP_OF[[ord(c) for c in _letters]] = _i
#: Latin-1 bytes: letters stay, A-Z become a-z, all else (characters beyond Latin-1 are encoded as ?) a space.
RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words: lower-cased letter runs of at least six letters after their deletions, five times or more."""

    def run(batches):
        held: Counter[bytes] = Counter()

        def emit():
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held]), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()

        for b in batches:
            for doc_id, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                if not text:
                    continue
                before = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for w, n in Counter(text.encode("latin-1", "replace").translate(RUNS).split()).items():
                    if len(w) < LEAST_LETTERS:
                        continue
                    h = crc32(w if w.isascii() else w.decode("latin-1").encode(), before)
                    if not h % DELETES:
                        at = h % len(w)
                        w = w[:at] + w[at + 1:]
                        if len(w) < LEAST_LETTERS:
                            continue
                    held[w] += n
                if len(held) > HELD_WORDS:
                    yield from emit()
        yield from emit()

    own = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def group_counts(words: list[bytes]) -> np.ndarray:
    """Letters of every group in every word: one row a word, one column a trie level."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    at = np.repeat(np.arange(len(words)), sizes) * LEVELS + GROUP_OF[np.frombuffer(b"".join(words), np.uint8)]
    return np.bincount(at, minlength=len(words) * LEVELS).reshape(len(words), LEVELS)


def moves(levels: int) -> list[tuple[int, ...]]:
    """Changes of (length, first ``levels`` counts) that one surplus and one deficit can make, the empty change included."""
    none = [0] * levels
    out = {(0, *none)}
    for up in range(-1, levels):  # -1: beyond these levels
        for down in range(-1, levels):
            d = none.copy()
            if up >= 0:
                d[up] += 1
            if down >= 0:
                d[down] -= 1
            out.add((0, *d))
        d = none.copy()
        if up >= 0:
            d[up] += 1
        out |= {(1, *d), (-1, *[-x for x in d])}
    return sorted(out)


class Trie:
    """Words by successive group counts; a node is a range of the sorted words and has one child per next count."""

    def __init__(self, counts: np.ndarray):
        self.order = np.lexsort(counts.T[::-1])
        ranked = counts[self.order]
        self.span = int(counts.max()) + 2 if len(counts) else 2
        node = np.zeros(len(ranked), np.int64)
        self.keys = []  # per level, sorted: parent * span + count of every child
        for level in range(LEVELS):
            keys, node = np.unique(node * self.span + ranked[:, level], return_inverse=True)
            self.keys.append(keys)
        self.first = np.searchsorted(node, np.arange(len(self.keys[-1]) + 1)) if len(ranked) else np.zeros(1, np.int64)

    def search(self, asked: np.ndarray, block: int = BLOCK):
        """Depth first, many words at a time: (asked word, word) numbers whose counts differ by at most one surplus and one deficit."""
        todo = [(0, np.arange(len(asked)), np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int8), np.zeros(len(asked), np.int8))]
        while todo:
            level, q, node, over, under = todo.pop()
            if len(q) > block:
                for i in range(0, len(q), block):
                    todo.append((level, *[x[i:i + block] for x in (q, node, over, under)]))
                continue
            if level == LEVELS:
                start, n = self.first[node], self.first[node + 1] - self.first[node]
                at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
                yield np.repeat(q, n), self.order[at]
                continue
            found = []
            keys, here = self.keys[level], asked[q, level]
            for step in (-1, 0, 1):
                count = here + step
                may = (count >= 0) & (count < self.span)
                may &= (over == 0) if step > 0 else (under == 0) if step < 0 else True
                i = np.flatnonzero(may)
                key = node[i] * self.span + count[i]
                child = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[child] == key if len(keys) else np.zeros(len(i), bool)
                i, child = i[hit], child[hit]
                found.append((q[i], child, over[i] + (step > 0), under[i] + (step < 0)))
            q, node, over, under = (np.concatenate(x) for x in zip(*found))
            if len(q):
                todo.append((level + 1, q, node, over.astype(np.int8), under.astype(np.int8)))


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one insertion, deletion or replacement makes ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


class Padded:
    """Words of at most PADDED letters in rows, aligned left and right."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        short = [w if len(w) <= PADDED else b"" for w in words]
        width = max(map(len, short), default=0) + 1
        self.left = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in short), np.uint8).reshape(len(words), width)
        self.right = np.frombuffer(b"".join(w.rjust(width, b"\1") for w in short), np.uint8).reshape(len(words), width)


def near(a: Padded, i: np.ndarray, b: Padded, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (word i of a, word j of b) differ by exactly one edit."""
    good = np.zeros(len(i), bool)
    long = np.maximum(a.size[i], b.size[j]) > PADDED
    for k in np.flatnonzero(long).tolist():
        good[k] = one_edit(a.words[i[k]], b.words[j[k]])
    width = min(a.left.shape[1], b.left.shape[1])
    rest = np.flatnonzero(~long & (np.abs(a.size[i] - b.size[j]) <= 1))
    for at in range(0, len(rest), BLOCK):
        k = rest[at:at + BLOCK]
        x, y = i[k], j[k]
        differ = a.left[x, :width] != b.left[y, :width]
        ahead = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        differ = (a.right[x, -width:] != b.right[y, -width:])[:, ::-1]
        behind = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        less, more = np.minimum(a.size[x], b.size[y]), np.maximum(a.size[x], b.size[y])
        equal = (less == more) & (ahead >= less)
        good[k] = ~equal & (np.minimum(ahead, less) + np.minimum(behind, less) >= more - 1)
    return good


def near_words(words: DataFrame, trie_words: int = TRIE_WORDS) -> DataFrame:
    """(word, n_near, near, near_n) of every word that has a near word; ``words``: word (Latin-1, unique), n.

    The trie's upper part deals the words: a word lies in the cell of its length and first counts, and is searched
    in every cell that one surplus and one deficit reach. The number of levels in a cell's name grows with the
    vocabulary; a cell of more than ``trie_words`` words is cut into parts on both sides, and every two parts meet.
    A word lies in one place, so every near pair is found once from either side. ``near`` is the most frequent near
    word, the smallest in code-point order among equals.
    """
    total = words.count()
    levels = min(LEVELS - 1, max(1, math.ceil(math.log(max(1.0, total / (8 * trie_words)), 3))))
    steps = moves(levels)

    def places(batches):
        for b in batches:
            raw = [w.encode("latin-1") for w in b.column("word").to_pylist()]
            counts = group_counts(raw)
            heads = np.column_stack([np.fromiter(map(len, raw), np.int64, len(raw)), counts[:, :levels]]).tolist()
            cells = [",".join(map(str, h)) for h in heads]
            ways = [[",".join(map(str, [x + y for x, y in zip(h, s)])) for s in steps if all(x + y >= 0 for x, y in zip(h, s))] for h in heads]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(cells, pa.string()), pa.array(ways, pa.list_(pa.string()))],
                                             ["word", "n", "cell", "ways"])

    placed = stored(words.select("word", "n").mapInArrow(places, "word string, n long, cell string, ways array<string>"), "placed")
    cells = stored(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / trie_words).cast("int").alias("parts")).withColumnRenamed("cell", "at"), "cells")

    def dealt(df: DataFrame, mine: str, other: str) -> DataFrame:
        """Words of a side with their own part and, in turn, every part of the other side."""
        part = F.pmod(F.xxhash64("word", F.lit(13)), F.col("parts")).cast("int")
        return df.join(cells, F.col("cell") == F.col("at")).withColumn(mine, part).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
            *[F.col(c).alias(c) for c in ("word", "n", "cell", "part", "turn")])

    stock = dealt(placed, "part", "turn")
    asked = dealt(placed.select("word", "n", F.explode("ways").alias("cell")), "turn", "part")

    def search(here: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"word": [], "n_near": [], "near": [], "near_n": []}
        if here.num_rows and asked.num_rows:
            have, want = ([w.encode("latin-1") for w in t.column("word").to_pylist()] for t in (here, asked))
            n = here.column("n").to_numpy()
            stock, wanted = Padded(have), Padded(want)
            rank = np.empty(len(have), np.int64)  # by code point: equal to byte order in Latin-1
            rank[sorted(range(len(have)), key=have.__getitem__)] = np.arange(len(have))
            pairs = [(q[good], w[good]) for q, w in Trie(group_counts(have)).search(group_counts(want)) if (good := near(wanted, q, stock, w)).any()]
            if pairs:
                q, w = (np.concatenate(x) for x in zip(*pairs))
                order = np.lexsort([rank[w], -n[w], q])
                q, w = q[order], w[order]
                first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
                out = {"word": [want[i].decode("latin-1") for i in q[first]], "n_near": np.diff(np.r_[first, len(q)]),
                       "near": [have[i].decode("latin-1") for i in w[first]], "near_n": n[w[first]]}
        return pa.table([pa.array(out[c], t) for c, t in (("word", pa.string()), ("n_near", pa.int64()), ("near", pa.string()), ("near_n", pa.int64()))], list(out))

    hits = stock.groupBy("cell", "part", "turn").cogroup(asked.groupBy("cell", "part", "turn")).applyInArrow(
        search, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    return hits.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.near").alias("near"), (-F.col("b.less")).alias("near_n"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_words: int = TRIE_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word (see :func:`counted_words`).

    The form is the near word that occurs most often, if FORM_RATIO times as often at least; the root is the end of the
    chain of forms, found by doubling (counts grow along a chain, so it ends). Null and empty texts have no words;
    a null id counts as empty text in a run's hash; repeated rows count again; texts of any length are read whole;
    an empty table gives no rows; other columns are ignored.
    """
    words = stored(counted_words(docs, id_col, text_col), "words")
    found = near_words(words, trie_words).withColumnRenamed("word", "w")
    fits = F.col("near_n") >= FORM_RATIO * F.col("n")
    formed = stored(words.join(found, F.col("word") == F.col("w"), "left").select(
        "word", F.when(fits, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("near_n")).alias("form_n")), "forms")
    chains = stored(formed.where("form is not null").select(F.col("word").alias("from"), F.col("form").alias("to")), "chains")
    while True:
        ahead = chains.select(F.col("from").alias("mid"), F.col("to").alias("end"))
        step = stored(chains.join(ahead, F.col("to") == F.col("mid"), "left").select(
            "from", F.coalesce("end", "to").alias("to"), F.col("end").isNotNull().alias("moved")), "chains")
        chains = step.select("from", "to")
        if not step.where("moved").limit(1).count():
            break
    return formed.join(chains, F.col("word") == F.col("from"), "left").select(
        "word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))
