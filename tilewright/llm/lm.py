"""Operator 1: a log-bilinear language model trained by noise-contrastive estimation, and its scores.

Tokens fall into a fixed number of classes: the most frequent words have one each, other words share one by their last
bytes. P(token | context) = P(class | context) * P(token | class). The first factor is the log-bilinear model,
normalised over all classes; the second is (c + 0.5) / (N_class + 0.5 (V_class + 1)), where each class has one
place for unseen words.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import documents, fold, lower_words, stored

#: The end token's key: no word has white space.
END = b"\n"
CLASSES = 512
SINGLE = 256
SUFFIX_BYTES = 3
#: Words whose count travels to the tasks in one broadcast table, at most; rarer words are joined.
HOT_WORDS = 131_072
DIM = 32
CONTEXT = 2
BATCH = 2_048
NOISE = 64
ROUNDS = 2
RATE = 0.08
SEED = 1


class Classes(NamedTuple):
    """Bounded tables of a trained vocabulary."""

    n_tokens: int
    n_types: int
    floor: int  # words of this count or more are in ``hot``
    hot: dict[bytes, int]  # word -> count
    single: dict[bytes, int]  # word -> class
    suffix: dict[bytes, int]  # last bytes -> class
    log_size: np.ndarray  # log10(N_class + 0.5 (V_class + 1)), 0 for classes of one word
    tokens: np.ndarray  # N_class


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of all tokens of column text: lower-cased words, and one END a row."""

    def run(batches):
        from collections import Counter

        counts, rows = Counter(), 0
        for b in batches:
            for t in b.column("text").to_pylist():
                counts.update(lower_words(t))
                rows += 1
            if len(counts) > 500_000:  # bounded memory: partial counts are added up after the shuffle
                yield from tables(counts)
                counts = Counter()
        if rows:
            counts[END] = rows
        yield from tables(counts)

    def tables(counts):
        keys, n = list(counts), list(counts.values())
        for i in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i:i + 50_000], pa.binary()), pa.array(n[i:i + 50_000], pa.int64())], ["word", "c"])

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def classes_of(counts: DataFrame) -> Classes:
    """Vocabulary tables from the counts of all training tokens; every list that the driver gets has a fixed bound."""
    total = counts.agg(F.sum("c").alias("n"), F.count("word").alias("v")).first()
    level = F.floor(F.log2("c") * 16).cast("int")
    levels = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # some hundred rows
    seen, floor_level = 0, None
    for r in levels:
        if seen + r["count"] > HOT_WORDS:
            break
        seen, floor_level = seen + r["count"], r["level"]
    rows = [] if floor_level is None else counts.where(level >= floor_level).collect()
    hot = {bytes(r["word"]): r["c"] for r in rows}
    least_hot = 0 if floor_level is None else min(hot.values())
    if END not in hot:  # every text holds it, and it is never looked up among the rare words
        hot |= {bytes(r["word"]): r["c"] for r in counts.where(F.col("word") == F.lit(bytearray(END))).collect()}
    top = sorted((w for w in hot if w != END), key=lambda w: (-hot[w], w))[:SINGLE - 1]
    single = {END: 0, **{w: i + 1 for i, w in enumerate(top)}}
    suffix_of = F.expr(f"substring(word, -{SUFFIX_BYTES}, {SUFFIX_BYTES})")
    grouped = counts.where(~F.col("word").isin([bytearray(w) for w in single])).groupBy(suffix_of.alias("s")).agg(
        F.sum("c").alias("n"), F.count("word").alias("v"))
    # Class SINGLE takes all words without a suffix class.
    best = grouped.orderBy(F.desc("n"), "s").limit(CLASSES - SINGLE - 1).collect()
    suffix = {bytes(r["s"]): SINGLE + 1 + i for i, r in enumerate(best)}
    tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for w, i in single.items():
        tokens[i] = hot.get(w, 0)
    for r in best:
        tokens[suffix[bytes(r["s"])]], types[suffix[bytes(r["s"])]] = r["n"], r["v"]
    rest = grouped.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    tokens[SINGLE] = (rest["n"] or 0) - tokens[SINGLE + 1:].sum()
    types[SINGLE] = (rest["v"] or 0) - types[SINGLE + 1:].sum()
    log_size = np.log10(tokens + 0.5 * (types + 1))
    log_size[:SINGLE] = 0.0
    return Classes(total["n"] or 0, total["v"], least_hot, hot, single, suffix, log_size, tokens)


ENCODED = ("row long, doc_id long, held_out boolean, n_tokens long, hot_known long, hot_log double, class_log double, "
           "classes binary, rare array<binary>")


def encode(texts: DataFrame, vocabulary: Classes) -> DataFrame:
    """Per row of (doc_id, held_out, text): class ids (little-endian 16-bit), log10 sums of the hot words, and rare words."""
    shared = texts.sparkSession.sparkContext.broadcast(tuple(vocabulary))  # HOT_WORDS words at most

    def run(batches):
        from math import log10

        from pyspark import TaskContext

        v = Classes(*shared.value)
        row = TaskContext.get().partitionId() << 40
        single, suffix = v.single, v.suffix
        # word -> (class, log10(c + 0.5) if it is counted within a class, log10(c + 0.5))
        table = {w: (single.get(w, suffix.get(w[-SUFFIX_BYTES:], SINGLE)), 0.0 if w in single else log10(c + 0.5), log10(c + 0.5)) for w, c in v.hot.items()}
        unseen_single = {w: (i, 0.0, log10(0.5)) for w, i in single.items() if w not in table}
        class_of = {w: x[0] for w, x in (*table.items(), *unseen_single.items())}
        known_end = END in v.hot
        for b in batches:
            out = []
            for doc_id, held_out, text in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text").to_pylist()):
                w = lower_words(text)
                rare = [x for x in w if x not in class_of]
                w.append(END)
                ids = np.array([class_of[x] if x in class_of else suffix.get(x[-SUFFIX_BYTES:], SINGLE) for x in w], np.int16)
                logs = [table[x] for x in w if x in table]
                base = sum(x[2] for x in logs) + (0.0 if known_end else log10(0.5))
                within = sum(x[1] for x in logs) - float(v.log_size[ids].sum())
                out.append((row, doc_id, held_out, len(w), len(logs), base, within, ids.astype("<i2").tobytes(), rare))
                row += 1
                if len(out) == 500:
                    yield table_of(out)
                    out = []
            if out:
                yield table_of(out)

    def table_of(out):
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], [c.split()[0] for c in ENCODED.split(", ")])

    return texts.mapInArrow(run, ENCODED)


# ------------------------------------------------------------------ the model

class Model(NamedTuple):
    """score(w | h) = (sum_i scale_i * context[h_i]) . target[w] + bias[w]."""

    context: np.ndarray
    target: np.ndarray
    scale: np.ndarray
    bias: np.ndarray


def unigram(tokens: np.ndarray) -> np.ndarray:
    p = tokens + 0.5
    return p / p.sum()


def start_model(tokens: np.ndarray, seed: int = SEED) -> Model:
    """Unigram model: the bias is the class's log frequency, the rest is small noise."""
    rng = np.random.default_rng(seed)
    return Model(rng.normal(0, 0.1, (CLASSES, DIM)).astype(np.float32), rng.normal(0, 0.1, (CLASSES, DIM)).astype(np.float32),
                 np.ones((CONTEXT, DIM), np.float32), np.log(unigram(tokens)).astype(np.float32))


def contexts(ids: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Class of the token 1, 2, ... places before; before a document's first token stands the end class."""
    out = []
    at = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    for i in range(1, CONTEXT + 1):
        h = np.zeros(len(ids), np.int16)
        h[i:] = ids[:-i]
        h[at < i] = 0
        out.append(h)
    return out


def _row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    return rows[first], np.add.reduceat(values[order], first, axis=0)


class Trainer:
    """Noise-contrastive estimation by AdaGrad: the data's class against NOISE unigram draws shared by a batch."""

    def __init__(self, model: Model, tokens: np.ndarray, seed: int):
        self.m = Model(*[x.copy() for x in model])
        self.squares = [np.full(x.shape, 1e-6, np.float32) for x in model]
        self.p = unigram(tokens)
        self.cumulative = np.cumsum(self.p)
        self.log_noise = np.log(NOISE * self.p).astype(np.float32)
        self.rng = np.random.default_rng(seed)

    def _step(self, which: int, rows, grad: np.ndarray) -> None:
        self.squares[which][rows] += grad * grad
        self.m[which][rows] += RATE * grad / np.sqrt(self.squares[which][rows])

    def batch(self, w: np.ndarray, h: list[np.ndarray]) -> None:
        m = self.m
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), CLASSES - 1)
        seen = [m.context[x] for x in h]
        q = sum(s * r for s, r in zip(m.scale, seen))
        target, far = m.target[w], m.target[noise]
        # Gradients of the log likelihood of "data or noise".
        g = 1.0 / (1.0 + np.exp(np.clip(np.einsum("ij,ij->i", q, target) + m.bias[w] - self.log_noise[w], -30, 30)))
        g_noise = -1.0 / (1.0 + np.exp(np.clip(self.log_noise[noise] - q @ far.T - m.bias[noise], -30, 30)))
        dq = g[:, None] * target + g_noise @ far
        rows = np.concatenate([w, noise])
        change = np.concatenate([np.column_stack([g[:, None] * q, g]), np.column_stack([g_noise.T @ q, g_noise.sum(axis=0)])])
        at, total = _row_sums(rows, change)
        scale_change = np.stack([(dq * r).sum(axis=0) for r in seen])
        at_h, total_h = _row_sums(np.concatenate(h), np.concatenate([dq * s for s in m.scale]))
        self._step(1, at, total[:, :-1])
        self._step(3, at, total[:, -1])
        self._step(0, at_h, total_h)
        self._step(2, slice(None), scale_change)

    def learn(self, ids: np.ndarray, starts: np.ndarray) -> None:
        h = contexts(ids, starts)
        order = self.rng.permutation(len(ids))
        for i in range(0, len(ids), BATCH):
            part = order[i:i + BATCH]
            self.batch(ids[part], [x[part] for x in h])


def _joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) // 2 for x in blobs], np.int64)
    return np.frombuffer(b"".join(blobs), "<i2"), np.cumsum(sizes) - sizes


def train(encoded: DataFrame, tokens: np.ndarray, rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """Model from all rows of ``encoded`` (class blobs).

    Every round, each task starts from the common model and learns from its share of its texts; the tasks' models are
    averaged, weighted by tokens, with sums that Spark combines. The driver gets one model of fixed size a round.
    """
    model = start_model(tokens, seed)
    if not tokens.sum():
        return model
    shapes = [x.shape for x in model]
    spark = encoded.sparkSession
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(tuple(model))

        def run(batches, shared=shared, k=k):
            from pyspark import TaskContext

            trainer, n, held, size = Trainer(Model(*shared.value), tokens, seed + 1000 * k + TaskContext.get().partitionId()), 0, [], 0
            for b in batches:
                for x in b.column("classes").to_pylist():
                    held.append(x)
                    size += len(x)
                    if size >= 4_000_000:
                        trainer.learn(*_joined(held))
                        n, held, size = n + size // 2, [], 0
            if held:
                trainer.learn(*_joined(held))
                n += size // 2
            if n:
                flat = np.concatenate([x.ravel() for x in trainer.m]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat * n), pa.array(np.full(len(flat), float(n)))], ["at", "v", "n"])

        part = encoded.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == k).select("classes")
        rows = part.mapInArrow(run, "at int, v double, n double").groupBy("at").agg((F.sum("v") / F.sum("n")).alias("v")).toArrow()
        if not rows.num_rows:
            continue
        flat = np.empty(sum(int(np.prod(s)) for s in shapes), np.float32)
        flat[rows.column("at").to_numpy()] = rows.column("v").to_numpy()
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        model = Model(*[x.reshape(s) for x, s in zip(np.split(flat, cuts), shapes)])
    return model


def log_probabilities(model: Model, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Natural log of P(class | context) of every token; equal contexts are normalised once, in matrix products."""
    h = contexts(ids, starts)
    keys = np.zeros(len(ids), np.int64)
    for x in h:
        keys = keys * CLASSES + x
    distinct, place = np.unique(keys, return_inverse=True)
    q = np.zeros((len(distinct), DIM), np.float32)
    rest = distinct
    for s in model.scale[::-1]:
        q += s * model.context[rest % CLASSES]
        rest = rest // CLASSES
    norm = np.empty(len(distinct), np.float32)
    for i in range(0, len(q), 2048):
        scores = q[i:i + 2048] @ model.target.T + model.bias
        top = scores.max(axis=1, keepdims=True)
        norm[i:i + 2048] = top[:, 0] + np.log(np.exp(scores - top).sum(axis=1))
    out = np.empty(len(ids), np.float64)
    for i in range(0, len(ids), 65_536):
        p, w = place[i:i + 65_536], ids[i:i + 65_536]
        out[i:i + 65_536] = np.einsum("ij,ij->i", q[p], model.target[w]) + model.bias[w] - norm[p]
    return out


def class_scores(encoded: DataFrame, model: Model) -> DataFrame:
    """All columns but the blobs, and class_score: the sum of log10 P(class | context) over the text."""
    shared = encoded.sparkSession.sparkContext.broadcast(tuple(model))
    kept = ["row", "doc_id", "held_out", "n_tokens", "hot_known", "hot_log", "class_log"]

    def score(held):
        blobs = [x for b in held for x in b.column("classes").to_pylist()]
        ids, starts = _joined(blobs)
        sums = np.add.reduceat(log_probabilities(Model(*shared.value), ids, starts), starts) / np.log(10)
        at = 0
        for b in held:
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(sums[at:at + len(b)])], [*kept, "class_score"])
            at += len(b)

    def run(batches):
        held, size = [], 0
        for b in batches:
            if len(b):
                held.append(b)
                size += b.nbytes
                if size >= 16_000_000:
                    yield from score(held)
                    held, size = [], 0
        if held:
            yield from score(held)

    schema = ", ".join(c for c in ENCODED.split(", ") if c.split()[0] in kept) + ", class_score double"
    return encoded.select(*kept, "classes").mapInArrow(run, schema)


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Learns from rows whose crc32(doc_id) mod 5 is not 1 (a null id counts as empty text). Null texts are empty: one end
    token. base_score is the smoothed unigram's log10 probability of the text, score the model's. Without training rows
    all words are unseen and the model is uniform over classes. Repeated rows are kept; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    counts = stored(word_counts(own.where(~F.col("held_out"))), "counts")
    vocabulary = classes_of(counts)
    encoded = stored(encode(own, vocabulary), "encoded")
    model = train(encoded.where(~F.col("held_out")), vocabulary.tokens)
    scored = class_scores(encoded, model)
    rare = encoded.select("row", F.explode("rare").alias("word")).join(
        counts.where(F.col("c") < vocabulary.floor) if vocabulary.floor else counts, "word", "left")
    rare = rare.groupBy("row").agg(F.count("c").alias("known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log")).withColumnRenamed("row", "r")
    n, v = vocabulary.n_tokens, vocabulary.n_types
    rare_log = F.coalesce("log", F.lit(0.0))
    return scored.join(rare, F.col("row") == F.col("r"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("hot_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("hot_log") + rare_log - F.col("n_tokens") * F.log10(F.lit(n + 0.5 * (v + 1)))).alias("base_score"),
        (F.col("class_score") + F.col("class_log") + rare_log).alias("score"))


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
