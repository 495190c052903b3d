"""Operator 2: language by n-gram Bloom filters whose slots hold a bitmask of languages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.common import documents, fold, fresh, stored, text_slices

#: Slots of the filter (a power of two) and hash multipliers, one per hash function (odd, below 2^31).
SLOT_BITS = 21
MULTIPLIERS = (1640531527, 1181783497, 1013904223)
#: An n-gram belongs to a language if it occurs there MIN_COUNT times at least, and at a rate
#: of RATE_SHARE of its highest rate in any language at least.
MIN_COUNT = 3
RATE_SHARE = 0.34
UNKNOWN = "und"
#: Bytes of text whose windows a task holds at a time: some 15 MB of arrays.
SLICE_BYTES = 400_000

# A-Z to a-z; other ASCII characters to a space; bytes of other characters stay.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)
BLANK = 0x20202020


def four_grams(texts: list[bytes | None]):
    """(keys, starts, ends) of the 4-byte windows of the texts, each between two spaces at either side.

    Windows of text i are keys[starts[i]:ends[i]]; windows between two texts are left out by these ranges.
    """
    raw = [t or b"" for t in texts]
    data = FOLD[np.frombuffer(b"  " + b"    ".join(raw) + b"  ", np.uint8)].astype(np.uint32)
    keys = data[:-3] << 8
    for part in (data[1:-2], data[2:-1]):
        keys |= part
        keys <<= 8
    keys |= data[3:]
    sizes = np.array([len(r) for r in raw], np.int64)
    starts = np.cumsum(sizes + 4) - sizes - 4
    return keys, starts, starts + sizes + 1


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): occurrences of every 4-byte window in all texts of every language."""

    def run(batches):
        known: dict[str, tuple] = {}  # per language: sorted windows and their counts so far

        def add(lang, keys, n):
            if lang in known:
                k, at = np.unique(np.concatenate([known[lang][0], keys]), return_inverse=True)
                n = np.bincount(at, np.concatenate([known[lang][1], n])).astype(np.int64)
                keys = k
            known[lang] = (keys, n)

        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                for _, texts in text_slices(b.column("text").take(pa.array(np.flatnonzero(langs == lang))), SLICE_BYTES):
                    keys, starts, ends = four_grams(texts)
                    inside = np.zeros(len(keys) + 1, np.int64)
                    np.add.at(inside, starts, 1)
                    np.add.at(inside, ends, -1)
                    add(lang, *np.unique(keys[np.cumsum(inside)[:-1] > 0], return_counts=True))
        for lang, (keys, n) in known.items():
            for i in range(0, len(keys), 100_000):
                part = keys[i:i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array(part.astype(np.int64)), pa.array(n[i:i + 100_000].astype(np.int64))],
                    ["lang", "gram", "n"])

    counted = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    return (counted.mapInArrow(run, "lang string, gram long, n long").where(F.col("gram") != BLANK)
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def positions(gram, slot_bits: int) -> list:
    """Slots of a window, one per hash function: the high bits of the low 32 bits of a product."""
    low = 0xFFFFFFFF
    return [F.shiftright((gram * F.lit(m)).bitwiseAND(F.lit(low)), 32 - slot_bits) for m in MULTIPLIERS]


def fit(docs: DataFrame, slot_bits: int = SLOT_BITS, min_count: int = MIN_COUNT, rate_share: float = RATE_SHARE):
    """Train on all rows with a text and a lang: (languages, masks[words, slots], false-positive rates, default).

    Languages are in code-point order; bit i of the masks stands for language i. The driver gets one count per
    language and at most 2^slot_bits slots, never n-grams.
    """
    counts = stored(gram_counts(docs), "grams")
    totals = {r["lang"]: r["t"] for r in counts.groupBy("lang").agg(F.sum("n").alias("t")).collect()}
    langs = sorted(totals)
    n_words = max(1, (len(langs) + 62) // 63)
    masks = np.zeros((n_words, 1 << slot_bits), np.int64)
    if not langs:
        return langs, masks, np.zeros(0), UNKNOWN
    spark = docs.sparkSession
    ids = spark.createDataFrame([(x, i // 63, 1 << (i % 63), float(totals[x])) for i, x in enumerate(langs)],
                                "lang string, word int, bit long, total double")
    rated = counts.join(ids, "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"))
    chosen = rated.where(F.col("n") >= min_count).join(best, "gram").where(F.col("rate") >= rate_share * F.col("best"))
    slots = (chosen.select("word", "bit", F.explode(F.array(*positions(F.col("gram"), slot_bits))).alias("slot"))
             .groupBy("word", "slot").agg(F.bit_or("bit").alias("mask")).toPandas())
    masks[slots["word"].to_numpy(int), slots["slot"].to_numpy(int)] = slots["mask"].to_numpy(np.int64)
    fill = np.array([float(((masks[i // 63] >> (i % 63)) & 1).mean()) for i in range(len(langs))])
    return langs, masks, fill ** len(MULTIPLIERS), max(langs, key=lambda x: (totals[x], x))


def predict(docs: DataFrame, model, slot_bits: int = SLOT_BITS, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` and the two of ``names``, prediction and score (existing columns of these names are replaced).

    A window is looked up in all hash slots at once: the masks' AND has a bit for every language that holds it.
    Bits per language are counted over the text and corrected for the filter's false positives,
    t = (hits - windows * f) / (1 - f), not below 0. The most hits win, ties go to the first language by code point;
    score is its share of all languages' corrected hits. A text without letters (or null) is ``und`` with score 0;
    one with letters that fits no language is the most frequent language with score 0.
    """
    langs, masks, wrong, default = model
    if (1 << 8) > (1 << len(langs)) and len(masks) == 1:
        masks = masks.astype(np.uint8)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((langs, masks, wrong, default))  # size fixed by slot_bits and the languages
    kept = docs.drop(*names)
    schema = T.StructType([*kept.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches):
        import re

        ascii_letter = re.compile(b"[A-Za-z]")
        langs, masks, wrong, default = shared.value
        n_langs = len(langs)
        for b in batches:
            label, score = [], []
            for _, texts in text_slices(b.column("text"), SLICE_BYTES):
                keys, starts, ends = four_grams(texts)
                hits = np.zeros((len(texts), n_langs))
                for word in range(len(masks) if n_langs else 0):
                    held = masks[word][(keys * np.uint32(MULTIPLIERS[0])) >> np.uint32(32 - slot_bits)]
                    for m in MULTIPLIERS[1:]:
                        held &= masks[word][(keys * np.uint32(m)) >> np.uint32(32 - slot_bits)]
                    held = np.append(held, np.zeros(1, held.dtype))
                    for k in range(word * 63, min(n_langs, word * 63 + 63)):
                        one = ((held >> held.dtype.type(k % 63)) & held.dtype.type(1)).astype(np.int32)
                        hits[:, k] = np.add.reduceat(one, np.stack([starts, ends], 1).ravel())[::2]
                windows = (ends - starts)[:, None]
                true = np.maximum(0.0, (hits - windows * wrong) / (1.0 - wrong)) if n_langs else hits
                total = true.sum(axis=1)
                best = true.argmax(axis=1) if n_langs else np.zeros(len(texts), int)
                for r, t in enumerate(texts):
                    if not n_langs or not t or not (ascii_letter.search(t) or any(c.isalpha() for c in t.decode())):
                        label.append(UNKNOWN)
                        score.append(0.0)
                    elif total[r] <= 0:
                        label.append(default)
                        score.append(0.0)
                    else:
                        label.append(langs[best[r]])
                        score.append(float(true[r, best[r]] / total[r]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(label, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, *names])

    return kept.mapInArrow(run, schema)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    Learns from rows whose crc32(doc_id) mod 5 is not 0 and whose lang is not null; predictions see the text alone.
    Null ids count as empty text in the fold rule. Without a training row every prediction is ``und``.
    Repeated rows are kept; an empty table gives no rows; other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(own.where(fold(F.col("doc_id")) != 0))
    out = predict(own.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def with_language(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text has a language, all columns untouched; learns as :func:`language_id` does.

    Dropped are null texts, texts without a letter and texts whose windows fit no language. Needs doc_id, text, lang of
    any castable type. Null ids count as empty text in the fold rule; repeated rows are kept or dropped alike; without a
    training row nothing is kept; an empty table gives no rows. Columns called lang_pred or score are the caller's own.
    """
    names = fresh(docs, "lang_pred"), fresh(docs, "score")
    learnt = docs.where(fold(F.col("doc_id")) != 0).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    judged = predict(docs, fit(learnt), names=names)
    return judged.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) > 0)).select(*docs.columns)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))
