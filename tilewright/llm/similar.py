"""Near copies by Jaccard similarity of five-word shingles: banded minhashes propose pairs, the exact similarity decides."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import fresh, stored, text_slices
from tilewright.llm.components import components
from tilewright.llm.simhash import near_duplicates

SHINGLE = 5
SIMILARITY = 0.8
#: Bands of ROWS minhashes. Two texts of similarity s in a crowd of texts of mutual similarity b share a bucket outside
#: the crowd with probability 1 - (1 - s^ROWS + b^ROWS)^BANDS: 0.997 at 0.82 against 0.75.
BANDS = 40
ROWS = 4
#: Bands of the first pass; what it joins needs no check in the second.
FIRST = 8
#: A pair is checked if the share of its equal signature bytes lies at most so many standard deviations below SIMILARITY.
DEVIATIONS = 4.0
SEED = 43
#: Shingle hashes that are permuted at a time.
BLOCK = 1024


def shingles(words: list[bytes]) -> set[bytes]:
    """All runs of five words; a shorter text is one shingle, a text without words has none."""
    return {b" ".join(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def similar(a: set[bytes], b: set[bytes]) -> bool:
    common = len(a & b)
    return common > 0 and common >= SIMILARITY * (len(a) + len(b) - common)


def lower_words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def signature(grams: set[bytes], factors: np.ndarray) -> tuple[list[int], bytes]:
    """(one signed 64-bit key per band, low byte of every minhash)."""
    from xxhash import xxh64_intdigest

    hashes = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams))
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), BLOCK):
        least = np.minimum(least, (factors[:, None] * hashes[None, i:i + BLOCK]).min(axis=1))
    keys = [xxh64_intdigest(least[k * ROWS:(k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist(), (least >> np.uint64(32)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, row_col: str) -> DataFrame:
    """row, keys, sig of one row (the smallest) of each distinct sequence of lower-cased words; texts without words are left out."""
    factors = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(batches):
        for b in batches:
            numbers = b.column(row_col).to_pylist()
            for at, texts in text_slices(b.column("text")):
                rows, digests, keys, sigs = [], [], [], []
                for row, text in zip(numbers[at:at + len(texts)], texts):
                    if words := lower_words(text):
                        rows.append(row)
                        digests.append(md5(b" ".join(words)).digest())
                        for out, x in zip((keys, sigs), signature(shingles(words), factors)):
                            out.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                                                  pa.array(sigs, pa.binary())], ["row", "digest", "keys", "sig"])

    signed = docs.select(F.col(row_col).cast("long").alias(row_col), F.col("text").cast("string").alias("text")).mapInArrow(
        sign, "row long, digest binary, keys array<long>, sig binary")
    return signed.groupBy("digest").agg(F.min("row").alias("row"), F.first("keys").alias("keys"), F.first("sig").alias("sig")).drop("digest")


def proposed(signed: DataFrame, first: int, last: int) -> DataFrame:
    """Pairs (a > b): each row of a bucket of the bands from ``first`` to before ``last`` with two members of the bucket."""
    dealt = signed.select("row", F.explode(F.slice("keys", first + 1, last - first)).alias("key"))
    # A row number xor-ed with a number made from the key: least and largest of them are two members picked anew in each bucket.
    mask = F.xxhash64("key").bitwiseAND(F.lit(2**63 - 1))
    heads = dealt.groupBy("key").agg(
        F.min(F.col("row").bitwiseXOR(mask)).alias("least"), F.max(F.col("row").bitwiseXOR(mask)).alias("most")).where("least <> most")
    heads = heads.select(F.col("key").alias("of"), F.explode(F.array(F.col("least").bitwiseXOR(mask), F.col("most").bitwiseXOR(mask))).alias("head"))
    return dealt.join(heads, F.col("key") == F.col("of")).where("row <> head").select(
        F.greatest("row", "head").alias("a"), F.least("row", "head").alias("b")).distinct()


def likely(batches):
    """Pairs whose signatures leave a similarity of SIMILARITY possible."""
    least = SIMILARITY - DEVIATIONS * (SIMILARITY * (1 - SIMILARITY) / (BANDS * ROWS)) ** 0.5
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("a_sig", "b_sig"))
        good = pa.array((x == y).mean(axis=1) >= least)
        yield pa.RecordBatch.from_arrays([b.column(c).filter(good) for c in ("a", "b", "a_part", "b_part")], ["a", "b", "a_part", "b_part"])


def checked(batches):
    for b in batches:
        texts = zip(*[b.column(c).cast(pa.binary()).to_pylist() for c in ("a_text", "b_text")])
        good = pa.array([similar(shingles(lower_words(x)), shingles(lower_words(y))) for x, y in texts], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(c).filter(good) for c in ("a", "b", "a_part", "b_part")], ["a", "b", "a_part", "b_part"])


def joined_parts(docs: DataFrame, parts: DataFrame, row_col: str) -> DataFrame:
    """(row, part) of ``parts``, with parts joined that hold texts of similarity 0.8 or more; the smallest part stays.

    ``docs``: ``row_col`` (long, not negative, unique) and text, a stored table; ``parts``: row, part (long). In a bucket
    (equal band keys) every text is held against two members of it, which differ from band to band, so a large group of
    near copies gives 2 * BANDS pairs a text and not all pairs. Pairs within a part need no check; the others are sifted
    by their signatures and then checked on the shingles themselves. The second pass sees the parts that the first joined.
    """
    plain = docs.select(F.col(row_col).cast("long").alias("row"), F.col("text").cast("string").alias("text"))
    signed = stored(signatures(docs, row_col), "signatures")
    kept = "a long, b long, a_part long, b_part long"
    for first, last in ((0, FIRST), (FIRST, BANDS)):
        pairs = proposed(signed, first, last)
        facts = signed.select("row", "sig").join(parts.withColumnRenamed("row", "of"), F.col("row") == F.col("of")).drop("of")
        for side in ("a", "b"):
            pairs = pairs.join(facts.select(F.col("row").alias(side), F.col("sig").alias(f"{side}_sig"), F.col("part").alias(f"{side}_part")), side)
        pairs = stored(pairs.where("a_part <> b_part").mapInArrow(likely, kept), "likely")
        for side in ("a", "b"):
            pairs = pairs.join(plain.select(F.col("row").alias(side), F.col("text").alias(f"{side}_text")), side)
        links = stored(pairs.mapInArrow(checked, kept), "similar")
        roots = components(links.select(F.col("a_part").alias("a"), F.col("b_part").alias("b")))
        parts = stored(parts.join(roots, F.col("part") == F.col("node"), "left").select("row", F.coalesce("root", "part").alias("part")), "parts")
    return parts


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, all columns untouched: the smallest doc_id (null last).

    Linked are texts whose fingerprints lie within op3's radius and texts whose five-word shingles have similarity 0.8 or
    more. Null and empty texts share fingerprint zero and are one group. Equal rows, also with equal ids, leave one;
    ties go to one row of the stored table. Rows without an id are told apart by their place. An empty table gives none.
    """
    row = fresh(docs, "row_number")
    marked = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(marked.select(F.col(row).alias("row"), "text"), "row").select("row", F.col("component_id").alias("part"))
    parts = joined_parts(marked.select(F.col(row).alias("row"), "text"), stored(found, "parts"), "row")
    ids = marked.select(F.col(row).alias("of"), F.col("doc_id").alias("id"))
    least = parts.join(ids, F.col("row") == F.col("of")).groupBy("part").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("m"))
    kept = least.select(F.col("m.row").alias(fresh(marked, "kept_row")))
    return marked.join(kept, marked[row] == kept[kept.columns[0]], "left_semi").select(*docs.columns)
