"""Operator 3: SimHash fingerprints and near-duplicate components by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.common import documents, fresh, lower_words, stored
from tilewright.llm.components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Leading bits of a variant by which variants are dealt to tasks; each task expands the remaining bits. The fewest
#: are taken with which a prefix gets about PREFIX_ROWS rows or fewer (16 bytes each).
PREFIX_BITS = (16, 24, 32)
PREFIX_ROWS = 1_048_576
#: Rows that a task takes at a time (whole prefixes), and variants beyond which a block is dealt on by more bits.
BLOCK_ROWS = 16_384
BLOCK_VARIANTS = 4_000_000
U1 = np.uint64(1)


def simhash(words: list[bytes]) -> int:
    """64-bit fingerprint: a bit is set if it is set in over half of the hashes of all 4-word shingles."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:1 - SHINGLE].tolist()
    hashes = [xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1:].tolist())]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = np.array(hashes[i:i + 4096], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((U1 << np.flatnonzero(2 * ones > len(hashes)).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but text, and fp (the fingerprint as a signed long)."""
    kept = [c for c in docs.columns if c not in ("text", "fp")]

    def run(batches):
        for b in batches:
            fps = np.array([simhash(lower_words(t)) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(fps.view(np.int64))], [*kept, "fp"])

    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("fp", T.LongType())])
    return docs.select(*kept, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def flips(bits: range, most: int) -> np.ndarray:
    """Masks with at most ``most`` of ``bits`` set, the empty mask first."""
    return np.array([sum(1 << i for i in c) for r in range(most + 1) for c in combinations(bits, r)], np.uint64)


def prefix_bits_for(n: int, radius: int = RADIUS, rows: int = PREFIX_ROWS) -> int:
    """Prefix length for ``n`` distinct fingerprints: groups stay bounded while the corpus grows; the links are the same."""
    sent = {b: n * sum(comb(b, k) for k in range(radius // 2 + 1)) / 2**b for b in PREFIX_BITS}
    return next((b for b in PREFIX_BITS if sent[b] <= rows), PREFIX_BITS[-1])


def variant_links(fps: DataFrame, radius: int = RADIUS, prefix_bits: int = PREFIX_BITS[0]) -> DataFrame:
    """Links (a, b) that join the same fingerprints as all pairs within ``radius`` (even) do; ``fps``: distinct fp.

    Two fingerprints within the radius share a variant within half of it. Variants are dealt by their leading bits:
    a fingerprint is sent once to every prefix that its variants have, and the task makes the variants with that
    prefix (so 137 short rows travel per fingerprint instead of 2,081 variants). Fingerprints that meet in a variant
    are within the radius of each other, so each is linked to the smallest of them only: no pair of a large
    group is listed, and no component is lost. Links are deduplicated and verified by popcount.
    """
    half = radius // 2
    heads = [int(m) for m in flips(range(prefix_bits), half)]
    sent = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in heads])).alias("head"))
    prefix = F.shiftrightunsigned(F.col("fp"), 64 - prefix_bits)
    sent = sent.select(prefix.bitwiseXOR(F.col("head").cast("long")).alias("prefix"), "fp")

    made: dict[tuple[int, int], np.ndarray] = {}

    def flips_of(bits: int, most: int) -> np.ndarray:
        if (bits, most) not in made:
            made[bits, most] = flips(range(bits), most)
        return made[bits, most]

    def block(prefixes: np.ndarray, fp: np.ndarray, bits: int = prefix_bits) -> np.ndarray:
        """Links among the rows of whole prefixes of ``bits`` bits; a block with many variants is dealt on by more bits."""
        rest = 64 - bits
        diff = prefixes ^ (fp >> np.uint64(rest))
        used = np.bitwise_count(diff)
        masks = [flips_of(rest, half - k) for k in range(half + 1)]
        if rest > 8 and sum(int((used == k).sum()) * len(masks[k]) for k in range(half + 1)) > BLOCK_VARIANTS:
            found, longer, own = [], [], []
            for k in range(half + 1):
                at = np.flatnonzero(used == k)
                head = (prefixes[at] << np.uint64(8)) | ((fp[at] >> np.uint64(rest - 8)) & np.uint64(255))
                more = flips_of(8, half - k)
                longer.append((head[:, None] ^ more[None, :]).ravel())
                own.append(np.repeat(fp[at], len(more)))
            longer, own = np.concatenate(longer), np.concatenate(own)
            order = np.argsort(longer)
            longer, own = longer[order], own[order]
            cuts = np.flatnonzero(np.r_[True, longer[1:] != longer[:-1], True])
            at = 0
            while at < len(cuts) - 1:  # whole prefixes, about BLOCK_ROWS rows each time
                to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + BLOCK_ROWS, "right")) - 1)
                found.append(block(longer[cuts[at]:cuts[to]], own[cuts[at]:cuts[to]], bits + 8))
                at = to
            return np.unique(np.concatenate(found), axis=0)
        base = fp ^ (diff << np.uint64(rest))
        at = [np.flatnonzero(used == k) for k in range(half + 1)]
        variants = np.concatenate([(base[i][:, None] ^ m[None, :]).ravel() for i, m in zip(at, masks)])
        source = np.concatenate([np.repeat(fp[i], len(m)) for i, m in zip(at, masks)])
        order = np.argsort(variants)
        variants, source = variants[order], source[order]
        same = np.zeros(len(variants), bool)
        same[1:] = variants[1:] == variants[:-1]
        near = same.copy()
        near[:-1] |= same[1:]
        source, first = source[near], ~same[near]
        if not len(source):
            return np.zeros((0, 2), np.uint64)
        least = np.minimum.reduceat(source, np.flatnonzero(first))[np.cumsum(first) - 1]
        links = np.stack([source, least], 1)[source != least]
        links = np.unique(links, axis=0) if len(links) else links
        return links[np.bitwise_count(links[:, 0] ^ links[:, 1]) <= radius]

    def run(batches):
        # Rows come sorted by prefix; a block ends where a prefix ends.
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for b in batches:
            held.append((b.column("prefix").to_numpy().astype(np.uint64), b.column("fp").to_numpy().view(np.uint64)))
            rows += len(held[-1][0])
            while rows > BLOCK_ROWS:
                p, f = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(p, p[min(BLOCK_ROWS, len(p) - 1)], "left")) or int(np.searchsorted(p, p[0], "right"))
                if cut == len(p):
                    held = [(p, f)]
                    break
                yield batch(block(p[:cut], f[:cut]))
                held, rows = [(p[cut:], f[cut:])], len(p) - cut
        if rows:
            yield batch(block(*(np.concatenate(x) for x in zip(*held))))

    def batch(links: np.ndarray) -> pa.RecordBatch:
        links = np.ascontiguousarray(links).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], ["a", "b"])

    return sent.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` but text, then fp, fingerprint (16 hex digits) and component_id.

    component_id is the smallest ``id_col`` of the component (null only if all its ids are null). Texts without a
    word (null, empty) have fingerprint 0 and are linked like any other. Copies share a fingerprint and are searched
    once. Repeated rows are kept; an empty table gives no rows. ``docs`` must give the same rows when read again.
    """
    base = docs.drop("fp", "fingerprint", "component_id")
    marked = stored(fingerprints(base), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min(id_col).alias("least_id")), "distinct")
    bits = prefix_bits_for(distinct.count())
    roots = components(stored(variant_links(distinct.select("fp"), prefix_bits=bits), "ball"))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    own = fresh(marked, "own_fp")
    by_fp = rooted.join(names, "root").select(F.col("fp").alias(own), "component_id")
    return marked.join(by_fp, marked["fp"] == by_fp[own]).drop(own).withColumn(
        "fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
