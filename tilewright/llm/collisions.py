"""Operator 11: near copies among vectors of one label, by collision counts on sorted one-dimensional projections."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import stored
from tilewright.llm.components import components

THRESHOLD = 0.93
#: Gaussian lines of the collision count, half width of a query's window in units of the distance of two unit vectors
#: at the threshold, and the share of pairs at the threshold that each of the two filters may miss.
LINES = 32
WINDOW = 1.2
MISSED = 0.0005
#: Distinct vectors that a cell holds on average at most, and those of one side of a task.
CELL_ROWS = 2_048
BLOCK_ROWS = 2_048
SEED = 11


def count_needed(p: float, lines: int = LINES, missed: float = MISSED) -> int:
    """Largest count that a Binomial(lines, p) variable reaches with probability 1 - missed or more."""
    tail = 0.0
    for k in range(lines + 1):
        tail += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if tail > missed:
            return k
    return lines


def tables_needed(bits: int, threshold: float, missed: float = MISSED) -> int:
    """Independent cell tables of ``bits`` sign bits in which a pair at the threshold meets but for a share ``missed``."""
    if not bits:
        return 1
    meets = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(missed) / math.log1p(-meets))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that squares neither overflow nor vanish."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def linked(lines: np.ndarray, units: np.ndarray, table: int, codes: np.ndarray, weight: np.ndarray, left: np.ndarray,
           right: np.ndarray, half: float, needed: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of the rows of one task: each row's weighted links found here and the first row of its component here.

    Every line is sorted once; a row of ``left`` collides on a line with the rows of ``right`` whose projections lie
    within ``half`` of its own (a range of the sorted line). Pairs with ``needed`` collisions are verified on the unit
    vectors. A pair that meets in an earlier table too was counted there.
    """
    n = len(lines)
    links, root = np.zeros(n, np.int64), np.arange(n)
    place = np.full(n, -1)
    place[right] = np.arange(len(right))
    order = np.argsort(lines[right], axis=0, kind="stable")
    ranked = np.take_along_axis(lines[right], order, 0)
    columns = [np.ascontiguousarray(order[:, k]) for k in range(lines.shape[1])]
    low = np.stack([np.searchsorted(ranked[:, k], lines[left, k] - half, "left") for k in range(lines.shape[1])], 1).tolist()
    high = np.stack([np.searchsorted(ranked[:, k], lines[left, k] + half, "right") for k in range(lines.shape[1])], 1).tolist()
    for i, q in enumerate(left.tolist()):
        hit = np.concatenate([c[a:b] for c, a, b in zip(columns, low[i], high[i])])
        near = right[np.bincount(hit, minlength=len(right)) >= needed]
        near = near[near > q] if place[q] >= 0 else near  # within a block, each pair once
        near = near[(units[near] * units[q]).sum(axis=1) >= threshold]
        if table:
            near = near[~(codes[near, :table] == codes[q, :table]).any(axis=1)]
        if len(near):
            links[q] += weight[near].sum()
            links[near] += weight[q]
            met = np.unique(root[np.append(near, q)])
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
    return links, root


def near_copies(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """One row per row of ``vectors``: ``id_col`` (long), n_links, component_id, kept.

    Vectors with equal, non-null labels and equal length link at a cosine of ``threshold`` or more. Equal vectors are one
    place with a weight. A label with at most ``cell_rows`` places is one cell; a larger one is dealt by the signs of
    log2(places / cell_rows) projections, in as many independent tables as make a pair at the threshold meet but for
    MISSED; a cell of more than ``block_rows`` places is cut into blocks, and every two of its blocks meet in a task of
    their own. Tasks count collisions (:func:`linked`), verify exactly, and return per place a weight sum and one link to
    its component there, never pairs; a pair that shares several tables counts in the first.

    Null labels, null or zero vectors, vectors with null or non-finite components and rows without an id link with
    nothing: n_links 0, component_id their own id, kept. Repeated rows are vectors of their own. component_id is the
    smallest id reachable. Equal ids with different vectors stay separate rows. An empty table gives no rows; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"),
                          F.col(label_col).cast("string").alias("label"))
    good = F.expr("id is not null and label is not null and vec is not null and forall(vec, x -> x is not null and not isnan(x)"
                  " and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)")
    good = F.coalesce(good, F.lit(False))
    used, alone = rows.where(good), rows.where(~good)
    places = used.groupBy("label", "vec").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("least")).withColumn(
        "place", F.monotonically_increasing_id())
    places = stored(places, "places")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / cell_rows))).cast("int")
    sizes = places.groupBy("label", F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("label").alias("of"), "d", bits.alias("bits"))
    near = math.sqrt(2 - 2 * threshold)
    half = WINDOW * near
    needed = count_needed(math.erf(WINDOW / math.sqrt(2)))

    def signed(batches):
        for b in batches:
            vecs, depth = b.column("vec"), b.column("bits").to_numpy()
            size = np.diff(vecs.offsets.to_numpy())
            lines: list = [None] * len(b)
            codes: list = [None] * len(b)
            for d, k in set(zip(size.tolist(), depth.tolist())):
                own = np.flatnonzero((size == d) & (depth == k))
                x = unit(vecs.take(pa.array(own)).flatten().to_numpy().reshape(-1, d))
                p = (x @ np.random.default_rng([seed, d]).standard_normal((d, LINES))).astype(np.float32)
                tables = tables_needed(k, threshold)
                s = (x @ np.random.default_rng([seed, d, k]).standard_normal((d, tables * k))).reshape(len(own), tables, k) > 0
                c = (s * (np.int64(1) << np.arange(k, dtype=np.int64))).sum(axis=2, dtype=np.int64)
                for i, at in enumerate(own.tolist()):
                    lines[at], codes[at] = p[i], c[i]
            yield pa.RecordBatch.from_arrays([
                b.column("place"), b.column("label"), b.column("d"), b.column("weight"), vecs,
                pa.array(lines, pa.list_(pa.float32())), pa.array(codes, pa.list_(pa.int64()))],
                ["place", "label", "d", "weight", "vec", "lines", "codes"])

    marked = places.join(sizes, (F.col("label") == F.col("of")) & (F.size("vec") == F.col("d"))).select("place", "label", "d", "weight", "vec", "bits")
    marked = stored(marked.mapInArrow(signed, "place long, label string, d int, weight long, vec array<double>, lines array<float>, codes array<long>"), "lines")
    cell = ["label", "d", "table", "code"]
    counted = marked.select("label", "d", F.posexplode("codes").alias("table", "code")).groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    cells = counted.where("n > 1").select(*[F.col(c).alias("c_" + c) for c in cell], F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    dealt = marked.select("*", F.posexplode("codes").alias("table", "code"))
    dealt = dealt.join(cells, [F.col(c) == F.col("c_" + c) for c in cell]).withColumn("own", F.pmod(F.xxhash64("place", F.lit(seed)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("place", "weight", "vec", "lines", "codes", "own", *cell, F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"))

    def count(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        table, first, second = (group.column(c)[0].as_py() for c in ("table", "first", "second"))
        own = group.column("own").to_numpy()

        def matrix(name: str) -> np.ndarray:
            return np.concatenate([c.flatten().to_numpy() for c in group.column(name).chunks]).reshape(len(own), -1)

        left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
        place = group.column("place").to_numpy()
        links, root = linked(matrix("lines"), unit(matrix("vec")), table, matrix("codes"), group.column("weight").to_numpy(),
                             left, right, half, needed, threshold)
        got = links > 0
        return pa.table({"place": place[got], "links": links[got], "root": place[root[got]]})

    found = stored(dealt.groupBy(*cell, "first", "second").applyInArrow(count, "place long, links long, root long"), "collisions")
    roots = components(found.where("place <> root").select(F.col("place").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("place").agg(F.sum("links").alias("links")).withColumnRenamed("place", "l_place")
    joined = places.join(links, F.col("place") == F.col("l_place"), "left").join(roots, F.col("place") == F.col("node"), "left").select(
        "label", "vec", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "place").alias("root"))
    names = joined.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "n_root")
    judged = joined.join(names, F.col("root") == F.col("n_root")).select(
        F.col("label").alias("j_label"), F.col("vec").alias("j_vec"), "n_links", "component_id")
    whole = used.join(judged, (F.col("label") == F.col("j_label")) & (F.col("vec") == F.col("j_vec"))).select("id", "n_links", "component_id")
    whole = whole.union(alone.select("id", F.lit(0).cast("long"), "id"))
    return whole.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of a label; the operator's recall is calibrated, so the rows are equal but for MISSED at the threshold itself.
SQL = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS vec, row_number() OVER () AS r FROM embeddings),
good AS (
    SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL
    AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (
    SELECT a.r, b.r AS s, a.vec_id, b.vec_id AS to_id FROM good a JOIN good b
    ON a.label = b.label AND len(a.vec) = len(b.vec) AND a.r <> b.r AND list_cosine_similarity(a.vec, b.vec) >= {THRESHOLD}),
reach AS (
    SELECT r, s, to_id FROM link UNION
    SELECT reach.r, link.s, link.to_id FROM reach JOIN link ON reach.s = link.r),
least AS (SELECT r, min(to_id) AS m FROM reach GROUP BY r),
n AS (SELECT r, count(*) AS n FROM link GROUP BY r)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(least(v.vec_id, least.m), v.vec_id) AS component_id,
    coalesce(least(v.vec_id, least.m), v.vec_id) IS NOT DISTINCT FROM v.vec_id AS kept
FROM v LEFT JOIN n USING (r) LEFT JOIN least USING (r)
"""
