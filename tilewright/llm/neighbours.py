"""Operator 10: approximate nearest neighbours by stable projections, kd-trees and a chi-square stopping test."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.common import stored

#: Gaussian (2-stable) projections, even; the search stops where a nearer vector is missed with less than 1 - CONFIDENCE.
PROJECTIONS = 8
CONFIDENCE = 0.99
SEED = 10
#: Rows of a leaf of the upper tree (one task's index), the sample of projected points that its cuts are fitted on
#: (8 at least for every leaf, so a tree has 32,768 leaves at most), rows of a lowest bucket.
LEAF_ROWS = 4_096
SAMPLE_ROWS = 262_144
BUCKET_ROWS = 128
QUERY_BLOCK = 65_536
NEIGHBOURS = 10


def chi_square_quantile(p: float, m: int) -> float:
    """Value that a chi-square variable of even degree ``m`` stays below with probability ``p`` (bisection)."""
    def below(x: float) -> float:
        return 1.0 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    lo, hi = 0.0, 1.0
    while below(hi) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


class Cuts:
    """A kd-tree's cuts in heap order: node i splits axis[i] at value[i]; leaves are numbered from 0."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, m = depth, points.shape[1]
        self.axis, self.value = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        self.low = np.full((1 << depth, m), -np.inf)
        self.high = np.full((1 << depth, m), np.inf)
        groups = {1: (points, np.full(m, -np.inf), np.full(m, np.inf))}
        for node in range(1, 1 << depth):
            own, low, high = groups.pop(node)
            if len(own):
                spread = own.max(axis=0) - own.min(axis=0)
                axis = int(spread.argmax())
                value = float(np.median(own[:, axis]))
            else:
                axis, value = 0, 0.0
            self.axis[node], self.value[node] = axis, value
            right = own[:, axis] >= value if len(own) else np.zeros(0, bool)
            high_left, low_right = high.copy(), low.copy()
            high_left[axis], low_right[axis] = value, value
            groups[2 * node], groups[2 * node + 1] = (own[~right], low, high_left), (own[right], low_right, high)
        for node, (_, low, high) in groups.items():
            self.low[node - (1 << depth)], self.high[node - (1 << depth)] = low, high

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.value[node])
        return node - (1 << self.depth)

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Distance of a point to every leaf's cell."""
        return np.sqrt((np.maximum(0.0, np.maximum(self.low - point, point - self.high)) ** 2).sum(axis=1))


class Buckets:
    """kd-tree over a leaf's projected points: rows in bucket order and each bucket's bounding box."""

    def __init__(self, points: np.ndarray, rows: int = BUCKET_ROWS):
        todo, done = [np.arange(len(points))], []
        while todo:
            own = todo.pop()
            spread = np.ptp(points[own], axis=0) if len(own) else np.zeros(points.shape[1])
            if len(own) <= rows or not spread.max():
                done.append(own)
                continue
            axis = int(spread.argmax())
            order = np.argpartition(points[own, axis], len(own) // 2)
            todo += [own[order[:len(own) // 2]], own[order[len(own) // 2:]]]
        self.rows = done
        self.low = np.array([points[o].min(axis=0) for o in done])
        self.high = np.array([points[o].max(axis=0) for o in done])

    def distances(self, point: np.ndarray) -> np.ndarray:
        return np.sqrt((np.maximum(0.0, np.maximum(self.low - point, point - self.high)) ** 2).sum(axis=1))


def _matrix(column) -> np.ndarray:
    """List column without nulls as a float64 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vec of the rows that take part: an id, and a vector without null, NaN or infinity that is not zero.

    Vectors shorter or longer than the most frequent length (the longer of equals) cannot be compared and take no part.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).where(
        "id is not null and vec is not null and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        " and exists(vec, x -> x <> 0)")
    size = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("vec") == (size["d"] if size else 0)).distinct()


def nearest(vectors: DataFrame, query_every: int, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS,
            projections: int = PROJECTIONS, confidence: float = CONFIDENCE, leaf_rows: int = LEAF_ROWS,
            query_block: int = QUERY_BLOCK, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose id is divisible by ``query_every``.

    All rows are projected to a few dimensions and dealt by an upper kd-tree, whose cuts are fitted on a bounded sample;
    every leaf indexes all its rows. A tree that is as deep as the sample allows has larger leaves; their rows are dealt into
    parts of about ``leaf_rows``, each with its own index, and a query visits all parts. A query first visits its own leaf; its k-th distance r there bounds the search: all
    leaves and buckets within r * sqrt(chi-square quantile) in the projected space are visited from the nearest on, r
    falls as vectors are verified, and the search stops where the test says that a nearer vector is improbable.
    Equal vectors are one location that keeps its k + 1 smallest ids (more cannot be among the k nearest of any
    query), so a common vector costs one search. Distances are Euclidean in double precision, ties go to the smaller
    id; rows with the query's own id are no candidates and equal rows count once. Rows that take no part: see
    :func:`usable`. Fewer candidates than k give all of them; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    found = k + 1
    rows = stored(usable(vectors, id_col, vector_col), "vectors")
    by_vec = Window.partitionBy("vec").orderBy("id")
    places = stored(rows.withColumn("n", F.row_number().over(by_vec)).where(F.col("n") <= found).groupBy("vec").agg(
        F.sort_array(F.collect_list("id")).alias("ids")), "places")
    n = places.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = rows.where(F.col("id") % query_every == 0)
    searched = stored(queries.groupBy("vec").agg(F.min("id").alias("qid")), "queries")
    n_queries = searched.count()

    dim = len(places.select("vec").first()["vec"])
    matrix = np.random.default_rng(seed).standard_normal((dim, projections))
    depth = max(0, min(math.ceil(math.log2(n / leaf_rows)) if n > leaf_rows else 0, int(math.log2(sample_rows // 8))))
    parts = math.ceil(n / (leaf_rows << depth))
    share = min(1.0, sample_rows / n)
    bound = int(share * 0.9 * 2**32) if share < 1 else 2**32
    sample = places.where(F.pmod(F.xxhash64(F.col("ids")[0], F.lit(seed)), F.lit(2**32)) < bound).select("vec").limit(sample_rows)

    def projected(batches):
        for b in batches:
            flat = (_matrix(b.column("vec")) @ matrix if len(b) else np.zeros((0, projections))).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(flat.reshape(-1, projections).tolist(), pa.list_(pa.float64()))], ["point"])

    cuts = Cuts(_matrix(sample.mapInArrow(projected, "point array<double>").toArrow().column("point")), depth)
    reach = math.sqrt(chi_square_quantile(confidence, projections))

    def leaves(batches):
        for b in batches:
            leaf = cuts.leaf(_matrix(b.column("vec")) @ matrix) if len(b) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], [*b.schema.names, "leaf"])

    def routes(batches):
        for b in batches:
            out = []
            points = _matrix(b.column("vec")) @ matrix if len(b) else []
            for i, (point, r) in enumerate(zip(points, b.column("r").to_pylist())):
                out += [(i, leaf) for leaf in np.flatnonzero(cuts.distances(point) <= r * reach)]
            at = pa.array([i for i, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("qid").take(at), b.column("vec").take(at), b.column("r").take(at),
                                              pa.array([x for _, x in out], pa.int64())], ["qid", "vec", "r", "leaf"])

    def search(here: pa.Table, asked: pa.Table) -> pa.Table:
        """The nearest ids to every asked query among one leaf's rows."""
        out = []
        if here.num_rows and asked.num_rows:
            vecs, wanted = _matrix(here.column("vec")), _matrix(asked.column("vec"))
            ids = here.column("ids").to_pylist()
            points, asked_points = vecs @ matrix, wanted @ matrix
            tree = Buckets(points)
            for qid, q, point, r in zip(asked.column("qid").to_pylist(), wanted, asked_points, asked.column("r").to_pylist()):
                best: list[tuple[float, int]] = []
                away = tree.distances(point)
                for b in np.argsort(away, kind="stable"):
                    if away[b] > r * reach:
                        break
                    own = tree.rows[b]
                    own = own[np.sqrt(((points[own] - point) ** 2).sum(axis=1)) <= r * reach]
                    dist = np.sqrt(((vecs[own] - q) ** 2).sum(axis=1))
                    near = dist <= r
                    if near.any():
                        best += [(d, x) for d, i in zip(dist[near].tolist(), own[near].tolist()) for x in ids[i]]
                        best = sorted(best)[:found]
                        if len(best) == found:
                            r = best[-1][0]
                out += [(qid, x, d) for d, x in best]
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["qid", "id", "score"])

    blocks = max(1, math.ceil(n_queries / query_block))
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    indexed = places.mapInArrow(leaves, "vec array<double>, ids array<long>, leaf long").withColumn(
        "part", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(parts)))

    def searched_in(routed: DataFrame) -> DataFrame:
        routed = routed.withColumn("block", block)
        wanted = routed.select(F.col("leaf").alias("at"), F.col("block").alias("of")).distinct()
        sides = indexed.join(wanted, F.col("leaf") == F.col("at")).select("vec", "ids", F.col("at").alias("leaf"), F.col("of").alias("block"), "part")
        asked = routed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        return sides.groupBy("leaf", "block", "part").cogroup(asked.groupBy("leaf", "block", "part")).applyInArrow(
            lambda here, asked: search(here, asked), "qid long, id long, score double")

    home = searched.withColumn("r", F.lit(float("inf"))).select("vec", "qid", "r").mapInArrow(
        leaves, "vec array<double>, qid long, r double, leaf long")
    by_score = Window.partitionBy("qid").orderBy("score", "id")
    own = searched_in(home).withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= found)
    radius = own.groupBy("qid").agg(F.max("score").alias("r"), F.count("id").alias("n"))
    radius = radius.select(F.col("qid").alias("q"), F.when(F.col("n") == found, F.col("r")).otherwise(F.lit(float("inf"))).alias("r"))
    bounded = searched.join(radius, F.col("qid") == F.col("q"), "left").select("qid", "vec", F.coalesce("r", F.lit(float("inf"))).alias("r"))
    routed = stored(bounded.mapInArrow(routes, "qid long, vec array<double>, r double, leaf long"), "routes")
    hits = searched_in(routed)
    best = hits.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= found)
    best = stored(best.select("qid", "id", "score"), "hits")
    asked = queries.join(searched.select("vec", "qid"), "vec").select(F.col("id").alias("query_id"), "qid")
    pairs = asked.join(best, "qid").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 100)
