"""Operator 12: exact integer k-means whose distances are filtered by PCA-rotated lower bounds."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import stored

DIMENSION = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
#: Leading rotated coordinates that are stored next to the residual norm.
LEADING = 16
#: Integer components are clamped to this range, so that squared distances fit a long.
MOST = 2**27
#: Share of the squared norms that the floating-point bounds may be off by.
SLACK = 1e-9


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array<int>): floor(256 x) of every vector with exactly 64 components, none null or non-finite."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).where(
        f"size(vec) = {DIMENSION} and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return rows.select("id", F.expr(f"transform(vec, x -> cast(greatest(least(floor(cast({SCALE} * x as double)), {MOST}), -{MOST}) as int))").alias("v"))


def matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def rotation(rows: DataFrame, fallback: np.ndarray | None = None) -> np.ndarray:
    """Principal axes (columns, largest variance first) of all rows, from co-moments that tasks sum before the shuffle."""
    at = np.triu_indices(DIMENSION)

    def moments(batches):
        total, count, square = np.zeros(DIMENSION), 0, np.zeros((DIMENSION, DIMENSION))
        for b in batches:
            x = matrix(b.column("v"), DIMENSION).astype(float)
            total, count, square = total + x.sum(axis=0), count + len(x), square + x.T @ x
        if count:
            keys = np.concatenate([np.arange(DIMENSION) * DIMENSION * 2, at[0] * DIMENSION * 2 + at[1] + 1, [-1]])
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(np.concatenate([total, square[at], [count]]))], ["k", "x"])

    sums = {r["k"]: r["x"] for r in rows.select("v").mapInArrow(moments, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()}
    if not sums:
        return np.eye(DIMENSION)
    mean = np.array([sums[i * DIMENSION * 2] for i in range(DIMENSION)]) / sums[-1]
    cov = np.zeros((DIMENSION, DIMENSION))
    cov[at] = [sums[int(i) * DIMENSION * 2 + int(j) + 1] for i, j in zip(*at)]
    cov = cov / sums[-1]
    cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
    return np.linalg.eigh(cov)[1][:, ::-1].copy()


def rotated(v: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates along ``axes`` and the norm of the rest."""
    y = v.astype(float) @ axes
    return y[:, :leading].copy(), np.sqrt((y[:, leading:] ** 2).sum(axis=1))


def assign(v: np.ndarray, head: np.ndarray, rest: np.ndarray, centroids: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, exact distances that were computed) of the rows of ``v``; ties: smaller number.

    A squared distance is the leading coordinates' plus the residuals', and the latter is at least the squared difference
    of their norms. The centroid of least bound is computed exactly; those whose bound does not exceed it are verified.
    """
    c_head, c_rest = rotated(centroids, axes, head.shape[1])
    bound = (head**2).sum(axis=1)[:, None] - 2 * head @ c_head.T + (c_head**2).sum(axis=1)[None, :] + (rest[:, None] - c_rest[None, :]) ** 2
    scale = ((head**2).sum(axis=1) + rest**2)[:, None] + ((c_head**2).sum(axis=1) + c_rest**2)[None, :] + 1
    bound -= SLACK * scale

    def exact(at: np.ndarray, k) -> np.ndarray:
        diff = v[at].astype(np.int64) - centroids[k]
        return (diff * diff).sum(axis=1)

    every = np.arange(len(v))
    near = bound.argmin(axis=1)
    best = exact(every, near)
    done = len(v)
    for k in range(len(centroids)):
        at = np.flatnonzero((bound[:, k] <= best) & (near != k))
        if len(at):
            d = exact(at, k)
            done += len(at)
            better = (d < best[at]) | ((d == best[at]) & (k < near[at]))
            near[at[better]], best[at[better]] = k, d[better]
    return near, best, done


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS,
                      rounds: int = ROUNDS, leading: int = LEADING) -> DataFrame:
    """id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Rows are turned into integers, rotated once and stored with their leading coordinates and residual norm; every round
    is one scan whose tasks return a count and a component sum per centroid. Vectors of another length or with null or
    non-finite components, and null vectors, are left out. Components beyond +-2^27 after scaling are clamped. Rows
    without an id are clustered but never start a centroid; repeated rows count as often as they occur (equal hashes
    of starting vectors: by their components). Fewer than ``k`` rows with an id give fewer centroids, none at all or an
    empty table give no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    own = integers(vectors, id_col, vector_col)
    start = own.where("id is not null").select("v", F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256).alias("h")).orderBy("h", "v").limit(k)
    centroids = np.array([r["v"] for r in start.collect()], np.int64).reshape(-1, DIMENSION)
    schema = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    axes = rotation(own)

    def turn(batches):
        for b in batches:
            head, rest = rotated(matrix(b.column("v"), DIMENSION), axes, leading)
            head = pa.ListArray.from_arrays(pa.array(np.arange(0, head.size + 1, leading, dtype=np.int32)), pa.array(head.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), head, pa.array(rest)], ["id", "v", "head", "rest"])

    rows = stored(own.mapInArrow(turn, "id long, v array<int>, head array<double>, rest double"), "rotated")

    def assigned(b, centroids):
        return assign(matrix(b.column("v"), DIMENSION), matrix(b.column("head"), leading), b.column("rest").to_numpy(), centroids, axes)[:2]

    for _ in range(rounds):
        def sums(batches, centroids=centroids):
            total, count = np.zeros((len(centroids), DIMENSION), np.int64), np.zeros(len(centroids), np.int64)
            for b in batches:
                near, _ = assigned(b, centroids)
                np.add.at(total, near, matrix(b.column("v"), DIMENSION))
                count += np.bincount(near, minlength=len(centroids))
            for c in np.flatnonzero(count).tolist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c] * (DIMENSION + 1), pa.int32()), pa.array(range(DIMENSION + 1), pa.int32()), pa.array([*total[c].tolist(), int(count[c])], pa.int64())],
                    ["cluster", "i", "x"])

        moved = rows.select("v", "head", "rest").mapInArrow(sums, "cluster int, i int, x long").groupBy("cluster", "i").agg(
            F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
        of: dict[int, dict[int, int]] = {}
        for r in moved:
            of.setdefault(r["cluster"], {})[r["i"]] = int(r["x"])
        centroids = centroids.copy()
        for c, x in of.items():
            centroids[c] = [x[i] // x[DIMENSION] for i in range(DIMENSION)]

    def last(batches):
        for b in batches:
            near, best = assigned(b, centroids)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(near.astype(np.int32)), pa.array(best)], ["id", "cluster", "distance"])

    final = stored(rows.mapInArrow(last, "id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: int(r["s"]) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = [(c, s, sum(inertia.values()), sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    facts = spark.createDataFrame(facts, "c int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row per centroid
    return final.join(F.broadcast(facts), F.col("cluster") == F.col("c")).select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """Rounds unrolled; dot products of integers are exact in doubles."""
    parts = [f"""
v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor({SCALE} * x)) AS v FROM embeddings
    WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
    SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS cluster, v AS c FROM (
        SELECT v, sha256('2:' || vec_id::VARCHAR) AS h FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {CLUSTERS}))"""]
    for i in range(ROUNDS + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (
    SELECT r, min({{'d': d, 'cluster': cluster}}) AS m FROM (
        SELECT r, cluster, (list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c))::BIGINT AS d FROM v, c{i}) GROUP BY r)""")
        if i < ROUNDS:
            parts.append(f"""
c{i + 1} AS MATERIALIZED (
    SELECT cluster, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
        SELECT cluster, list(x ORDER BY i) AS c FROM (
            SELECT cluster, i, floor(sum(x) / count(*)) AS x FROM (
                SELECT m.cluster AS cluster, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM v JOIN a{i} USING (r)) GROUP BY cluster, i)
        GROUP BY cluster) m USING (cluster))""")
    return "WITH " + ",".join(parts) + f"""
SELECT v.vec_id, m.cluster AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.cluster))::BIGINT AS cluster_inertia,
    (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM v JOIN a{ROUNDS} USING (r) JOIN c{ROUNDS} ON c{ROUNDS}.cluster = m.cluster
"""


SQL = _sql()
