"""Label matching, descriptor matching and planar transforms between point sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tilewright import constants as K
from tilewright.functions import text as X
from tilewright.functions.draws import draw_digest, int_div
from tilewright.operators.ranking import HOT_ROWS, digest_band, first_per_key, hot_keys, ordinal

_POINT = ("sx", "sy", "dx", "dy")

# ------------------------------------------------------------------ label match


def _substrings(text: Column, lengths: Column) -> Column:
    """Distinct substrings of ``text`` whose length is in ``lengths``."""
    fitting = F.filter(lengths, lambda n: (n > 0) & (n <= F.length(text)))
    cuts = F.transform(
        fitting,
        lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)),
    )
    return F.array_distinct(F.flatten(cuts))


def containment_pairs(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """Distinct (left, right) label pairs where one contains the other, by equi-joins only.

    Both inputs are vocabularies of distinct non-empty labels. The longer label
    is unfolded into its substrings of the lengths that occur on the other side,
    so no label meets a label it does not match.
    """
    def one_way(inner: DataFrame, inner_col: str, outer: DataFrame, outer_col: str) -> DataFrame:
        lengths = inner.agg(F.collect_set(F.length(inner_col))).scalar()  # at most one entry per length
        sized = outer.select(outer_col, lengths.alias("__lengths"))
        cut = sized.select(outer_col, F.explode(_substrings(F.col(outer_col), F.col("__lengths"))).alias(inner_col))
        return cut.join(inner, inner_col).select(left_col, right_col)

    return (
        one_way(left, left_col, right, right_col)
        .union(one_way(right, right_col, left, left_col))
        .distinct()
    )


#: Detections of a sample up to which its requests look through a list of them.
SAMPLE_ROWS = 1_000


def match_labels(
    requested: DataFrame, detections: DataFrame, key: str = "id", payload: tuple[str, ...] = ("x1", "y1", "x2", "y2"), sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Best detection for every requested object; unmatched objects stay with ``found`` false.

    ``requested`` is (key, object_no, object), ``detections`` is (key, det_no,
    label, score, payload…). Labels match when, normalised, one contains the
    other; the highest score wins, the first detection on ties. The detections of a
    sample are gathered into one list that its requests look through; samples of more than
    ``sample_rows`` detections are paired through the label vocabulary instead.
    """
    req = requested.withColumn("__o", X.normalize_label(F.col("object")))
    cand = F.struct(
        F.col("score").alias("score"), (-F.col("det_no")).alias("neg_no"), F.col("label").alias("label"),
        *[F.col(p) for p in payload],
    )
    seen = detections.select(key, X.normalize_label(F.col("label")).alias("__d"), cand.alias("c"))
    # At most one key per ``sample_rows`` detections; mostly none, and then the second branch is dropped unread.
    large = F.broadcast(
        detections.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where((F.col("__n") > sample_rows) & F.col(key).isNotNull()).select(key))
    few, many = ((req.join(large, key, how), seen.join(large, key, how)) for how in ("left_anti", "left_semi"))
    matched = _matched_in_sample(*few, key).unionByName(_matched_by_vocabulary(*many, key))
    return matched.select(
        key, "object_no", "object", F.col("c").isNotNull().alias("found"),
        F.col("c.label").alias("label"), F.col("c.score").alias("score"),
        (-F.col("c.neg_no")).alias("det_no"), *[F.col(f"c.{p}").alias(p) for p in payload],
    )


def _matched_in_sample(req: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Requests with their best candidate ``c``, found in the list of the sample's detections."""
    lists = seen.groupBy(key).agg(F.collect_list(F.struct("__d", "c")).alias("__seen"))
    o = F.col("__o")
    # An empty label is contained in any request, an empty request in any label, even a null one.
    fits = F.filter("__seen", lambda e: (o == "") | F.contains(e["__d"], o) | F.contains(o, e["__d"]))
    best = F.array_max(F.transform(fits, lambda e: e["c"]))
    return req.join(lists, key, "left").select(*req.columns, best.alias("c"))


def _matched_by_vocabulary(req: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """The same for large samples.

    Only the best detection of each distinct label is kept before anything is paired, and pairing goes through the
    label vocabulary, so a sample with very many boxes of one class costs no more than its number of classes.
    """
    best = seen.groupBy(key, "__d").agg(F.max("c").alias("c"))
    wanted = req.select(key, "__o").distinct()
    pairs = containment_pairs(
        wanted.select("__o").where(F.col("__o") != "").distinct(),
        best.select("__d").where(F.col("__d") != "").distinct(), "__o", "__d",
    )
    # Each direction is expanded from its longer text, which contains a bounded number of shorter ones.
    in_label = F.length("__o") <= F.length("__d")
    by_label = best.join(pairs.where(in_label), "__d").select(key, "__o", "c")
    by_request = wanted.join(pairs.where(~in_label), "__o").join(best, [key, "__d"]).select(key, "__o", "c")
    # An empty label matches whatever its own sample asks for, an empty request every label of its sample.
    by_blank = best.where(F.col("__d") == "").select(key, "c").join(wanted, key).select(key, "__o", "c")
    any_label = best.groupBy(key).agg(F.max("c").alias("c"))
    by_any = wanted.where(F.col("__o") == "").join(any_label, key).select(key, "__o", "c")
    winner = (
        by_label.unionByName(by_request).unionByName(by_blank).unionByName(by_any)
        .groupBy(key, "__o").agg(F.max("c").alias("c"))
    )
    return req.join(winner, [key, "__o"], "left").select(*req.columns, "c")


# ------------------------------------------------------------- descriptor match

TILE = 2048


def _nearest_two(q: np.ndarray, r: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and distances of the two nearest rows of ``r`` for every row of ``q``."""
    keep = min(2, len(r))
    if metric == "hamming":
        order, dist = [], []
        for row in q:
            d = np.bitwise_count(np.bitwise_xor(r, row)).sum(axis=1).astype(np.float64)
            top = np.lexsort((np.arange(len(r)), d))[:keep]
            order.append(top)
            dist.append(d[top])
        return np.array(order), np.array(dist)
    rough = (q * q).sum(1)[:, None] - 2.0 * (q @ r.T) + (r * r).sum(1)[None, :]
    # Every row within the product form's rounding of the ``keep``-th is re-measured exactly, however many there are.
    slack = 1e-10 * ((q * q).sum(1) + (r * r).sum(1).max())
    bound = np.partition(rough, keep - 1, axis=1)[:, keep - 1] + slack
    row, near = np.nonzero(rough <= bound[:, None])
    exact = np.sqrt(((q[row] - r[near]) ** 2).sum(axis=1))
    order = np.lexsort((near, exact, row))
    first = np.searchsorted(row, np.arange(len(q)))
    top = order[first[:, None] + np.arange(keep)]
    return near[top], exact[top]


def _tile_matcher(metric: str):
    def match(key, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        cols = ["pair_id", "query_id", "ref_id", "dist"]
        if q.empty or r.empty:
            return pd.DataFrame({c: [] for c in cols})
        r = r.sort_values("vec_id")
        if metric == "hamming":
            to = lambda s: np.stack([np.frombuffer(b, dtype=np.uint8) for b in s])
        else:
            to = lambda s: np.stack(s.to_numpy()).astype(np.float64)
        at, dist = _nearest_two(to(q["vec"]), to(r["vec"]), metric)
        ids = r["vec_id"].to_numpy()
        k = at.shape[1]
        return pd.DataFrame({
            "pair_id": np.repeat(q["pair_id"].to_numpy(), k), "query_id": np.repeat(q["vec_id"].to_numpy(), k),
            "ref_id": ids[at].ravel(), "dist": dist.ravel(),
        })

    return match


def two_nearest(queries: DataFrame, refs: DataFrame, metric: str = "l2", tile: int = TILE) -> DataFrame:
    """Nearest and second nearest reference per query inside each pair: (pair_id, query_id, ref_id, d1, d2).

    Inputs are (pair_id, vec_id, vec). A pair is cut into tiles of about
    ``tile`` x ``tile`` vectors, sized from aggregated counts, so one big pair
    spreads over many tasks; a tile returns two rows per query, never all pairs.
    """
    n_q = queries.groupBy("pair_id").agg(F.count(F.lit(1)).alias("nq"))
    n_r = refs.groupBy("pair_id").agg(F.count(F.lit(1)).alias("nr"))
    grid = n_q.join(n_r, "pair_id").select(
        "pair_id", F.ceil(F.col("nq") / tile).cast("int").alias("tq"), F.ceil(F.col("nr") / tile).cast("int").alias("tr")
    )
    side = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.join(grid, "pair_id").select("pair_id", "vec_id", "vec", side("tq").alias("qt"), every("tr").alias("rt"))
    r = refs.join(grid, "pair_id").select("pair_id", "vec_id", "vec", side("tr").alias("rt"), every("tq").alias("qt"))
    # Both sides may come from one table; new names keep their columns apart.
    q, r = q.toDF("pair_id", "vec_id", "vec", "qt", "rt"), r.toDF("r_pair", "vec_id", "vec", "r_rt", "r_qt")
    id_type = dict(queries.dtypes)
    schema = (
        f"pair_id {id_type['pair_id']}, query_id {id_type['vec_id']}, "
        f"ref_id {dict(refs.dtypes)['vec_id']}, dist double"
    )
    tiles = q.groupBy("pair_id", "qt", "rt").cogroup(r.groupBy("r_pair", "r_qt", "r_rt")).applyInPandas(
        _tile_matcher(metric), schema
    )
    top = first_per_key(tiles, ["pair_id", "query_id"], [F.asc("dist"), F.asc("ref_id")], 2, "rk")
    first, second = F.col("rk") == 1, F.col("rk") == 2
    return top.groupBy("pair_id", "query_id").agg(
        F.max(F.when(first, F.col("ref_id"))).alias("ref_id"),
        F.max(F.when(first, F.col("dist"))).alias("d1"), F.max(F.when(second, F.col("dist"))).alias("d2"),
    )


def ratio_matches(nearest: DataFrame, ratio: float = K.RATIO_LIMIT, best: int = K.MAX_MATCHES) -> DataFrame:
    """Queries whose nearest is clearly nearer than the second; the ``best`` nearest per pair."""
    passed = nearest.where(F.col("d2").isNotNull() & (F.col("d1") < ratio * F.col("d2")))
    return first_per_key(passed, ["pair_id"], [F.asc("d1"), F.asc("query_id")], best, "match_rank")


# ---------------------------------------------------------------- point matches

def match_coverage(points: DataFrame, frames: DataFrame, key: str = "pair_id") -> DataFrame:
    """Bounding-box area of the matched target points over the canvas area; 0 without points.

    ``frames`` is (key, width, height).
    """
    box = points.groupBy(key).agg(
        (F.max("dx") - F.min("dx")).alias("w"), (F.max("dy") - F.min("dy")).alias("h")
    )
    area = F.greatest(F.lit(0.0), F.col("w")) * F.greatest(F.lit(0.0), F.col("h"))
    return frames.join(box, key, "left").select(
        key, F.coalesce(area / (F.col("width") * F.col("height")).cast("double"), F.lit(0.0)).alias("coverage")
    )


def centre_span(points: DataFrame, key: str = "pair_id") -> DataFrame:
    """Scale and shift from centres and spans."""
    span = lambda x, y: F.greatest(F.max(x) - F.min(x), F.max(y) - F.min(y), F.lit(1.0))
    g = points.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg("sx").alias("msx"), F.avg("sy").alias("msy"), F.avg("dx").alias("mdx"),
        F.avg("dy").alias("mdy"), span("sx", "sy").alias("src_span"), span("dx", "dy").alias("dst_span"),
    )
    scale = F.col("dst_span") / F.col("src_span")
    return g.select(
        key, "n", scale.alias("scale"),
        (F.col("mdx") - scale * F.col("msx")).alias("tx"), (F.col("mdy") - scale * F.col("msy")).alias("ty"),
    )


def _similarity_aggs() -> list[Column]:
    """One-pass, mergeable moments of a point match (all numerically centred)."""
    return [
        F.count(F.lit(1)).alias("n"),
        (F.covar_pop("sx", "dx") + F.covar_pop("sy", "dy")).alias("p"),
        (F.covar_pop("sx", "dy") - F.covar_pop("sy", "dx")).alias("q"),
        (F.var_pop("sx") + F.var_pop("sy")).alias("v"),
        F.avg("sx").alias("msx"), F.avg("sy").alias("msy"), F.avg("dx").alias("mdx"), F.avg("dy").alias("mdy"),
    ]


def _free_scale() -> Column:
    scale = F.hypot("p", "q") / F.col("v")
    return F.when((F.col("n") >= 2) & (F.col("v") >= 1e-12) & (scale >= 1e-8), scale)


def _rotation() -> Column:
    return F.degrees(F.atan2("q", "p"))


def similarity_fit(points: DataFrame, key: str = "pair_id") -> DataFrame:
    """Least-squares scale and rotation per pair; null for fewer than two points or no spread.

    Closed form on mergeable moments, hence one aggregate with map-side combine.
    """
    g = points.groupBy(key).agg(*_similarity_aggs())
    scale = _free_scale()
    return g.select(key, "n", scale.alias("scale"), F.when(scale.isNotNull(), _rotation()).alias("rotation_deg"))


def rotation_fit(points: DataFrame, scale: Column, key: str = "pair_id") -> DataFrame:
    """Rotation at a fixed positive scale (the angle itself does not depend on it)."""
    g = points.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *_similarity_aggs()[1:3])
    return g.select(key, "n", F.when((F.col("n") >= 2) & (scale > 0), _rotation()).alias("rotation_deg"))


@F.pandas_udf(ArrayType(IntegerType()))
def _inlier_counts(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """Inliers of every hypothesis on one block of points."""
    for batch in it:
        out = []
        for sx, sy, dx, dy, a, b, tx, ty, limit in zip(*batch):
            src = np.stack([sx, sy, np.ones(len(sx))])
            ex = np.stack([a, b, tx], axis=1) @ src - np.asarray(dx)
            ey = np.stack([-np.asarray(b), a, ty], axis=1) @ src - np.asarray(dy)
            out.append(np.count_nonzero(ex * ex + ey * ey <= limit * limit, axis=1).astype(np.int32))
        yield pd.Series(out)


def _model_columns(scale: Column) -> list[Column]:
    theta = F.radians(_rotation())
    a, b = scale * F.cos(theta), -scale * F.sin(theta)
    return [
        a.alias("a"), b.alias("b"), (F.col("mdx") - (a * F.col("msx") + b * F.col("msy"))).alias("tx"),
        (F.col("mdy") - (a * F.col("msy") - b * F.col("msx"))).alias("ty"),
    ]


def _draw_prefix(seed: int, key: Column) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), F.lit("hyp"), key.cast("string"))


def _distinct_indexes(draws: Sequence, n, below, larger) -> tuple:
    """Three distinct indexes below ``n`` from three draws without rejection: each draw skips the ones before it."""
    i0, r1, r2 = draws[0] % n, draws[1] % (n - 1), draws[2] % (n - 2)
    i1 = r1 + below(r1, i0)
    lo, hi = larger(i0, i1)
    step = r2 + below(r2, lo)
    return i0, i1, step + below(step, hi)


def _three_point_models(src: np.ndarray, dst: np.ndarray, scale: float | None) -> np.ndarray:
    """(a, b, tx, ty) of every hypothesis from corners (2, hypotheses, 3); NaN without a free scale."""
    ms, md = src.mean(axis=2), dst.mean(axis=2)
    cs, cd = src - ms[..., None], dst - md[..., None]
    p = (cs[0] * cd[0] + cs[1] * cd[1]).mean(axis=1)
    q = (cs[0] * cd[1] - cs[1] * cd[0]).mean(axis=1)
    if scale is None:
        v = (cs * cs).mean(axis=2).sum(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.hypot(p, q) / v
        scale = np.where((v >= 1e-12) & (scale >= 1e-8), scale, np.nan)
    theta = np.arctan2(q, p)
    a, b = scale * np.cos(theta), -scale * np.sin(theta)
    return np.stack([a, b, md[0] - (a * ms[0] + b * ms[1]), md[1] - (a * ms[1] - b * ms[0])])


def _inside(models: np.ndarray, pts: np.ndarray, limit: float) -> np.ndarray:
    """Which points (sx, sy, dx, dy) each model (a, b, tx, ty) hits."""
    a, b, tx, ty = models
    src = np.stack([pts[0], pts[1], np.ones(pts.shape[1])])
    ex = np.stack([a, b, tx], axis=1) @ src - pts[2]
    ey = np.stack([-b, a, ty], axis=1) @ src - pts[3]
    ex *= ex
    ey *= ey
    ex += ey
    return ex <= limit * limit


def _best_model(models: np.ndarray, pts: np.ndarray, limit: float, width: int = 64, height: int = 512) -> int:
    """Number of the model with the most inliers, the smallest of equals.

    All models see the first points; the leader of these is counted in full. The others go on, over the points that
    the leader misses first, only while they can still beat it. Blocks keep the distances in the processor's cache.
    """
    n = pts.shape[1]

    def hits(which: np.ndarray, block: np.ndarray) -> np.ndarray:
        return np.concatenate([
            np.count_nonzero(_inside(models[:, which[i:i + height]], block, limit), axis=1) for i in range(0, len(which), height)])

    alive = np.arange(models.shape[1])
    counts = hits(alive, pts[:, :width])
    lead = int(alive[np.argmax(counts)])
    hit = np.concatenate([_inside(models[:, [lead]], pts[:, i:i + 8192], limit)[0] for i in range(0, n, 8192)])
    most, seen = np.count_nonzero(hit), min(width, n)
    rest = width + np.argsort(hit[width:], kind="stable")
    while True:
        bound = counts + (n - seen)
        keep = (bound > most) | ((bound == most) & (alive < lead))
        alive, counts = alive[keep], counts[keep]
        if not len(alive) or seen == n:
            break
        block = rest[seen - width:seen]
        counts = counts + hits(alive, pts[:, block])
        seen += len(block)
    return int(alive[np.argmax(counts)]) if len(alive) else lead


def _searched(seed: int, limit: float, hypotheses: int | None, key: str, schema: StructType):
    """The search of one pair's points in one task; same draws and result as the search in blocks."""
    def search(table: pa.Table) -> pa.Table:
        n = table.num_rows
        empty = pa.Table.from_pylist([], schema=arrow)
        if n < 3:
            return empty
        table = table.sort_by([(c, "ascending") for c in ("__digest", *_POINT)])
        pts = np.stack([table[c].to_numpy() for c in _POINT])
        tries = hypotheses or min(K.MAX_HYPOTHESES, max(K.MIN_HYPOTHESES, n * K.HYPOTHESES_PER_POINT))
        prefix = table["__prefix"][0].as_py().encode()
        digests = b"".join(hashlib.md5(b"%b|%d" % (prefix, i)).digest()[:12] for i in range(tries))
        draws = np.frombuffer(digests, ">u4").reshape(-1, 3).T.astype(np.int64)
        at = np.stack(_distinct_indexes(draws, n, lambda x, y: (x >= y).astype(np.int64), lambda x, y: (np.minimum(x, y), np.maximum(x, y))), axis=1)
        scale = table["expected_scale"][0].as_py() if "expected_scale" in table.column_names else None
        models = _three_point_models(pts[:2][:, at], pts[2:][:, at], scale)
        if scale is None:
            models = models[:, ~np.isnan(models[0])]
        if not models.shape[1]:
            return empty
        best = models[:, [_best_model(models, pts, limit)]]
        inliers = pts[:, np.concatenate([_inside(best, pts[:, i:i + 8192], limit)[0] for i in range(0, n, 8192)])]
        row = {key: table[key][0].as_py(), "num_inliers": inliers.shape[1], "hyp_rotation": float(np.degrees(np.arctan2(-best[1, 0], best[0, 0])))}
        if inliers.shape[1]:
            mean = inliers.mean(axis=1)
            sx, sy, dx, dy = inliers - mean[:, None]
            row |= {"n": inliers.shape[1], "p": float((sx * dx + sy * dy).mean()), "q": float((sx * dy - sy * dx).mean()),
                    "v": float((sx * sx + sy * sy).mean()), **{f"m{c}": float(m) for c, m in zip(_POINT, mean)}}
        return pa.Table.from_pylist([row], schema=arrow)

    arrow = to_arrow_schema(schema)
    return search


def consensus(
    points: DataFrame, scales: DataFrame | None, seed: int = 0, limit: float = K.INLIER_LIMIT_PX,
    hypotheses: int | None = None, key: str = "pair_id", block: int = 2048, hot_rows: int = HOT_ROWS, whole: int = 65_536,
) -> DataFrame:
    """Best of many three-point hypotheses per pair, with the moments of its inliers.

    ``points`` is (key, point_no, sx, sy, dx, dy). With ``scales`` (key,
    expected_scale) the scale is locked, otherwise it is free. Three distinct
    points per hypothesis are drawn by hash. A pair's points meet in one task, which
    draws, fits and scores in memory, so only points are shuffled. The largest
    pairs (above ``whole`` points) are searched in blocks spread over tasks.
    """
    pts = points.where(F.col(key).isNotNull()).select(key, "point_no", *[F.col(c).cast("double").alias(c) for c in _POINT])
    large = F.broadcast(hot_keys(points, [key], whole))  # a bounded list, mostly empty
    found = _consensus_in_blocks(pts.join(large, key), scales, seed, limit, hypotheses, key, block, hot_rows)
    single = pts.join(large, key, "left_anti").select(
        key, F.unhex(draw_digest(seed, "point", F.col(key), F.col("point_no"))).alias("__digest"), *_POINT, _draw_prefix(seed, F.col(key)).alias("__prefix"))
    if scales is not None:
        single = single.join(scales.where(F.col("expected_scale") > 0).select(key, F.col("expected_scale").cast("double").alias("expected_scale")), key)
    return single.groupBy(key).applyInArrow(_searched(seed, float(limit), hypotheses, key, found.schema), found.schema).unionByName(found)


def _consensus_in_blocks(
    points: DataFrame, scales: DataFrame | None, seed: int, limit: float, hypotheses: int | None, key: str, block: int, hot_rows: int,
) -> DataFrame:
    """:func:`consensus` of very large pairs: their points lie in blocks of bounded size.

    Corners are looked up in the blocks by equi-join, and every block is scored
    against the pair's hypotheses (at most 4,000); only counts are merged.
    """
    digest = draw_digest(seed, "point", F.col(key), F.col("point_no"))
    pts = ordinal(
        points.select(key, "point_no", *_POINT), [key], [digest.asc(), F.asc("point_no")],
        digest_band(digest), "pt", 0, hot_rows,
    )
    sizes = points.groupBy(key).agg(F.count(F.lit(1)).alias("n_points")).where(F.col("n_points") >= 3)
    if scales is not None:
        sizes = sizes.join(scales.where(F.col("expected_scale") > 0).select(key, "expected_scale"), key)
    tries = (
        F.lit(hypotheses) if hypotheses is not None
        else F.least(F.lit(K.MAX_HYPOTHESES), F.greatest(F.lit(K.MIN_HYPOTHESES), F.col("n_points") * K.HYPOTHESES_PER_POINT))
    ).cast("int")

    h = sizes.select("*", F.explode(F.sequence(F.lit(0), tries - 1)).alias("hyp"))
    drawn = F.md5(F.concat_ws("|", _draw_prefix(seed, F.col(key)), "hyp"))
    h = h.select("*", *[F.conv(F.substring(drawn, 8 * k + 1, 8), 16, 10).cast("long").alias(f"u{k}") for k in range(3)])
    at = _distinct_indexes([F.col(f"u{k}") for k in range(3)], F.col("n_points"), lambda x, y: (x >= y).cast("int"), lambda x, y: (F.least(x, y), F.greatest(x, y)))
    h = h.select("*", *[i.alias(f"i{k}") for k, i in enumerate(at)])
    # Points live in blocks of bounded size. Drawing, scoring and refitting all read
    # the same blocks, so Spark numbers and shuffles the points once.
    point = F.struct("pt", "sx", "sy", "dx", "dy")
    blocks = pts.groupBy(key, int_div(F.col("pt"), block).alias("blk")).agg(F.sort_array(F.collect_list(point)).alias("s"))
    keep = [key, "hyp"] + (["expected_scale"] if scales is not None else [])
    wish = F.struct(*keep[1:], (F.pmod("pt", F.lit(block)) + 1).cast("int").alias("pos"))
    wishes = (
        h.select(*keep, F.explode(F.array("i0", "i1", "i2")).alias("pt"))
        .groupBy(key, int_div(F.col("pt"), block).alias("blk")).agg(F.collect_list(wish).alias("w"))
    )
    corners = (
        wishes.join(blocks, [key, "blk"]).select(key, "s", F.explode("w").alias("w"))
        .select(key, *[F.col(f"w.{c}").alias(c) for c in keep[1:]], F.element_at("s", F.col("w.pos")).alias("p"))
        .select(*keep, "p.*")
    )
    fitted = corners.groupBy(*keep).agg(*_similarity_aggs())
    scale = F.col("expected_scale") if scales is not None else _free_scale()
    models = fitted.select(*keep, *_model_columns(scale)).where(F.col("a").isNotNull())

    model = F.struct("hyp", "a", "b", "tx", "ty")
    per_pair = models.groupBy(key).agg(F.sort_array(F.collect_list(model)).alias("m"))
    field = lambda arr, f: F.transform(arr, lambda e: e[f])
    scored = blocks.join(per_pair, key).select(
        key, F.col("m"),
        _inlier_counts(
            *[field(F.col("s"), f) for f in ("sx", "sy", "dx", "dy")],
            *[field(F.col("m"), f) for f in ("a", "b", "tx", "ty")], F.lit(float(limit)),
        ).alias("c"),
    )
    tally = (
        scored.select(key, F.posexplode(F.arrays_zip("m", "c")).alias("i", "z"))
        .groupBy(key, F.col("z.m.hyp").alias("hyp"))
        .agg(F.sum("z.c").alias("inliers"))
    )
    best = tally.groupBy(key).agg(F.max(F.struct("inliers", (-F.col("hyp")).alias("neg"))).alias("w"))
    best = best.select(key, (-F.col("w.neg")).cast("int").alias("hyp"), F.col("w.inliers").alias("num_inliers"))
    chosen = best.join(models.select(key, "hyp", "a", "b", "tx", "ty"), [key, "hyp"])

    j = blocks.join(chosen, key).select(key, "a", "b", "tx", "ty", F.inline("s"))
    ex = F.col("a") * F.col("sx") + F.col("b") * F.col("sy") + F.col("tx") - F.col("dx")
    ey = F.col("a") * F.col("sy") - F.col("b") * F.col("sx") + F.col("ty") - F.col("dy")
    refit = j.where(F.hypot(ex, ey) <= limit).groupBy(key).agg(*_similarity_aggs())
    return chosen.select(key, "num_inliers", F.degrees(F.atan2(-F.col("b"), F.col("a"))).alias("hyp_rotation")).join(
        refit, key, "left"
    )


def locked_rotation(
    points: DataFrame, scales: DataFrame, seed: int = 0, min_inliers: int = K.MIN_INLIERS,
    limit: float = K.INLIER_LIMIT_PX, scale_tol: float = K.SCALE_TOLERANCE, hypotheses: int | None = None,
    key: str = "pair_id", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rotation per pair at its expected scale, with accept flag and first reject reason."""
    c = consensus(points, scales, seed, limit, hypotheses, key, hot_rows=hot_rows).withColumn("free", _free_scale())
    n = points.groupBy(key).agg(F.count(F.lit(1)).alias("num_matches"))
    j = scales.select(key, "expected_scale").join(n, key, "left").join(c, key, "left")
    enough = (F.coalesce("num_matches", F.lit(0)) >= 3) & (F.col("expected_scale") > 0)
    rel = F.abs(F.col("free") / F.col("expected_scale") - 1.0)
    many = F.coalesce("num_inliers", F.lit(0)) >= min_inliers
    reason = (
        F.when(~enough, "insufficient_matches").when(~many, "few_inliers")
        .when(F.col("free").isNull(), "bad_scale").when(rel > scale_tol, "scale_mismatch")
    )
    gate = enough & many & F.col("free").isNotNull()
    out = j.withColumn("reject_reason", reason)
    ok = F.col("reject_reason").isNull()
    return out.select(
        key, F.coalesce("num_matches", F.lit(0)).alias("num_matches"),
        F.coalesce("num_inliers", F.lit(0)).cast("long").alias("num_inliers"),
        F.when(gate, F.col("free")).alias("match_scale"), F.when(gate, rel).alias("scale_rel_err"),
        F.when(ok, F.coalesce(_rotation(), F.col("hyp_rotation"))).otherwise(0.0).alias("rotation_deg"),
        ok.alias("accepted"), "reject_reason",
    )


def estimated_transform(
    points: DataFrame, min_inliers: int = K.MIN_INLIERS, limit: float = 5.0, seed: int = 0,
    hypotheses: int | None = None, key: str = "pair_id", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Similarity by consensus, else centre-and-span; fewer than four points give nothing."""
    c = consensus(points, None, seed, limit, hypotheses, key, hot_rows=hot_rows)
    sim = c.where(F.col("num_inliers") >= min_inliers).select(
        key, F.col("num_inliers").alias("si"), *[x.alias(f"s_{n}") for x, n in zip(_model_columns(_free_scale()), ["a", "b", "tx", "ty"])]
    ).where(F.col("s_a").isNotNull())
    span = centre_span(points, key)
    j = span.join(sim, key, "left")
    few, has = F.col("n") < 4, F.col("s_a").isNotNull()
    pick = lambda s, f: F.when(few, None).when(has, F.col(s)).otherwise(f)
    return j.select(
        key, F.when(few, "insufficient_matches").when(has, "similarity").otherwise("bbox_center_scale").alias("method"),
        F.when(few, F.lit(0)).when(has, F.col("si")).otherwise(F.col("n")).cast("long").alias("num_inliers"),
        pick("s_a", F.col("scale")).alias("a"), pick("s_b", F.lit(0.0)).alias("b"),
        pick("s_tx", F.col("tx")).alias("tx"), pick("s_ty", F.col("ty")).alias("ty"),
    )
