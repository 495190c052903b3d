"""Label matching, descriptor matching and planar transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import query
from tilewright.operators import match as T

# Requested objects: second word of the part names of an order. Detections: all its parts, by full name on even
# lines and by the first word on odd ones, so some requests are not found.
_REQ = "req AS (SELECT DISTINCT l_orderkey AS id, split_part(p_name, ' ', 2) AS object FROM lineitem JOIN part ON l_partkey = p_partkey)"
_DETS = """dets AS (SELECT l_orderkey AS id, l_partkey * 100000 + l_suppkey AS det_no,
  concat('A ', upper(CASE WHEN l_linenumber % 2 = 0 THEN p_name ELSE split_part(p_name, ' ', 1) END)) AS label, l_extendedprice / 100000 AS score FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _lines(spark, sf):
    l = V.table(spark, sf, "lineitem")
    return l.join(V.table(spark, sf, "part").select("p_partkey", "p_name"), F.expr("l_partkey = p_partkey"))


def requested(spark, sf):
    r = _lines(spark, sf).select(F.col("l_orderkey").alias("id"), F.split("p_name", " ")[1].alias("object")).distinct()
    return r.withColumn("object_no", F.lit(0))


def detected(spark, sf):
    name = F.when(F.col("l_linenumber") % 2 == 0, F.col("p_name")).otherwise(F.split("p_name", " ")[0])
    return _lines(spark, sf).select(F.col("l_orderkey").alias("id"), F.expr("l_partkey * 100000 + l_suppkey").alias("det_no"),
                    F.concat(F.lit("A "), F.upper(name)).alias("label"), (F.col("l_extendedprice") / 100000).alias("score"))


@query("matched_labels", f"""WITH {_REQ}, {_DETS}, m AS (SELECT r.id, r.object, max_by(d.label, (d.score, -d.det_no)) AS label, max_by(d.det_no, (d.score, -d.det_no)) AS det_no, max(d.score) AS score
  FROM req r LEFT JOIN dets d ON r.id = d.id AND (contains(lower(substr(d.label, 3)), r.object) OR contains(r.object, lower(substr(d.label, 3)))) GROUP BY 1, 2)
  SELECT id, object, det_no IS NOT NULL AS found, label, score, det_no FROM m""")
def matched_labels(spark, sf):
    m = T.match_labels(requested(spark, sf), detected(spark, sf), payload=())
    return m.select("id", "object", "found", "label", "score", "det_no")


@query("label_vocabulary", """WITH a AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS o FROM part), b AS (SELECT DISTINCT p_name AS d FROM part UNION SELECT 'ri' UNION SELECT 'o')
  SELECT o, d FROM a, b WHERE contains(o, d) OR contains(d, o)""")
def label_vocabulary(spark, sf):
    p = V.table(spark, sf, "part").select("p_name")
    a = p.select(F.split("p_name", " ")[1].alias("o")).distinct()
    b = p.select(F.col("p_name").alias("d")).union(p.select(F.lit("ri"))).union(p.select(F.lit("o"))).distinct()
    return T.containment_pairs(a, b, "o", "d")


# --------------------------------------------------------------- descriptors

_NN = """q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 0), r AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 1),
  d AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, list_distance(q.v, r.v) AS dist FROM q, r),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) AS rk FROM d),
  n AS (SELECT query_id, max(ref_id) FILTER (rk = 1) AS ref_id, max(dist) FILTER (rk = 1) AS d1, max(dist) FILTER (rk = 2) AS d2 FROM k WHERE rk <= 2 GROUP BY 1)"""


def _sides(spark, sf):
    e = V.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 10**12).alias("pair_id"), "vec_id", F.col("embedding").alias("vec"))
    return e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1")


@query("two_nearest", f"WITH {_NN} SELECT query_id, ref_id, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM n")
def two_nearest(spark, sf):
    return T.two_nearest(*_sides(spark, sf)).select("query_id", "ref_id", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"))


@query("ratio_matches", f"WITH {_NN} SELECT query_id, ref_id, round(d1, 6) AS d1 FROM n WHERE d1 < 0.95 * d2 ORDER BY n.d1, query_id LIMIT 50")
def ratio_matches(spark, sf):
    return T.ratio_matches(T.two_nearest(*_sides(spark, sf)), 0.95).select("query_id", "ref_id", F.round("d1", 6).alias("d1"))


_SIGN = "list_reduce(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), lambda a, b: a || b)"


@query("hamming_nearest", f"""WITH s AS (SELECT vec_id, label, md5({_SIGN}) AS h, {_SIGN} AS b FROM embeddings), q AS (SELECT * FROM s WHERE vec_id % 2 = 0), r AS (SELECT * FROM s WHERE vec_id % 2 = 1),
  d AS (SELECT q.label, q.vec_id AS query_id, r.vec_id AS ref_id, hamming(q.b, r.b)::DOUBLE AS dist FROM q JOIN r ON q.label = r.label),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) AS rk FROM d)
  SELECT query_id, max(ref_id) FILTER (rk = 1) AS ref_id, max(dist) FILTER (rk = 1) AS d1, max(dist) FILTER (rk = 2) AS d2 FROM k WHERE rk <= 2 GROUP BY 1""")
def hamming_nearest(spark, sf):
    """Binary descriptors (signs of the embedding) matched inside each label."""
    bits = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    body = F.unhex(F.concat(*[F.lpad(F.conv(F.substring(bits, 1 + 16 * i, 16), 2, 16), 4, "0") for i in range(4)]))
    e = V.table(spark, sf, "embeddings").select(F.col("label").alias("pair_id"), "vec_id", body.alias("vec"))
    return T.two_nearest(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "hamming").select("query_id", "ref_id", "d1", "d2")


# -------------------------------------------------------------------- keypoints

# Per supplier: source points, and the same points under the supplier's own scale and angle; heavy tax marks outliers.
_SC = "(0.5::DOUBLE + (l_suppkey % 10) / 10.0::DOUBLE)"
_AN = "radians(cast((l_suppkey * 7) % 90 as double))"
_SX, _SY = "l_quantity", "(l_linenumber * 10.0::DOUBLE)"
_DX = f"CASE WHEN l_tax > 0.07 THEN 900 + l_quantity * 37 % 400 ELSE {_SC} * (cos({_AN}) * {_SX} - sin({_AN}) * {_SY}) + 100 END"
_DY = f"CASE WHEN l_tax > 0.07 THEN 700 + l_quantity * 53 % 300 ELSE {_SC} * (sin({_AN}) * {_SX} + cos({_AN}) * {_SY}) + 50 END"
_KP = f"kp AS (SELECT l_suppkey AS pair_id, l_tax, {_SX} AS sx, {_SY} AS sy, {_DX} AS dx, {_DY} AS dy FROM lineitem)"


def keypoints(spark, sf):
    l = V.table(spark, sf, "lineitem")
    sc = F.lit(0.5) + (F.col("l_suppkey") % 10) / F.lit(10.0)
    an = F.radians(((F.col("l_suppkey") * 7) % 90).cast("double"))
    sx, sy = F.col("l_quantity"), F.col("l_linenumber") * F.lit(10.0)
    far = F.col("l_tax") > 0.07
    dx = F.when(far, 900 + F.col("l_quantity") * 37 % 400).otherwise(sc * (F.cos(an) * sx - F.sin(an) * sy) + 100)
    dy = F.when(far, 700 + F.col("l_quantity") * 53 % 300).otherwise(sc * (F.sin(an) * sx + F.cos(an) * sy) + 50)
    no = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    return l.select(F.col("l_suppkey").alias("pair_id"), no.alias("point_no"), "l_tax", sx.alias("sx"), sy.alias("sy"), dx.alias("dx"), dy.alias("dy"))


def scales(spark, sf):
    k = F.col("s_suppkey")
    return V.table(spark, sf, "supplier").select(k.alias("pair_id"), (F.lit(0.5) + (k % 10) / F.lit(10.0)).alias("expected_scale"))


@query("match_coverage", f"""WITH {_KP}, b AS (SELECT pair_id, greatest(0, max(dx) - min(dx)) * greatest(0, max(dy) - min(dy)) AS a FROM kp GROUP BY 1), f AS (SELECT s_suppkey AS k FROM supplier UNION ALL SELECT -s_suppkey FROM supplier)
  SELECT k AS pair_id, round(coalesce(a / (1920 * 1080)::DOUBLE, 0), 9) AS coverage FROM f LEFT JOIN b ON k = pair_id""")
def match_coverage(spark, sf):
    """All pairs; a second frame per supplier has no matches."""
    k = V.table(spark, sf, "supplier").select(F.explode(F.array("s_suppkey", -F.col("s_suppkey"))).alias("pair_id"))
    c = T.match_coverage(keypoints(spark, sf), k.select("pair_id", F.lit(1920).alias("width"), F.lit(1080).alias("height")))
    return c.select("pair_id", F.round("coverage", 9).alias("coverage"))


_SPAN = "greatest(max(dx) - min(dx), max(dy) - min(dy), 1.0::DOUBLE) / greatest(max(sx) - min(sx), max(sy) - min(sy), 1.0::DOUBLE)"


@query("centre_spans", f"""WITH {_KP} SELECT pair_id, round({_SPAN}, 6) AS scale, round(avg(dx) - {_SPAN} * avg(sx), 4) AS tx, round(avg(dy) - {_SPAN} * avg(sy), 4) AS ty FROM kp GROUP BY 1""")
def centre_spans(spark, sf):
    c = T.centre_span(keypoints(spark, sf))
    return c.select("pair_id", F.round("scale", 6).alias("scale"), F.round("tx", 4).alias("tx"), F.round("ty", 4).alias("ty"))


_FIT = """SELECT pair_id, count(*) AS n, sqrt(pow(covar_pop(sx, dx) + covar_pop(sy, dy), 2) + pow(covar_pop(sx, dy) - covar_pop(sy, dx), 2)) / (var_pop(sx) + var_pop(sy)) AS scale,
  degrees(atan2(covar_pop(sx, dy) - covar_pop(sy, dx), covar_pop(sx, dx) + covar_pop(sy, dy))) AS rotation_deg FROM kp{where} GROUP BY 1"""
_FIT_ALL, _FIT = _FIT.replace("{where}", ""), _FIT.replace("{where}", " WHERE l_tax <= 0.07")


@query("similarity_fits", f"WITH {_KP}, f AS ({_FIT_ALL}) SELECT pair_id, n, round(scale, 6) AS scale, round(rotation_deg, 5) AS rotation_deg FROM f")
def similarity_fits(spark, sf):
    s = T.similarity_fit(keypoints(spark, sf))
    return s.select("pair_id", "n", F.round("scale", 6).alias("scale"), F.round("rotation_deg", 5).alias("rotation_deg"))


@query("rotation_fits", f"WITH {_KP}, f AS ({_FIT_ALL}) SELECT pair_id, n, round(rotation_deg, 5) AS rotation_deg FROM f")
def rotation_fits(spark, sf):
    s = T.rotation_fit(keypoints(spark, sf), F.lit(1.5))
    return s.select("pair_id", "n", F.round("rotation_deg", 5).alias("rotation_deg"))


# The planted transform is the only one with many inliers, so the search must end on exactly the unspoilt points.
@query("locked_rotations", f"""WITH {_KP}, f AS ({_FIT}) SELECT f.pair_id, f.n AS num_inliers, (SELECT count(*) FROM kp k WHERE k.pair_id = f.pair_id) AS num_matches, round(f.rotation_deg, 5) AS rotation_deg,
  round(f.scale, 6) AS match_scale, true AS accepted FROM f""")
def locked_rotations(spark, sf):
    r = T.locked_rotation(keypoints(spark, sf), scales(spark, sf))
    return r.select("pair_id", "num_inliers", "num_matches", F.round("rotation_deg", 5).alias("rotation_deg"), F.round("match_scale", 6).alias("match_scale"), "accepted")


@query("scale_mismatches", """SELECT s_suppkey AS pair_id, 'few_inliers' AS reject_reason FROM supplier""")
def scale_mismatches(spark, sf):
    """A scale that is far off leaves too few inliers in every pair."""
    wrong = scales(spark, sf).withColumn("expected_scale", F.col("expected_scale") * 40)
    r = T.locked_rotation(keypoints(spark, sf), wrong, min_inliers=400, limit=1.0)
    return r.select("pair_id", "reject_reason")


@query("estimated_transforms", f"""WITH {_KP}, f AS ({_FIT}) SELECT pair_id, 'similarity' AS method, n AS num_inliers, round(scale * cos(radians(rotation_deg)), 5) AS a, round(-scale * sin(radians(rotation_deg)), 5) AS b FROM f""")
def estimated_transforms(spark, sf):
    t = T.estimated_transform(keypoints(spark, sf))
    return t.select("pair_id", "method", "num_inliers", F.round("a", 5).alias("a"), F.round("b", 5).alias("b"))
