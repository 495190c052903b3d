"""Edge semantics on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.functions import text as X
from tilewright.functions.truthy import truthy_coalesce
from tilewright.operators import boxes as B
from tilewright.operators import manifest as M
from tilewright.operators import match as T
from tilewright.operators import quality as Q
from tilewright.operators import sampling as S
from tilewright.operators import themes as H


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_half_even(spark):
    assert one(spark, *[G.half_even(F.lit(v)) for v in (0.5, 1.5, 2.5, -0.5)]) == [0, 2, 2, 0]


def test_strict_side_limit(spark):
    df = spark.createDataFrame([(0.0, 0.0, 200.0, 300.0), (0.0, 0.0, 200.5, 300.0), (0.0, 0.0, 0.0, 5.0)], "x1 double, y1 double, x2 double, y2 double")
    assert [r.x2 for r in B.large_boxes(df, 200).collect()] == [200.5]
    assert B.large_boxes(df, 0).count() == 2


def test_inverted_box_areas(spark):
    box = [F.lit(v) for v in (10.0, 10.0, 4.0, 5.0)]
    assert one(spark, G.clamped_area(*box), G.product_clamped_area(*box)) == [0.0, 30.0]


def test_null_score_is_kept(spark):
    df = spark.createDataFrame([(True, None, [1.0]), (True, 0.4, [1.0]), (None, 0.9, [1.0]), (True, 0.5, [])], "found boolean, score double, bbox array<double>")
    assert [r.skip_reason for r in B.detection_status(df, 0.5).collect()] == [None, "low_score", "not_found", "missing_bbox"]


def test_zero_score_falls_through(spark):
    assert one(spark, truthy_coalesce("double", F.lit(0.0), F.lit(0.7)), truthy_coalesce("string", F.lit(""), F.lit(None).cast("string"), F.lit("x"))) == [0.7, "x"]


def test_position_out_of_range(spark):
    refs = spark.createDataFrame([("s", 0), ("s", 1), ("s", 3)], "id string, bbox_index int").select(
        "*", *[F.lit(None).cast(t).alias(c) for c, t in (("object", "string"), ("detected_label", "string"), ("detection_score", "double"),
               ("source_bbox", "array<double>"), ("output_image", "string"), ("seed", "bigint"), ("model_id", "string"))])
    meta = spark.createDataFrame([("s", [("cup", "a cup", 0.5, [0.0], [0.0]), ("jar", "a jar", 0.6, [0.0], [0.0])])],
                                 "id string, objects array<struct<object:string,label:string,score:double,bbox:array<double>,bbox_norm:array<double>>>")
    got = {r.bbox_index: r.object for r in M.matched_references(refs, M.exploded_boxes(meta)).collect()}
    assert got == {0: None, 1: "cup", 3: None}


def test_reference_index_from_stem(spark):
    df = spark.createDataFrame([(None, "bbox7"), (2, "bbox9"), (None, "boxes")], "bbox_index int, stem string")
    assert [r.bbox_index for r in M.reference_index(df).collect()] == [7, 2, None]


def match(spark, objects, dets):
    req = spark.createDataFrame([("s", i, o) for i, o in enumerate(objects)], "id string, object_no int, object string")
    det = spark.createDataFrame([("s", i, lab, sc) for i, (lab, sc) in enumerate(dets)], "id string, det_no int, label string, score double")
    return {r.object: (r.found, r.det_no) for r in T.match_labels(req, det, payload=()).collect()}


def test_label_containment(spark):
    assert match(spark, ["cup", "Tea  Cup"], [("a tea-cup", 0.5)]) == {"cup": (True, 0), "Tea  Cup": (True, 0)}
    assert match(spark, ["sofa"], [("a tea-cup", 0.5)]) == {"sofa": (False, None)}
    assert match(spark, ["big red cup"], [("an cup", 0.5)]) == {"big red cup": (True, 0)}


def test_empty_labels_match_everything(spark):
    assert match(spark, [""], [("a cup", 0.2), ("a jar", 0.9)]) == {"": (True, 1)}
    assert match(spark, ["cup", "jar"], [("", 0.3), ("jar", 0.4)]) == {"cup": (True, 0), "jar": (True, 1)}


def test_first_detection_wins_ties(spark):
    assert match(spark, ["cup"], [("cup", 0.5), ("red cup", 0.5), ("jar", 0.9)]) == {"cup": (True, 0)}


def test_reply_without_caption(spark):
    assert one(spark, *X.parse_reply(F.lit("QUALITY: bad"))) == ["BAD", None, None]
    assert one(spark, *X.parse_reply(F.lit("quality: Good\nREASON: sharp \nCAPTION: a\nb "))) == ["GOOD", "sharp", "a b"]


def test_word_trim(spark):
    words = lambda n: F.lit(" ".join(["w"] * n))
    short, long = one(spark, X.finish_caption(words(115), 100), X.finish_caption(words(116), 100))
    assert len(short.split()) == 115 and len(long.split()) == 100 and long.endswith("w.")


def test_quotes(spark):
    assert one(spark, X.strip_one_quote(F.lit("\"\"a''")), X.strip_quotes(F.lit("\"\"a''"))) == ["\"a'", "a"]


def test_flat_depth(spark):
    df = spark.createDataFrame([("m", 3.0), ("m", 3.0)], "k string, d double")
    for rule in ("minmax", "percentile"):
        assert {r.depth_u16 for r in Q.depth_scaled(df, "k", "d", rule).collect()} == {0}


def test_seeds(spark):
    assert one(spark, X.seed_from_digits(F.lit("sample_0000008"), 42), X.seed_from_digits(F.lit("none"), 42), X.seed_from_codes(F.lit("ab"), 1)) == [50, 42, 196]


def test_shard_ranges(spark):
    df = spark.range(7).withColumnRenamed("id", "row_index")
    got = M.shard_bounds(M.range_shards(df, 3)).orderBy("shard").collect()
    assert [(r.start, r.end) for r in got] == [(0, 3), (3, 5), (5, 7)]


def test_shard_id_outside_range(spark):
    with pytest.raises(ValueError):
        M.modulo_shard(spark.range(3).withColumnRenamed("id", "row_index"), 6, 6)


def test_allocation():
    assert S.allocate(5, {2: 0.5, 3: 0.5}) == {2: 3, 3: 2}
    assert S.even_counts(7, 3) == [3, 2, 2]
    assert S.parse_weights("2:1,3:3") == {2: 0.25, 3: 0.75}
    with pytest.raises(ValueError):
        S.parse_weights("1:1")


def test_product_index(spark):
    pool = F.array(*[F.lit(c) for c in "abc"])
    assert one(spark, *[F.element_at(pool, H.product_digit(F.lit(4), 3, j) + 1) for j in range(2)]) == ["b", "b"]


def test_unranking_matches_itertools(spark):
    import itertools

    pool, total = list("abcd"), 24
    df = spark.range(total).select(H.unranked(F.col("id"), F.array(*[F.lit(c) for c in pool]), H.place_weights(4, 3), 3).alias("p"))
    assert [tuple(r.p) for r in df.collect()] == list(itertools.permutations(pool, 3))


def test_bin_edges(spark):
    rows = [(0.0, 0.0, s, 999.0) for s in (-1.0, -0.5, 50.0, 50.01, 401.0)]
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double")
    got = {r.bin: r.n for r in B.side_histogram(df).collect()}
    assert got["<=0"] == 1 and got["(0,50]"] == 1 and got["(50,100]"] == 1 and got[">400"] == 1 and got["(300,400]"] == 0


def test_bad_sample(spark):
    df = spark.createDataFrame([(["outputs/landmark/a", "outputs/landmark/b"],), (["outputs/landmark/a", "x/outputs"],)], "reference_images array<string>")
    assert [(r.is_bad, r.categories) for r in Q.landmark_status(df).collect()] == [(True, ["landmark"] * 2), (False, ["landmark", "unknown"])]


def test_exact_percentiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double")
    got = {r.p: r.value for r in B.exact_percentiles(df, F.col("v"), [0.05, 0.5, 1.0]).collect()}
    assert got == pytest.approx({0.05: 1.1, 0.5: 2.0, 1.0: 4.0})


def test_missing_landscape_is_an_error(spark):
    df = spark.createDataFrame([("a", "object")], "id string, category string")
    with pytest.raises(Exception, match="no usable"):
        Q.require_category(df).collect()


def test_view_prompts(spark):
    df = spark.range(20000).select(S.view_prompt(1, F.col("id")).alias("p"))
    names = {r.p for r in df.distinct().collect()}
    assert len(names) == 95 and "<sks> front view eye-level shot medium shot" not in names


def test_small_image_layouts(spark):
    assert one(spark, *G.letterbox_layout(F.lit(0), F.lit(5))) == [None] * 5
    assert one(spark, *G.letterbox_layout(F.lit(1), F.lit(4000)))[3:] == [1, 1080]


def test_ratio_test_on_planted_copy(spark):
    import random

    rnd = random.Random(3)
    refs = [(7, i, [rnd.random() for _ in range(8)]) for i in range(300)]
    queries = [(7, 1000, [x + 1e-4 for x in refs[42][2]]), (7, 1001, [rnd.random() for _ in range(8)])]
    schema = "pair_id int, vec_id int, vec array<double>"
    near = T.two_nearest(spark.createDataFrame(queries, schema), spark.createDataFrame(refs, schema), tile=64)
    got = T.ratio_matches(near, 0.1).collect()
    assert [(r.query_id, r.ref_id) for r in got] == [(1000, 42)]


def test_two_nearest_agrees_with_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    q, r = rng.normal(size=(90, 5)), rng.normal(size=(110, 5))
    schema = "pair_id int, vec_id int, vec array<double>"
    mk = lambda m: spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(m)], schema)
    got = {x.query_id: (x.ref_id, x.d1, x.d2) for x in T.two_nearest(mk(q), mk(r), tile=32).collect()}
    d = np.sqrt(((q[:, None] - r[None]) ** 2).sum(2))
    for i in range(90):
        o = np.argsort(d[i])
        assert got[i][0] == o[0] and got[i][1:] == pytest.approx((d[i][o[0]], d[i][o[1]]))


def test_similarity_matches_singular_values(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = []
    for pair in range(20):
        s, d = rng.normal(size=(7, 2)), rng.normal(size=(7, 2))
        rows += [(pair, i, *map(float, (*s[i], *d[i]))) for i in range(7)]
    df = spark.createDataFrame(rows, "pair_id int, point_no int, sx double, sy double, dx double, dy double")
    for r in T.similarity_fit(df).collect():
        m = np.array([x[2:] for x in rows if x[0] == r.pair_id])
        s, d = m[:, :2] - m[:, :2].mean(0), m[:, 2:] - m[:, 2:].mean(0)
        u, w, vt = np.linalg.svd(d.T @ s / 7)
        if np.linalg.det(u) * np.linalg.det(vt) < 0:
            u[:, -1] *= -1
            w[-1] *= -1
        rot = u @ vt
        assert r.scale == pytest.approx(w.sum() / ((s**2).sum() / 7))
        assert r.rotation_deg == pytest.approx(np.degrees(np.arctan2(rot[1, 0], rot[0, 0])))


def test_locked_rotation_reasons(spark):
    import math

    good = [(1, i, float(i), float(i * i % 7), 2 * float(i), 2 * float(i * i % 7)) for i in range(20)]
    few = [(2, i, float(i), 0.0, 0.0, 0.0) for i in range(2)]
    df = spark.createDataFrame(good + few, "pair_id int, point_no int, sx double, sy double, dx double, dy double")
    sc = spark.createDataFrame([(1, 2.0), (2, 1.0), (3, 1.0)], "pair_id int, expected_scale double")
    got = {r.pair_id: r for r in T.locked_rotation(df, sc, limit=0.5).collect()}
    assert got[1].accepted and got[1].num_inliers == 20 and math.isclose(got[1].rotation_deg, 0, abs_tol=1e-6)
    assert got[2].reject_reason == got[3].reject_reason == "insufficient_matches"
    off = spark.createDataFrame([(1, 1.3)], "pair_id int, expected_scale double")
    r = T.locked_rotation(df, off, limit=50.0, min_inliers=5).first()
    assert r.reject_reason == "scale_mismatch" and not r.accepted
    assert {x.pair_id: x.method for x in T.estimated_transform(df, limit=0.5).collect()} == {1: "similarity", 2: "insufficient_matches"}


def test_percentiles_of_any_scale(spark):
    import numpy as np

    values = np.random.default_rng(3).random(20_000) ** 4 * 1e-3
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(values)] + [(0, None)], "k int, v double")
    probs = [0.0, 0.02, 0.5, 0.98, 1.0]
    for keys, parts in (([], {None: values}), (["k"], {0: values[::2], 1: values[1::2]})):
        got = {(r["k"] if keys else None, r.p): r.value for r in B.exact_percentiles(df, F.col("v"), probs, keys).collect()}
        for k, part in parts.items():
            assert np.allclose([got[k, p] for p in probs], np.quantile(part, probs), rtol=1e-12, atol=0)
    assert B.exact_percentiles(df.where("k > 5"), F.col("v"), probs).count() == 0
