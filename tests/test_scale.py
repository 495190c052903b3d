"""Skewed keys, partition independence and plan shapes."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tilewright import constants as K
from tilewright.functions import draws as D
from tilewright.operators import boxes as B
from tilewright.operators import manifest as M
from tilewright.operators import match as T
from tilewright.operators import sampling as S
from tilewright.operators import themes as H
from tilewright.operators.ranking import band_of, first_per_key, global_ordinal, hot_keys, ordinal, split_ordinal, split_points
from tilewright.operators.selection import double_cell, values_at_ranks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(spark):
    """One image holds a third of all boxes; some scores are missing."""
    rnd = random.Random(5)
    rows = []
    for i in range(3000):
        img = "hot.png" if i % 3 == 0 else f"i{i % 400}.png"
        x, y = rnd.random() * 900, rnd.random() * 500
        rows.append((img, "cup", rnd.random() if i % 50 else None, x, y, x + rnd.random() * 500, y + rnd.random() * 500, i))
    return spark.createDataFrame(rows, "image_path string, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double, n int").repartition(7)


def test_hot_keys_are_found(skewed):
    assert [r.image_path for r in hot_keys(skewed, ["image_path"], 100).collect()] == ["hot.png"]


@pytest.mark.parametrize("limit", [100, 10**9])
def test_crop_numbers_with_hot_image(skewed, limit):
    w = Window.partitionBy("image_path").orderBy(*B.box_order())
    big = (F.col("x2") - F.col("x1") > 200) & (F.col("y2") - F.col("y1") > 200)
    want = skewed.select("n", (F.row_number().over(w) - 1).alias("crop_no"), F.when(
        big, F.sum(big.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("mv"))
    got = B.crop_numbers(skewed, hot_rows=limit).select("n", "crop_no", F.col("mv_crop_no").alias("mv"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_z_order_with_hot_image(skewed):
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    got = B.z_order(skewed, area, "n", "image_path", hot_rows=50)
    w = Window.partitionBy("image_path").orderBy(F.desc("bbox_area"), "n")
    assert got.withColumn("want", F.row_number().over(w)).where("z_order <> want").count() == 0


def test_split_ordinal(skewed):
    got = split_ordinal(skewed, ["class_name"], [F.asc("n")], F.floor(F.col("n") / 64))
    assert got.where("ordinal <> n").count() == 0


def test_global_ordinal_two_levels(spark):
    df = spark.range(5000).select(F.floor(F.col("id") / 1000).alias("shard"), (F.col("id") % 1000).alias("row"), "id").repartition(9)
    got = global_ordinal(df, [F.asc("shard"), F.asc("row")], [F.col("shard"), F.floor(F.col("row") / 64)])
    assert got.where("ordinal <> id").count() == 0


def test_sampled_bands_do_not_change_numbers(spark):
    df = spark.range(4000).select(F.col("id"), F.pow(F.col("id"), 1.5).alias("v")).repartition(5)
    points = split_points(df, "v", 32)
    got = global_ordinal(df, [F.asc("v")], [band_of(F.col("v"), points)])
    assert len(points) > 16 and got.where("ordinal <> id").count() == 0


def test_one_list_per_image(skewed):
    lists = {r.image_path: [b.crop_no for b in r.boxes] for r in B.grouped_boxes(B.crop_numbers(skewed)).collect()}
    assert len(lists) == skewed.select("image_path").distinct().count()
    assert sum(map(len, lists.values())) == 3000 and all(x == list(range(len(x))) for x in lists.values())
    lost = B.missing_objects(skewed.select("image_path", F.col("n").alias("bbox_index"), F.col("n").alias("object"), (F.col("n") % 2 == 0).alias("found")), "image_path")
    hot = lost.where("image_path = 'hot.png'").collect()
    assert [r.missing for r in hot] == [list(range(3, 3000, 6))]


def artifacts(spark, ids):
    make = lambda **c: spark.createDataFrame([(i,) for i in ids], "id string").select("id", *[F.expr(e).alias(k) for k, e in c.items()])
    return (
        make(prompt="'p'", gt_image="'g'", objects="array('a')", object_details="array(struct('cup' AS name, 2 AS n))"),
        make(combined_prompt="'c'", metadata="'tp.json'"),
        make(bbox_information="array(struct(1 AS x))", metadata="'bb.json'"),
        make(image="'c'", metadata="'cm'", num_placements="1", placements="array(struct('q' AS slot))"),
        make(image="'d'", raw="'r'", metadata="'dm'"),
    )


def many_references(spark):
    """Sample ``big`` has 5,000 references numbered from 5,000 on, ``plain`` two and ``none`` none."""
    refs = spark.range(5002).select(
        F.when(F.col("id") < 5000, "big").otherwise("plain").alias("id"), (F.col("id") + 5000).cast("int").alias("bbox_index"),
        F.lit("").alias("object"), F.lit(None).cast("string").alias("detected_label"), F.lit(0.0).alias("detection_score"),
        F.array().cast("array<double>").alias("source_bbox"), F.lit("").alias("output_image"), F.lit(1).cast("bigint").alias("seed"),
        F.lit("m").alias("model_id"), F.format_string("ref%d.json", F.col("id")).alias("metadata"))
    boxes = spark.range(5003).select(
        F.lit("big").alias("id"), F.col("id").cast("int").alias("bbox_index"), F.lit("o").alias("object"), F.lit("l").alias("label"),
        F.lit(0.5).alias("score"), F.array(F.lit(1.0)).alias("bbox"), F.array(F.lit(0.1)).alias("bbox_norm"))
    return refs.repartition(5), boxes


def test_one_record_per_sample_of_any_size(spark):
    refs, boxes = many_references(spark)
    matched = M.matched_references(refs, boxes)
    tables = artifacts(spark, ["big", "plain", "none"])
    records = {r.id: r for r in M.assemble_manifest(*tables, matched).collect()}
    assert sorted(records) == ["big", "none", "plain"]
    big = records["big"].reference_images
    assert [x.bbox_index for x in big] == list(range(5000, 10000)) and records["big"].n_references == 5000
    assert (big[2].object, big[2].detected_label, big[2].source_bbox, big[2].metadata) == ("o", "l", [1.0], "ref2.json")
    assert (big[3].object, big[3].image) == (None, "bbox5003.jpg")
    none = records["none"]
    assert none.reference_images == [] and none.n_references == 0
    assert none.object_details[0].asDict() == {"name": "cup", "n": 2} and none.bbox_annotations[0].x == 1
    assert none.canvas.placements[0].slot == "q"
    assert none.source_files.asDict() == {"theme_prompt": "tp.json", "theme_metadata": None, "bbox_metadata": "bb.json"}
    assert sorted(r.id for r in M.assemble_manifest(*tables, matched, require_complete=True).collect()) == ["big", "plain"]
    flat = M.assemble_manifest(*tables, matched, nested=False)
    assert "reference_images" not in flat.columns
    assert {r.id: r.n_references for r in flat.collect()} == {"big": 5000, "plain": 2, "none": 0}


def test_complete_records_need_every_path(spark):
    refs, boxes = many_references(spark)
    t = list(artifacts(spark, ["big"]))
    matched = M.matched_references(refs, boxes)
    for at, column, complete_only in ((0, "gt_image", False), (4, "image", False), (4, "raw", True), (3, "metadata", True)):
        lacking = [*t]
        lacking[at] = t[at].withColumn(column, F.lit(None).cast("string"))
        assert M.assemble_manifest(*lacking, matched, require_complete=True).count() == 0
        assert M.assemble_manifest(*lacking, matched).count() == complete_only


def test_bucketed_manifest_has_no_exchange(spark, tmp_path):
    refs, boxes = many_references(spark)
    tables = dict(zip(("ti", "tp", "bb", "cv", "dp"), artifacts(spark, ["big", "plain"])))
    tables["refs"] = M.matched_references(refs, boxes)
    names = []
    try:
        for name, df in tables.items():
            table = f"bucketed_{name}"
            spark.sql(f"DROP TABLE IF EXISTS {table}")
            df.write.bucketBy(4, "id").sortBy("id").option("path", str(tmp_path / name)).saveAsTable(table)
            names.append(table)
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        t = {n: spark.table(f"bucketed_{n}") for n in tables}
        m = M.assemble_manifest(t["ti"], t["tp"], t["bb"], t["cv"], t["dp"], t["refs"])
        assert "Exchange" not in m._jdf.queryExecution().executedPlan().toString()
        assert {r.id: r.n_references for r in m.collect()} == {"big": 5000, "plain": 2}
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    finally:
        for table in names:
            spark.sql(f"DROP TABLE IF EXISTS {table}")


# ------------------------------------------------------------ rank selection

def odd_doubles():
    rnd = random.Random(8)
    tiny = [5e-324, 1e-310, 2.2250738585072014e-308, 1.7976931348623157e308]
    powers = [2.0**e for e in range(-1074, 1024, 97)] + [math.nextafter(2.0**e, 0) for e in range(-1021, 1024, 61)]
    values = tiny + powers + [rnd.gauss(0, 1) * 10 ** rnd.randint(-12, 12) for _ in range(1500)] + [7.0] * 300
    return [s * v for v in values for s in (1, -1)] + [0.0, -0.0, float("inf"), float("-inf")]


def test_double_cells_keep_the_order(spark):
    values = sorted(odd_doubles())
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", double_cell(F.col("v")).alias("k")).collect()
    rows.sort(key=lambda r: r.v)
    assert all(a.k <= b.k for a, b in zip(rows, rows[1:]))
    assert all(a.k < b.k for a, b in zip(rows, rows[1:]) if abs(a.v - b.v) > 1e-8 * abs(b.v))
    assert all(a.k == b.k for a, b in zip(rows, rows[1:]) if a.v == b.v)
    nan = spark.createDataFrame([(float("nan"),), (None,)], "v double").select(double_cell(F.col("v")).alias("k")).collect()
    assert nan[0].k > max(r.k for r in rows) and nan[1].k is None


@pytest.mark.parametrize("kind", ["double", "bigint"])
def test_values_at_ranks(spark, kind):
    rnd = random.Random(2)
    values = odd_doubles() if kind == "double" else [rnd.randint(-2**63, 2**63 - 1) for _ in range(2000)] + [5] * 900 + [2**63 - 1, -2**63]
    rnd.shuffle(values)
    rows = [(None if i % 3 == 0 else i % 2, v) for i, v in enumerate(values)] + [(9, None)]
    df = spark.createDataFrame(rows, f"k int, v {kind}").repartition(6)
    wanted = lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda r: F.struct(r.alias("r"), r.alias("tag")))
    for keys in ([], ["k"]):
        groups = {}
        for k, v in rows:
            if v is not None:
                groups.setdefault(k if keys else "all", []).append(v)
        got = {(r["k"] if keys else "all", r.tag): r.value for r in values_at_ranks(df, "v", wanted, keys).collect()}
        assert got == {(k, i): v for k, vs in groups.items() for i, v in enumerate(sorted(vs))}
    assert values_at_ranks(df.where("k = 9"), "v", wanted).count() == 0


@pytest.mark.parametrize("n", [1500, 100_000])
def test_large_limits_per_category(spark, n):
    """One category holds most rows; ties, nulls and short categories keep their ranks."""
    df = spark.range(12_000).select(
        F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 10 < 8, "hot").otherwise("small").alias("category"),
        F.when(F.col("id") % 501 != 0, F.pmod(F.col("id") * 7919, F.lit(4001))).alias("v"), "id").repartition(7)
    w = Window.partitionBy("category").orderBy(F.asc("v"))
    want = df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    got = M.first_per_category(df, n, "v", hot_rows=1000)
    key = lambda d, r: Counter((x.category, x.v, x[r]) for x in d.select("category", "v", r).collect())
    assert key(got, "category_rank") == key(want, "r")


def test_stale_versions_with_large_keep(spark):
    df = spark.range(9000).select(F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("key"), F.col("id").alias("step")).where("key <> 'k2' OR step < 1500")
    got = sorted(map(tuple, M.stale_versions(df, 1200, "key").collect()))
    steps = {k: sorted(s for s in range(9000) if s % 3 == j and (j != 2 or s < 1500)) for j, k in enumerate(("k0", "k1", "k2"))}
    assert got == sorted((k, s) for k, v in steps.items() for s in v[:-1200])


def digest(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("build", [
    lambda d: B.drawn_crops(B.crop_numbers(d), 2, 3).select("n", "draw"),
    lambda d: S.augmentation_plan(B.crop_numbers(d), 3).select("n", "brightness", "rotate_deg"),
    lambda d: S.balanced_epoch(d.withColumn("root", F.when(F.col("n") % 9 == 0, "a").otherwise("b")), ["a", "b"], 1, 0, "n").select("draw_from_row", "n"),
])
def test_same_result_on_any_partitioning(skewed, build):
    assert len({tuple(digest(build(skewed.repartition(k)))) for k in (1, 4, 16)}) == 1


def test_epoch_roots_are_even(skewed):
    d = skewed.withColumn("root", F.when(F.col("n") % 9 == 0, "a").otherwise("b"))
    c = {r.draw_root: r["count"] for r in S.balanced_epoch(d, ["a", "b"], 1, 0, "n").groupBy("draw_root").count().collect()}
    assert sum(c.values()) == 3000 and abs(c["a"] - 1500) < 150
    with pytest.raises(Exception, match="empty dataset root"):
        S.balanced_epoch(d, ["a", "b", "missing"], 1, 0, "n").collect()


def test_archive_quota_paths_agree(spark):
    m = spark.range(9000).select(F.concat(F.lit("t"), F.col("id") % 3).alias("tar_stem"), F.floor(F.col("id") / 3).alias("member_no"))
    got = M.archive_quota(m, 2500, 6000, hot_rows=100).groupBy("tar_stem").agg(F.count("*").alias("n"), F.max("archive_rank").alias("top"))
    assert sorted(map(tuple, got.collect())) == [("t0", 2500, 2500), ("t1", 2500, 2500), ("t2", 1000, 1000)]


# ------------------------------------------------------------------ invariants

def test_grid_is_stratified(spark):
    n = 1960 * 2 + 777
    c = S.with_combo(spark.range(n), F.col("id"), 3, "c").groupBy("c").count().collect()
    assert len(c) == 1960 and {r["count"] for r in c} == {2, 3}


def test_cyclic_draws_use_every_item_once_per_cycle(spark):
    pool = spark.createDataFrame([("a", f"i{i}") for i in range(7)] + [("b", "only")], "g string, id string")
    draws = spark.range(70).select(F.lit("a").alias("g"), F.col("id").alias("k")).union(spark.range(5).select(F.lit("b"), "id"))
    got = S.cyclic_draws(draws, S.pool_index(pool, "g", "id", 1), "g", "k", 1)
    per_cycle = got.where("g = 'a'").groupBy(F.floor(F.col("k") / 7).alias("c")).agg(F.count_distinct("id").alias("n"), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("k", "id"))), lambda s: s["id"]), ",").alias("order")).collect()
    assert all(r.n == 7 for r in per_cycle) and len({r.order for r in per_cycle}) > 5
    assert got.where("g = 'b'").count() == 5


def test_distinct_positions(spark):
    df = D.with_positions(spark.range(700), {f"p{j}": S.distinct_draw(F.col("id"), j, 6, 7, 2, "loc") for j in range(6)})
    df = df.select("id", F.array(*[f"p{j}" for j in range(6)]).alias("p"))
    assert df.where(F.size(F.array_distinct("p")) < 6).count() == 0
    use = df.select(F.explode("p").alias("p")).groupBy("p").count().collect()
    assert {r["count"] for r in use} == {600}
    with pytest.raises(ValueError):
        S.distinct_draw(F.col("id"), 0, 8, 7, 2, "loc")


def cycles(spark, n, count):
    """Orders of ``count`` cycles of a pool of ``n``, from the literal and from the column form."""
    i = F.col("id")
    df = D.with_positions(spark.range(count * n).withColumn("n", F.lit(n)), {
        "a": D.cycle_draw(i, n, 4, "t"), "b": D.cycle_draw(i, F.col("n"), 4, "t", F.lit("k"))})
    return df.groupBy(D.int_div(i, n).alias("c")).agg(
        *[F.sort_array(F.collect_list(F.struct("id", x)))[x].alias(x) for x in "ab"]).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 8, 15, 24, 25, 97, 120])
def test_cycles_are_permutations(spark, n):
    seen = cycles(spark, n, 300)
    for name in "ab":
        assert all(sorted(r[name]) == list(range(n)) for r in seen)
        assert len({tuple(r[name]) for r in seen}) >= min(250, 0.8 * math.factorial(n))


@pytest.mark.parametrize("n,count", [(12, 1000), (15, 1000), (101, 100), (1960, 10), (100_000, 1)])
def test_cycles_keep_few_neighbours(spark, n, count):
    """Neighbours in a cycle are neighbours of the pool about as often as in a uniform shuffle (2 / n)."""
    for name in "ab":
        orders = [r[name] for r in cycles(spark, n, count)]
        kept = sum(abs(x - y) == 1 for o in orders for x, y in zip(o, o[1:])) / (count * (n - 1))
        assert kept < 3 / n
        first = Counter(o[0] for o in orders)
        assert n > 20 or max(first.values()) < 2 * count / n


def test_pools_of_any_size(spark):
    n = 2**59 + 7
    df = D.with_positions(spark.range(5000).withColumn("n", F.lit(n)), {"p": D.cycle_draw(F.col("id"), F.col("n"), 4, "t"), "q": D.cycle_draw(F.col("id"), n, 4, "t")})
    got = df.agg(F.count_distinct("p"), F.count_distinct("q"), F.min("p"), F.max("p"), F.max("q")).first()
    assert got[:2] == (5000, 5000) and 0 <= got[2] < n / 500 and n * 0.99 < got[3] < n and got[4] < n
    whole = df.select("p")._jdf.queryExecution().executedPlan().toString()
    assert whole.count("*(1)") >= D.ROUNDS or "WholeStageCodegen" in whole
    assert D.with_positions(df, {"z": D.cycle_draw(F.col("id"), F.lit(None).cast("long"), 4, "t")}).where("z is not null").count() == 0


def test_long_literal_pools(spark):
    pool = [f"x{i}" for i in range(40)]
    got = S.with_cyclic_values(spark.range(400), {"v": (pool, F.col("id"), "t")}, 1).groupBy("v").count().collect()
    assert len(got) == 40 and {r["count"] for r in got} == {10}


def test_many_categories(spark):
    """More categories than any array should hold: every slot uses each once per block."""
    n = 12_000
    sizes = spark.range(n).select(F.concat(F.lit("c"), "id").alias("category"), F.lit(1).alias("pool_size")).union(
        spark.createDataFrame([("landmark", 1), ("person", 1)], "category string, pool_size int"))
    samples = spark.range(n + 1).select(F.col("id").alias("sample_no"), F.lit(3).alias("num_references"))
    slots = S.composed_slots(samples, sizes, 3).where("slot > 1").groupBy("slot").agg(F.count("category").alias("n"), F.count_distinct("category").alias("d")).collect()
    assert len(slots) == 2 and all(r.n == r.d == n + 1 for r in slots)


def test_composed_categories_are_even(spark):
    sizes = spark.createDataFrame([(c, 1) for c in ("landmark", "person", "object", "celeb", "cuisine")], "category string, pool_size long")
    n = 4000
    samples = spark.range(n).select(F.col("id").alias("sample_no"), F.lit(4).alias("num_references"))
    slots = S.composed_slots(samples, sizes, 3, max_refs=4).cache()
    use = slots.where("slot > 1").groupBy("slot", "category").count().collect()
    assert len(use) == 12 and {r["count"] for r in use} == {n // 4}
    per = slots.groupBy("sample_no").agg(F.count_if(F.col("category") == "person").alias("p"), F.count("slot").alias("n"), F.count_distinct("category").alias("d"))
    assert per.where("p > 1 or n <> 4").count() == 0 and 0 < per.where("d < 4").count() < 0.15 * n
    three = S.composed_slots(samples.withColumn("num_references", F.lit(3)), sizes, 3).cache()
    assert {r["count"] for r in three.where("slot > 1").groupBy("slot", "category").count().collect()} == {n // 4}
    per = three.groupBy("sample_no").agg(F.count_if(F.col("category") == "person").alias("p"), F.count_distinct("category").alias("d"))
    assert per.where("p > 1").count() == 0 and 0 < per.where("d < 3").count() < 0.15 * n
    few = S.composed_slots(samples, sizes.where("category in ('landmark', 'person', 'object')"), 3, max_refs=4)
    per = few.groupBy("sample_no").agg(F.count_if(F.col("category") == "person").alias("p"), F.count("slot").alias("n"))
    assert per.where("p <> 1 or n <> 4").count() == 0


def test_balanced_characters_surfaces_and_locations(spark):
    n = 20_000
    looks = H.balanced_themes(spark.range(n).withColumnRenamed("id", "sample_no"), n, 9).select("theme", "shot_type", "character_text", "object_details").cache()
    uneven = lambda df, *by: df.groupBy(*by, "x").count().groupBy(*by).agg((F.max("count") - F.min("count")).alias("d")).where("d > 1").count()
    people = looks.where("character_text is not null").select("theme", F.col("character_text").alias("x"))
    assert people.count() == n // 2 and uneven(people, "theme") == 0
    objects = looks.select("theme", "shot_type", F.explode("object_details").alias("d"))
    own = list(K.SURFACE_OVERRIDES)
    assert uneven(objects.where(~F.col("d.object").isin(own)).select("theme", F.col("d.surface_text").alias("x")), "theme") == 0
    assert uneven(objects.where(F.col("d.object").isin(own)).select("theme", F.col("d.object").alias("o"), F.col("d.surface_text").alias("x")), "theme", "o") == 0
    assert uneven(objects.select("shot_type", F.col("d.location_key").alias("x")), "shot_type") == 0
    orders = looks.groupBy("shot_type").agg(F.count_distinct(F.transform("object_details", lambda d: d["location_key"])).alias("n"))
    assert all(r["n"] > 1_000 for r in orders.collect())


def test_augmentation_modes(spark):
    crops = spark.range(2000).select(F.concat(F.lit("i"), "id").alias("image_path"), F.lit(0).alias("crop_no"))
    plan = S.augmentation_plan(crops, 3, uniform_brightness=True, probs={"bright": 1.0, "flip": 0.0}).cache()
    low, high = K.BRIGHTNESS_RANGE
    found = plan.agg(F.min("brightness"), F.max("brightness"), F.count("brightness"), F.count_if("flip")).first()
    assert low <= found[0] < low + 0.05 * (high - low) and high - 0.05 * (high - low) < found[1] < high and found[2:] == (2000, 0)
    with pytest.raises(ValueError):
        S.augmentation_plan(crops, 3, probs={"blur": 1.0})


def test_composition_rules(spark):
    refs = spark.createDataFrame(
        [(f"{c}{i}", c, "cap", f"outputs/{c}/images/{i}.jpg", "GOOD", None) for c, n in (("landmark", 5), ("person", 9), ("object", 4), ("celeb", 3)) for i in range(n)],
        "id string, category string, caption string, saved_image_path string, quality string, error string")
    from tilewright.plans.composition import composed_samples

    n = 2001
    c = composed_samples(spark.range(n).withColumnRenamed("id", "sample_no"), refs, n, 5).cache()
    assert {r.num_references: r["count"] for r in c.groupBy("num_references").count().collect()} == {2: 1001, 3: 1000}
    cats = F.col("reference_categories")
    count = lambda name: F.size(F.filter(cats, lambda x: x == name))
    assert c.where((cats[0] != "landmark") | (count("landmark") != 1) | (count("person") > 1)).count() == 0
    subjects = F.slice(cats, 2, 2)
    repeated = c.where((F.col("num_references") == 3) & (F.size(F.array_distinct(subjects)) < 2)).count()
    assert 0 < repeated < 0.15 * 1000
    use = c.select(F.explode("reference_ids").alias("r")).groupBy(F.regexp_extract("r", "[a-z]+", 0).alias("c"), "r").count()
    assert use.groupBy("c").agg((F.max("count") - F.min("count")).alias("d")).where("d > 1").count() == 0
    assert c.where(~F.col("prompt_text").contains("1. [landmark] (LANDSCAPE/ENVIRONMENT) cap")).count() == 0


def test_generators_do_not_depend_on_the_range_split(spark):
    whole = spark.range(500).withColumnRenamed("id", "sample_no")
    some = whole.where("sample_no % 7 = 3")
    for gen in (H.max_permutations, H.balanced_themes):
        a = {r.id: r.structured_prompt for r in gen(whole, 500, 9).collect()}
        b = {r.id: r.structured_prompt for r in gen(some, 500, 9).collect()}
        assert len(a) == 500 and all(a[k] == v for k, v in b.items())
    assert H.balanced_per_theme(spark, 4, 9).groupBy("theme").count().where("count <> 4").count() == 0


def test_locations_are_distinct_and_allowed(spark):
    from tilewright import constants as K

    df = H.max_permutations(spark.range(600).withColumnRenamed("id", "sample_no"), 600, 9).select("shot_type", "objects", F.transform("object_details", lambda d: d["location_key"]).alias("loc"))
    for r in df.collect():
        assert len(set(r.loc)) == 6 and set(r.loc) <= set(K.SHOT_LOCATIONS[r.shot_type]) and len(set(r.objects)) == 6


# ------------------------------------------------------------------------ plans

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["canvas_layout", "matched_labels", "manifest", "two_nearest", "locked_rotations", "composed_samples",
                                  "placed_layers", "condition_grid_use", "max_permutations", "pairing_report", "chosen_views"])
def test_no_cross_joins(spark, name):
    p = plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_small_and_large_samples_match_alike(spark):
    rnd = random.Random(4)
    words = ["cup", "tea cup", "a red tea cup", "Tea-Cup", "an", "", " ", None, "jar", "red", "edr\u00e9 cup"]
    det = [(rnd.choice([None, "s1", "s2", "s3"]), n, rnd.choice(words), rnd.choice([None, 0.5, 0.9, float("nan")])) for n in range(120)]
    req = [(s, n, rnd.choice(words)) for s in (None, "s1", "s2", "s3", "s4") for n in range(9)] + [("s1", 1, "cup")] * 2
    det, req = spark.createDataFrame(det, "id string, det_no int, label string, score double"), spark.createDataFrame(req, "id string, object_no int, object string")
    in_lists, by_words, mixed = (sorted(map(str, T.match_labels(req, det, payload=(), sample_rows=n).collect())) for n in (1000, 0, 30))
    assert in_lists == by_words == mixed and len(in_lists) == 47


def test_label_match_reads_its_tables_a_few_times_only(spark):
    df = queries()["matched_labels"](spark, SF)
    df.collect()
    assert 1 <= len(re.findall(r"FileScan parquet \[l_\w+", plan(df).split("Initial Plan")[0])) <= 3


def test_composed_balance_draws_its_slots_once(spark):
    df = queries()["composed_balance"](spark, SF)
    assert all(r.capped and r.even for r in df.collect())
    # The slots are read once to be numbered and once to be counted by band; no second pass holds them against the rules.
    assert plan(df).split("Initial Plan")[0].count("FileScan parquet [o_orderkey") <= 2


def test_rank_limits_apply_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    assert "WindowGroupLimit" in plan(first_per_key(df, ["k"], [F.asc("id")], 5))


def test_scans_are_pruned(spark):
    p = plan(queries()["found_counts"](spark, SF))
    assert "l_extendedprice" not in p and "l_returnflag" in p


def test_id_lookup_is_pushed_down(spark):
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,17)]" in plan(queries()["found_by_id"](spark, SF))


def test_nearest_two_with_many_equal_rows():
    import numpy as np

    from tilewright.operators.match import _nearest_two

    rng = np.random.default_rng(0)
    refs = rng.normal(size=(300, 16))
    refs[[5, 9, *range(40, 52)]] = refs[5]
    at, dist = _nearest_two(refs[[5]] + 1e-3, refs, "l2")
    assert at.tolist() == [[5, 9]] and dist[0, 0] == dist[0, 1]
    q = rng.normal(size=(50, 16))
    at, dist = _nearest_two(q, refs, "l2")
    full = np.sqrt(((q[:, None] - refs[None]) ** 2).sum(axis=2))
    assert at.tolist() == np.argsort(full, axis=1, kind="stable")[:, :2].tolist()


def test_hot_split_does_not_change_orders(spark):
    from pyspark.sql import functions as F

    from tilewright.operators import boxes

    odd = [None, float("nan"), float("inf"), float("-inf"), 0.9, 0.9, 0.1, -0.5, 0.0, 400.0, 9.0]
    rows = [("k", i, v, (None, True, False)[i % 3], float(i), 0.0, float(i) + 300, 300.0) for i, v in enumerate(odd * 2)]
    df = spark.createDataFrame(rows, "id string, idx int, v double, is_background boolean, x1 double, y1 double, x2 double, y2 double")
    one = df.withColumn("confidence", F.col("v")).withColumn("coverage", F.col("v"))
    for build in (
        lambda n: boxes.crop_numbers(one, "id", hot_rows=n), lambda n: boxes.z_order(one, F.col("v"), "idx", hot_rows=n),
        lambda n: boxes.layer_order(one, hot_rows=n),
    ):
        key = lambda r: r["idx"]
        assert str(sorted(build(1).collect(), key=key)) == str(sorted(build(10**6).collect(), key=key))


def test_seed_of_any_number_of_digits(spark):
    from pyspark.sql import functions as F

    from tilewright.functions.text import seed_from_digits

    ids = ["a1b22", "x" + "9876543210" * 5, "none", "0" * 45 + "7", None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i string").select(seed_from_digits(F.col("i"), 42)).collect()]
    want = [(42 + int("".join(c for c in (i or "") if c.isdigit()) or 0)) % (2**31 - 1) for i in ids]
    assert got == want


def test_long_order_keys_stay_apart(spark):
    from catalog.views import DETECTION_COLUMNS, sample_id

    keys = spark.createDataFrame([(12345678,), (12345679,)], "l_orderkey long")
    assert keys.selectExpr(DETECTION_COLUMNS[0][1], sample_id("l_orderkey * 1000")).distinct().count() == 2


@pytest.mark.parametrize("name", ["resolved_assets", "pairing_report", "pairing_report_without_captions", "pairing_examples"])
def test_listings_are_merged_not_broadcast(spark, name):
    assert "BroadcastExchange" not in plan(queries()[name](spark, SF))


def test_asset_candidates_of_odd_paths(spark):
    rows = [("a/b.x/c.jpg",), ("c.jpg",), (".hidden",), ("a/",), ("",), (None,)]
    got = spark.createDataFrame(rows, "rel string").select("rel", M.caption_candidates(F.col("rel")).alias("c"), M.depth_candidates(F.col("rel")).alias("d")).collect()
    assert [r.c for r in got] == [["c.txt", "a/b.x/c.txt"], ["c.txt"], [".hidden.txt"], [".txt", "a/.txt"], [".txt"], []]
    assert got[0].d[:2] == ["c.png", "c.jpg"] and got[0].d[6] == "a/b.x/c.png" and got[-1].d == []
    assert got[2].d[-1] == ".hidden" and got[3].d[-2:] == ["", "a/"]


@pytest.fixture(scope="module")
def matches(spark):
    """Pairs of 2 to 400 points: half of them turned and scaled, the rest anywhere; pair 7 has no good half."""
    rnd = random.Random(8)
    rows = []
    for pair, n in enumerate((2, 3, 5, 40, 64, 65, 130, 200, 400)):
        for i in range(n):
            x, y = rnd.random() * 300, rnd.random() * 300
            a, b = 1.5 * math.cos(pair / 3), 1.5 * math.sin(pair / 3)
            good = i % 2 == 0 and pair != 7
            rows.append((pair, f"p{i}", x, y, *((a * x - b * y + 9, b * x + a * y - 4) if good else (rnd.random() * 900, rnd.random() * 900))))
    pts = spark.createDataFrame(rows, "pair_id long, point_no string, sx double, sy double, dx double, dy double").repartition(5)
    return pts, spark.createDataFrame([(p, 1.5) for p in range(9)], "pair_id long, expected_scale double")


@pytest.mark.parametrize("locked", [True, False])
def test_consensus_in_one_task_and_in_blocks_agree(matches, locked):
    pts, sc = matches
    fixed = lambda rows: sorted(tuple(None if v is None else round(v, 6) for v in r) for r in rows)
    small, blocks = (fixed(T.consensus(pts, sc if locked else None, limit=2.0, whole=w, block=32).collect()) for w in (10**6, 1))
    assert small == blocks and len(small) == 8
    assert {r[0]: r[1] for r in small}[8] >= 200


def test_best_model_is_the_first_of_the_best():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (3, 64, 65, 500):
        pts = rng.normal(size=(4, n))
        pts[2:, ::2] = pts[:2, ::2]
        models = np.concatenate([rng.normal(size=(4, 40)), np.repeat([[1.0], [0.0], [0.0], [0.0]], 3, axis=1), rng.normal(size=(4, 700))], axis=1)
        for limit in (1e-9, 0.3, 2.0):
            assert T._best_model(models, pts, limit) == int(np.argmax(T._inside(models, pts, limit).sum(axis=1)))


def test_hypotheses_are_not_shuffled(spark):
    """Only points move: the search of a pair happens where its points meet."""
    p = plan(queries()["locked_rotations"](spark, SF))
    assert "FlatMapGroupsInArrow" in p


@pytest.mark.parametrize("n", [1, 2, 3, 15, 24])
def test_batched_cycle_positions_equal_single_ones(spark, n):
    df = spark.range(500).select("id", F.when(F.col("id") % 7 == 0, F.array()).otherwise(F.array(F.col("id") * 5, F.lit(None).cast("long"), F.col("id") + 9)).alias("d"))
    batch = df.select("id", F.posexplode(D.small_cycle_positions(F.col("d"), n, 3, "x")).alias("p", "a"))
    single = df.select("id", F.posexplode("d").alias("p", "v")).select("id", "p", D.small_cycle_position(F.pmod("v", F.lit(n)), D.int_div(F.col("v"), n), n, 3, "x").alias("b"))
    both = batch.join(single, ["id", "p"])
    assert both.count() == batch.count() == 428 * 3 and both.where("not (a <=> b)").count() == 0


def test_looks_are_drawn_once(spark):
    """Taking the objects apart must not repeat all draws in a filter below."""
    p = queries()["balanced_looks"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert max(map(len, p.split("\n"))) < 30_000


def test_composed_texts_are_never_gathered(spark):
    """Captions join slot by slot: no list is gathered with them, and samples with more slots keep their own records."""
    refs = spark.createDataFrame(
        [(f"{c}{i}", c, f"cap {c}{i}", f"{c}{i}.jpg", "GOOD", None) for c in ("landmark", "person", "object", "celeb", "cuisine") for i in range(4)],
        "id string, category string, caption string, saved_image_path string, quality string, error string")
    from tilewright.plans.composition import composed_samples

    c = composed_samples(spark.range(300).withColumnRenamed("id", "sample_no"), refs, 300, 5, {2: 0.5, 4: 0.5})
    assert not [line for line in plan(c).splitlines() if "collect_list" in line and "caption" in line]
    rows = c.collect()
    assert sorted(len(r.reference_ids) for r in rows) == [2] * 150 + [4] * 150
    assert all(r.num_references == len(r.reference_ids) and r.reference_captions == [f"cap {i}" for i in r.reference_ids] for r in rows)
    assert all(i.startswith(k) for r in rows for i, k in zip(r.reference_ids, r.reference_categories))


def test_digests_read_on_from_row_to_row():
    import hashlib

    from tilewright.functions import digest as D

    rnd = random.Random(7)
    texts = [rnd.randbytes(n) for n in (0, 1, 55, 56, 63, 64, 65, 127, 128, 3000, *[rnd.randrange(300) for _ in range(30)])]
    whole, state = [b""] * 9000, [D.NEW] * 9000
    for _ in range(3):
        leads, of = [rnd.randbytes(rnd.randrange(130)) for _ in whole], [rnd.randrange(len(texts)) for _ in whole]
        state, whole = D.read_on(state, leads, texts, of), [w + lead + texts[k] for w, lead, k in zip(whole, leads, of)]
    assert D.closed(state) == [hashlib.md5(w).digest() for w in whole] and D.read_on([], [], texts, []) == []


@pytest.mark.parametrize("groups", [(100_000, 16_000_000), (7, 30)])
def test_composed_digests_are_those_of_the_prompts(spark, monkeypatch, groups):
    """In few groups, and in many with some that hold captions alone and records that are dealt out in copies."""
    from tilewright.plans import composition as C

    monkeypatch.setattr(C, "GROUP_SAMPLES", groups[0])
    monkeypatch.setattr(C, "GROUP_BYTES", groups[1])
    refs = spark.createDataFrame(
        [(f"{c}{i}", c, f"caption \u00e9 {c}{i} " * (i * i), f"{c}{i}.jpg", "GOOD", None)
         for c, n in (("landmark", 5), ("person", 1), ("object", 3), ("celeb", 12), ("cuisine", 4)) for i in range(1, n + 1)],
        "id string, category string, caption string, saved_image_path string, quality string, error string")
    samples = spark.range(300).withColumnRenamed("id", "sample_no")
    for weights in (None, {2: 0.3, 4: 0.7}) if groups[0] < 100 else (None,):
        same = ["id", "sample_no", "num_references", "reference_categories", "reference_ids", "conditions", "prompt_md5"]
        want = C.composed_samples(samples, refs, 300, 5, weights).withColumn("prompt_md5", F.md5("prompt_text")).select(*same)
        got = sorted(map(str, C.composed_digests(samples, refs, 300, 5, weights).select(*same).collect()))
        assert len(got) == 300 and got == sorted(map(str, want.collect()))


def test_composed_digests_without_references(spark):
    from tilewright.plans import composition as C

    refs = spark.createDataFrame([("a", "person", "cap", "a.jpg", "GOOD", None)], "id string, category string, caption string, saved_image_path string, quality string, error string")
    samples = spark.range(20).withColumnRenamed("id", "sample_no")
    want = C.composed_samples(samples, refs.where("false"), 20, 5).select("id", "num_references", F.md5("prompt_text").alias("prompt_md5"))
    got = C.composed_digests(samples, refs.where("false"), 20, 5).select("id", "num_references", "prompt_md5").collect()
    assert len(got) == 20 and sorted(got) == sorted(want.collect())
    with pytest.raises(Exception, match="no usable 'landmark' reference"):
        C.composed_digests(samples, refs, 20, 5).collect()


def test_no_text_is_joined_to_samples(spark):
    """A caption beside a sample is moved and written once for each sample that shows it."""
    def nodes(p):
        yield p
        for k in range(p.children().length()):
            yield from nodes(p.children().apply(k))

    root = queries()["composed_samples"](spark, SF)._jdf.queryExecution().optimizedPlan()
    joined = [n.output().mkString(",") for n in nodes(root) if n.nodeName() in ("Join", "FlatMapCoGroupsInArrow")]
    assert joined and not [out for out in joined if "__places" in out and ("caption" in out or "__record" in out)]


def test_numbering_leaves_rows_where_it_dealt_them(spark):
    """The sizes of earlier bands are joined to the rows without dealing them again; null keys are keys."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") % 3)).alias("k"), F.col("id").alias("n"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = split_ordinal(df, ["k"], [F.asc("n")], F.floor(F.col("n") / 64))
        assert got.where("ordinal <> floor(n / 3)").count() == 0 and got.count() == 3000
        assert len([line for line in plan(got).splitlines() if "Exchange hashpartitioning" in line and "__band" in line]) <= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_do_not_meet_by_root(spark):
    """Two roots: joined by root, all rows would meet in two tasks."""
    df = spark.range(1000).select(F.when(F.col("id") % 11 == 0, "small").otherwise("large").alias("root"), F.col("id").cast("string").alias("row_key"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        weights, epoch = S.balanced_weights(df), S.balanced_epoch(df, ["small", "large"], 3, 1, "row_key")
        assert "SortMergeJoin" not in plan(weights)
        assert plan(epoch).count("BroadcastHashJoin") == 1
        assert weights.where("abs(weight - if(root = 'small', 1 / 91, 1 / 909)) > 1e-12").count() == 0 and epoch.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_crop_numbers_shuffle_boxes_once(spark, skewed):
    """Without a hot image the boxes are dealt by image once, for their numbers and for their lists."""
    g = B.grouped_boxes(B.crop_numbers(skewed))
    g.collect()
    final = plan(g).split("== Initial Plan ==")[0]
    assert "__band" not in final and len(re.findall(r"Exchange hashpartitioning\(image_path", final)) == 1


def test_null_images_are_numbered(spark):
    rows = [(None, i / 50) for i in range(40)] + [("a", i / 50) for i in range(30)]
    df = spark.createDataFrame(rows, "image_path string, confidence double").select("*", *[F.lit(float(v)).alias(c) for c, v in zip(B.CORNERS, (0, 0, 300, 300))])
    for limit in (10, 35, 10**6):
        got = B.crop_numbers(df, hot_rows=limit).collect()
        assert sorted((r.image_path or "", r.crop_no, r.mv_crop_no) for r in got) == [("", i, i) for i in range(40)] + [("a", i, i) for i in range(30)]
