"""Manifest joins, pairing, resume, shards and set operations over the per-sample artifact views."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import query
from tilewright import constants as K
from tilewright.functions import text as X
from tilewright.operators import boxes as B
from tilewright.operators import manifest as M
from tilewright.operators import quality as Q

TI, TP, CV, DP, BB = (V.order_sql(v) for v in ("theme_images", "theme_prompts", "canvas", "depth", "bbox_meta"))
ID_OF_LINE = V.sample_id("order_key")

# Boxes: the numbered detections of every seventh-free order; references: lines with a large quantity.
_BOXES = f"""{V.det_sql()}, {V.numbered_sql()}, boxes AS (SELECT {ID_OF_LINE} AS id, crop_no + 1 AS bbox_index, class_name AS object, label, confidence AS score,
  found, x1, y1, x2, y2, quantity FROM numbered WHERE order_key % 7 <> 0)"""
_REFS = f"""rf AS (SELECT {ID_OF_LINE} AS id, crop_no + 1 AS bbox_index, CASE WHEN line = 2 THEN '' WHEN line = 3 THEN class_name END AS object,
  CASE WHEN line = 1 THEN label END AS detected_label, CASE WHEN line = 4 THEN 0.0::DOUBLE WHEN line = 5 THEN confidence END AS detection_score,
  CASE WHEN line = 6 THEN concat('ref/', {ID_OF_LINE}, '.webp') END AS output_image FROM numbered WHERE quantity > 20
  UNION ALL SELECT {V.sample_id('o_orderkey')}, 99, 'extra', NULL, NULL, NULL FROM orders WHERE o_orderkey % 50 = 0)"""
_MATCHED = """matched AS (SELECT r.id, r.bbox_index, coalesce(nullif(r.object, ''), b.object) AS object, coalesce(nullif(r.detected_label, ''), b.label) AS detected_label,
  coalesce(nullif(r.detection_score, 0), b.score) AS detection_score, b.x1 AS sx1,
  coalesce(nullif(r.output_image, ''), concat('bbox', cast(r.bbox_index as varchar), '.jpg')) AS image
  FROM rf r LEFT JOIN boxes b ON r.id = b.id AND r.bbox_index = b.bbox_index)"""


def numbered(spark, sf):
    d = V.detections(spark, sf, ["image_path", "order_key", "class_name", "label", "confidence", "x1", "y1", "x2", "y2", "found", "line", "quantity"])
    return B.crop_numbers(d).withColumn("id", F.expr(ID_OF_LINE)).withColumn("bbox_index", (F.col("crop_no") + 1).cast("int"))


def boxes(n):
    return n.where(F.col("order_key") % 7 != 0).select(
        "id", "bbox_index", F.col("class_name").alias("object"), "label", F.col("confidence").alias("score"), "found",
        F.array("x1", "y1", "x2", "y2").alias("bbox"), F.array().cast("array<double>").alias("bbox_norm"))


def references(spark, sf, n):
    line = F.col("line")
    null = lambda t: F.lit(None).cast(t)
    own = n.where(F.col("quantity") > 20).select(
        "id", "bbox_index", F.when(line == 2, "").when(line == 3, F.col("class_name")).alias("object"),
        F.when(line == 1, F.col("label")).alias("detected_label"),
        F.when(line == 4, 0.0).when(line == 5, F.col("confidence")).alias("detection_score"),
        F.array().cast("array<double>").alias("source_bbox"),
        F.when(line == 6, F.concat(F.lit("ref/"), "id", F.lit(".webp"))).alias("output_image"),
        null("bigint").alias("seed"), null("string").alias("model_id"))
    extra = V.table(spark, sf, "orders").where("o_orderkey % 50 = 0").select(
        F.expr(V.sample_id("o_orderkey")).alias("id"), F.lit(99).alias("bbox_index"), F.lit("extra").alias("object"),
        null("string").alias("detected_label"), null("double").alias("detection_score"),
        null("array<double>").alias("source_bbox"), null("string").alias("output_image"),
        null("bigint").alias("seed"), null("string").alias("model_id"))
    return own.unionByName(extra)


@query("matched_references", f"WITH {_BOXES}, {_REFS}, {_MATCHED} SELECT id, bbox_index, object, detected_label, detection_score, sx1, image FROM matched")
def matched_references(spark, sf):
    n = numbered(spark, sf)
    m = M.matched_references(references(spark, sf, n), boxes(n))
    return m.select("id", "bbox_index", "object", "detected_label", "detection_score", F.try_element_at("source_bbox", F.lit(1)).alias("sx1"), "image")


def _manifest_sql(complete: bool) -> str:
    opt = "JOIN" if complete else "LEFT JOIN"
    item = "concat_ws('=', cast(bbox_index as varchar), image, object, detected_label, cast(cast(floor(detection_score * 10000) as bigint) as varchar))"
    return f"""WITH {TI}, {TP}, {CV}, {DP}, {BB}, {_BOXES}, {_REFS}, {_MATCHED},
  lists AS (SELECT id, count(*) AS n_refs, string_agg({item}, ' ' ORDER BY bbox_index) AS refs FROM matched GROUP BY 1)
  SELECT i.id, coalesce(nullif(i.theme, ''), p.theme) AS theme, coalesce(nullif(i.prompt, ''), p.combined_prompt, p.prompt) AS caption,
  coalesce(nullif(i.structured_prompt, ''), p.structured_prompt) AS structured_prompt,
  coalesce(nullif(i.num_objects, 0), p.num_objects) AS num_objects, '' AS objects,
  array_to_string(coalesce(i.object_details, p.object_details, []), '|') AS object_details,
  i.gt_image, c.image AS canvas_image, d.image AS depth_image, d.raw AS depth_raw,
  coalesce(nullif(i.gen_width, 0), nullif(b.image_width, 0), d.image_width) AS image_width,
  coalesce(nullif(i.gen_height, 0), nullif(b.image_height, 0), d.image_height) AS image_height,
  i.seed, cast(NULL as double) AS guidance_scale, cast(NULL as int) AS num_inference_steps, i.model_id,
  array_to_string(b.bbox_information, '|') AS bbox_annotations, c.metadata AS canvas_metadata, c.num_placements,
  array_to_string(c.placements, '|') AS placements, d.metadata AS depth_metadata, d.depth_type, d.depth_min, d.depth_max,
  coalesce(r.n_refs, 0) AS n_refs, r.refs, p.metadata AS source_prompt, i.metadata AS source_theme, b.metadata AS source_boxes
  FROM theme_images i JOIN bbox_meta b ON i.id = b.id JOIN depth d ON i.id = d.id
  {opt} theme_prompts p ON i.id = p.id {opt} canvas c ON i.id = c.id {opt} lists r ON i.id = r.id"""


def _manifest(spark, sf, complete):
    n = numbered(spark, sf)
    refs = M.matched_references(references(spark, sf, n), boxes(n))
    v = {k: V.order_view(spark, sf, k) for k in ("theme_images", "theme_prompts", "canvas", "depth", "bbox_meta")}
    m = M.assemble_manifest(v["theme_images"], v["theme_prompts"], v["bbox_meta"], v["canvas"], v["depth"], refs, complete)
    item = lambda r: F.concat_ws(
        "=", r["bbox_index"].cast("string"), r["image"], r["object"], r["detected_label"], F.floor(r["detection_score"] * 10000).cast("string"))
    joined = lambda c: F.array_join(c, "|")
    return m.select(
        "id", "theme", "caption", "structured_prompt", "num_objects", joined("objects").alias("objects"),
        joined("object_details").alias("object_details"), "gt_image", "canvas_image", "depth_image", "depth_raw",
        "image_width", "image_height", "generation.*", joined("bbox_annotations").alias("bbox_annotations"),
        F.col("canvas.metadata").alias("canvas_metadata"), "canvas.num_placements", joined("canvas.placements").alias("placements"),
        F.col("depth.metadata").alias("depth_metadata"), "depth.depth_type", "depth.depth_min", "depth.depth_max",
        F.col("n_references").alias("n_refs"),
        F.when(F.col("n_references") > 0, F.array_join(F.transform("reference_images", item), " ")).alias("refs"),
        F.col("source_files.theme_prompt").alias("source_prompt"), F.col("source_files.theme_metadata").alias("source_theme"),
        F.col("source_files.bbox_metadata").alias("source_boxes"))


@query("manifest", _manifest_sql(False))
def manifest(spark, sf):
    return _manifest(spark, sf, False)


@query("manifest_complete", _manifest_sql(True))
def manifest_complete(spark, sf):
    return _manifest(spark, sf, True)


# Raw records with blank and nested fields, and a file listing that lacks some images.
_RAW = f"""{TI}, raw AS (SELECT id, concat(' ', coalesce(prompt, ''), ' ') AS caption, CASE WHEN seed % 23 = 0 THEN '' ELSE gt_image END AS gt_image,
  CASE WHEN seed % 3 = 0 THEN NULL ELSE concat('c/', id) END AS canvas_image, CASE WHEN seed % 9 = 0 THEN NULL ELSE concat('nested/', id) END AS canvas_nested,
  CASE WHEN seed % 29 = 0 THEN NULL ELSE concat('d/', id) END AS depth_image, gen_width, seed FROM theme_images),
  norm AS (SELECT id, trim(caption) AS caption, gt_image, coalesce(canvas_image, canvas_nested, '') AS canvas_image, coalesce(depth_image, '') AS depth_image,
  coalesce(gen_width, 0) AS image_width, seed FROM raw)"""
_LOST = "seed % 31 = 0"


def raw_records(spark, sf):
    t = V.order_view(spark, sf, "theme_images")
    s = F.col("seed")
    return t.select(
        "id", "seed", F.concat(F.lit(" "), F.coalesce("prompt", F.lit("")), F.lit(" ")).alias("caption"),
        F.when(s % 23 == 0, "").otherwise(F.col("gt_image")).alias("gt_image"),
        F.when(s % 3 != 0, F.concat(F.lit("c/"), "id")).alias("canvas_image"),
        F.struct(F.when(s % 9 != 0, F.concat(F.lit("nested/"), "id")).alias("image")).alias("canvas"),
        F.when(s % 29 != 0, F.concat(F.lit("d/"), "id")).alias("depth_image"),
        F.struct(F.lit(None).cast("string").alias("image")).alias("depth"),
        F.col("gen_width").cast("string").alias("image_width"), F.lit("n/a").alias("image_height"))


@query("normalized_records", f"WITH {_RAW} SELECT id, caption, gt_image, canvas_image, depth_image, image_width, 0 AS image_height FROM norm")
def normalized_records(spark, sf):
    return M.normalized_records(raw_records(spark, sf))


@query("drop_reasons", f"""WITH {_RAW} SELECT CASE WHEN caption = '' THEN 'missing_caption' WHEN gt_image = '' THEN 'missing_gt' WHEN canvas_image = '' THEN 'missing_canvas'
  WHEN depth_image = '' THEN 'missing_depth' WHEN {_LOST} THEN 'missing_file' ELSE 'kept' END AS reason, count(*) AS n FROM norm GROUP BY 1""")
def drop_reasons(spark, sf):
    raw = raw_records(spark, sf)
    rec = M.normalized_records(raw)
    there = raw.where(f"NOT ({_LOST})").select("id")
    files = rec.join(there, "id").select(F.explode(F.array("gt_image", "canvas_image", "depth_image")).alias("path")).where("path <> ''")
    # Canvas and ground truth of the lost samples exist; only their depth map is gone.
    rest = rec.join(there, "id", "left_anti").select(F.explode(F.array("gt_image", "canvas_image")).alias("path")).where("path <> ''")
    return M.drop_reason_counts(M.with_drop_reason(rec, files.union(rest)))


@query("prompt_status", f"""WITH {TI}, {CV} SELECT i.id, CASE WHEN trim(coalesce(prompt, '')) = '' THEN 'failed' WHEN c.id IS NOT NULL THEN 'skipped' ELSE 'pending' END AS status
  FROM theme_images i LEFT JOIN canvas c ON i.id = c.id""")
def prompt_status(spark, sf):
    return M.prompt_status(V.order_view(spark, sf, "theme_images"), V.order_view(spark, sf, "canvas"), "prompt").select("id", "status")


@query("pending_samples", f"WITH {TI}, {CV} SELECT id FROM theme_images WHERE id NOT IN (SELECT id FROM canvas)")
def pending_samples(spark, sf):
    return M.pending(V.order_view(spark, sf, "theme_images"), V.order_view(spark, sf, "canvas")).select("id")


@query("pending_multi_artifact", f"""WITH {TI}, {CV}, {DP}, {BB} SELECT id FROM theme_images EXCEPT
  (SELECT id FROM canvas INTERSECT SELECT id FROM depth INTERSECT SELECT id FROM bbox_meta)""")
def pending_multi_artifact(spark, sf):
    o = [V.order_view(spark, sf, v) for v in ("canvas", "depth", "bbox_meta")]
    return M.pending(V.order_view(spark, sf, "theme_images"), *o).select("id")


@query("discovered_ids", f"WITH {CV}, {DP} SELECT id FROM canvas UNION SELECT id FROM depth")
def discovered_ids(spark, sf):
    return M.discovered_ids(V.order_view(spark, sf, "canvas"), V.order_view(spark, sf, "depth"))


# ---------------------------------------------------------------- asset pairing

# Every third depth map lies flat, others nested or as JPEG; captions only for some.
_REL = "rels AS (SELECT DISTINCT concat('set', cast(o_orderkey % 3 as varchar), '/', cast(o_orderkey as varchar), '.jpg') AS rel, o_orderkey AS k FROM orders)"
_PAIR = f"""{_REL}, dfile AS (SELECT rel, CASE WHEN k % 4 = 0 THEN concat(cast(k as varchar), '.png') WHEN k % 4 = 1 THEN replace(rel, '.jpg', '.webp') WHEN k % 4 = 2 THEN rel END AS depth_asset FROM rels),
  p AS (SELECT r.rel, r.k % 10 <> 0 AS has_image, depth_asset, depth_asset IS NOT NULL AS has_depth, r.k % 6 <> 5 AS has_caption FROM rels r JOIN dfile d ON r.rel = d.rel)"""


def rels(spark, sf):
    return V.table(spark, sf, "orders").select(
        F.concat(F.lit("set"), (F.col("o_orderkey") % 3).cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("rel"),
        F.col("o_orderkey").alias("k")).distinct()


def depth_files(r):
    k = F.col("k")
    path = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(".png"))).when(k % 4 == 1, F.regexp_replace("rel", "jpg$", "webp")).when(k % 4 == 2, F.col("rel"))
    # A worse candidate exists as well and must lose.
    worse = F.when(k % 8 == 0, F.col("rel"))
    return r.select(F.explode(F.array_compact(F.array(path, worse))).alias("path"))


@query("resolved_assets", f"WITH {_PAIR} SELECT rel, depth_asset AS asset FROM p")
def resolved_assets(spark, sf):
    r = rels(spark, sf)
    return M.resolve_assets(r.select("rel"), depth_files(r), M.depth_candidates(F.col("rel")))


def _paired(spark, sf, with_captions=True):
    r = rels(spark, sf)
    k = F.col("k")
    images = r.where(k % 10 != 0).select(F.col("rel").alias("path"))
    caps = r.where(k % 6 != 5).select(F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(".txt"))).otherwise(F.regexp_replace("rel", "jpg$", "txt")).alias("path"))
    return M.pairing(r.select("rel"), images, depth_files(r), caps if with_captions else None)


@query("pairing_report", f"""WITH {_PAIR} SELECT count(*) AS n_targets, count(*) FILTER (has_image) AS n_image, count(*) FILTER (has_depth) AS n_depth,
  count(*) FILTER (has_caption) AS n_caption, count(*) FILTER (has_image AND has_depth AND has_caption) AS n_paired FROM p""")
def pairing_report(spark, sf):
    return M.pairing_report(_paired(spark, sf))


@query("pairing_report_without_captions", f"""WITH {_PAIR} SELECT count(*) AS n_targets, count(*) FILTER (has_image) AS n_image, count(*) FILTER (has_depth) AS n_depth,
  cast(0 as bigint) AS n_caption, count(*) FILTER (has_image AND has_depth) AS n_paired FROM p""")
def pairing_report_without_captions(spark, sf):
    return M.pairing_report(_paired(spark, sf, False))


@query("pairing_examples", f"""WITH {_PAIR}, m AS (SELECT 'image' AS side, rel FROM p WHERE NOT has_image UNION ALL SELECT 'depth', rel FROM p WHERE NOT has_depth
  UNION ALL SELECT 'caption', rel FROM p WHERE NOT has_caption), r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY rel) AS rk FROM m) SELECT side, rel FROM r WHERE rk <= 12""")
def pairing_examples(spark, sf):
    return M.pairing_examples(_paired(spark, sf)).select("side", "rel")


_RES = "[concat('a/', k), concat('b/', k), concat('c/', k), concat('d/', k)]"


@query("resolved_references", f"""WITH {_REL}, u AS (SELECT rel, k, unnest({_RES}) AS path, unnest([0, 1, 2, 3]) AS pos FROM rels),
  f AS (SELECT *, CASE left(path, 1) WHEN 'a' THEN k % 2 = 0 WHEN 'b' THEN k % 3 = 0 ELSE k % 5 = 0 END AS there FROM u WHERE pos < 3)
  SELECT rel AS id, coalesce(string_agg(path, '|' ORDER BY pos) FILTER (there), '') AS found_images, coalesce(string_agg(path, '|' ORDER BY pos) FILTER (NOT there), '') AS missing_images,
  bool_or(there) AS usable FROM f GROUP BY 1""")
def resolved_references(spark, sf):
    r = rels(spark, sf)
    k = F.col("k")
    path = lambda p: F.concat(F.lit(p + "/"), k.cast("string"))
    samples = r.select(F.col("rel").alias("id"), F.array(*[path(p) for p in "abcd"]).alias("reference_images"))
    files = r.select(F.explode(F.array_compact(F.array(
        F.when(k % 2 == 0, path("a")), F.when(k % 3 == 0, path("b")), F.when(k % 5 == 0, path("c")), path("d")))).alias("path"))
    g = M.resolved_references(samples, files, 3)
    return g.select("id", F.array_join("found_images", "|").alias("found_images"), F.array_join("missing_images", "|").alias("missing_images"), "usable")


# -------------------------------------------------------------- placements

_PLACE = f"""{_BOXES}, img AS (SELECT id, bbox_index, CASE WHEN cast(quantity as bigint) % 5 = 0 THEN concat('ref/', id, '_', cast(bbox_index as varchar), '.png') END AS override,
  cast(quantity as bigint) % 3 <> 0 AS there FROM boxes)"""


@query("placement_candidates", f"""WITH {_PLACE} SELECT b.id, b.bbox_index, coalesce(i.override, concat(b.id, '/bbox', cast(b.bbox_index as varchar), '.jpg')) AS reference_image
  FROM boxes b JOIN img i ON b.id = i.id AND b.bbox_index = i.bbox_index WHERE b.found AND i.there""")
def placement_candidates(spark, sf):
    n = numbered(spark, sf)
    q = F.col("quantity").cast("long")
    meta = n.where(q % 5 == 0).select("id", "bbox_index", F.concat(F.lit("ref/"), "id", F.lit("_"), F.col("bbox_index").cast("string"), F.lit(".png")).alias("output_image"))
    images = n.where(q % 3 != 0).select(F.when(q % 5 == 0, F.concat(F.lit("ref/"), "id", F.lit("_"), F.col("bbox_index").cast("string"), F.lit(".png"))).otherwise(
        F.concat("id", F.lit("/bbox"), F.col("bbox_index").cast("string"), F.lit(".jpg"))).alias("path"))
    return M.placement_candidates(boxes(n), meta, images).select("id", "bbox_index", "reference_image")


@query("placement_candidates_scanned", f"""WITH {V.det_sql()}, {V.numbered_sql()}, a AS (SELECT {ID_OF_LINE} AS id, crop_no + 1 AS bbox_index, order_key % 7 <> 0 AS listed, found, line, quantity, x1, y1, x2, y2, class_name, label, confidence FROM numbered),
  c AS (SELECT *, line % 2 = 0 AS has_meta FROM a WHERE cast(quantity as bigint) % 3 <> 0 AND (NOT listed OR found)),
  d AS (SELECT *, CASE WHEN has_meta THEN greatest(0, (x2 - x1 - 5) * (y2 - y1)) ELSE 0 END AS own FROM c)
  SELECT id, bbox_index, round(CASE WHEN own <= 0 AND listed THEN greatest(0, (x2 - x1) * (y2 - y1)) ELSE own END, 6) AS bbox_area,
  CASE WHEN own <= 0 AND listed THEN coalesce(class_name, label) WHEN has_meta THEN coalesce('m', '') END AS object FROM d""")
def placement_candidates_scanned(spark, sf):
    n = numbered(spark, sf)
    q = F.col("quantity").cast("long")
    images = n.where(q % 3 != 0).select("id", "bbox_index", F.concat_ws("/", "id", "bbox_index").alias("path"))
    meta = n.where(F.col("line") % 2 == 0).select(
        "id", "bbox_index", F.array(F.col("x1") + 5, "y1", "x2", "y2").alias("source_bbox"), F.lit("m").alias("object"),
        F.lit(None).cast("string").alias("detected_label"), F.lit(0.5).alias("detection_score"))
    return M.placement_candidates_scanned(boxes(n), meta, images).select("id", "bbox_index", F.round("bbox_area", 6).alias("bbox_area"), "object")


@query("merged_layouts", f"""WITH {V.det_sql()} SELECT d.image_path, d.confidence, l.n FROM det d LEFT JOIN
  (SELECT image_path, count(*) AS n FROM det WHERE order_key % 2 = 0 GROUP BY 1) l ON d.image_path = l.image_path""")
def merged_layouts(spark, sf):
    d = V.detections(spark, sf, ["image_path", "confidence", "order_key"])
    layout = d.where("order_key % 2 = 0").groupBy("image_path").agg(F.count(F.lit(1)).alias("n"))
    return M.merged_layout(d, layout).select("image_path", "confidence", "n")


# ---------------------------------------------------------- shards and indexes

_IDX = f"{TI}, ix AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS row_index FROM theme_images)"


def indexed(spark, sf):
    """Ids in text order; 'theme3_000001234' is banded by its theme digit, then by its number."""
    t = V.order_view(spark, sf, "theme_images").select("id")
    bands = [X.theme_from_id(F.col("id")), F.floor(F.regexp_extract("id", r"_(\d+)$", 1).cast("long") / 4096)]
    return M.indexed(t, [F.asc("id")], bands)


@query("global_index", f"WITH {_IDX} SELECT id, row_index FROM ix")
def global_index(spark, sf):
    return indexed(spark, sf)


@query("modulo_shard", f"WITH {_IDX} SELECT id, row_index FROM ix WHERE row_index % 6 = 5")
def modulo_shard(spark, sf):
    return M.modulo_shard(indexed(spark, sf), 5, 6)


@query("modulo_shard_first", f"WITH {_IDX} SELECT id, row_index FROM ix WHERE row_index % 6 = 2 ORDER BY row_index LIMIT 40")
def modulo_shard_first(spark, sf):
    return M.modulo_shard(indexed(spark, sf), 2, 6).orderBy("row_index").limit(40)


@query("range_shards", f"WITH {_IDX}, t AS (SELECT row_index, ntile(7) OVER (ORDER BY row_index) - 1 AS shard FROM ix) SELECT cast(shard as int) AS shard, min(row_index) AS start, max(row_index) + 1 AS \"end\" FROM t GROUP BY 1")
def range_shards(spark, sf):
    return M.shard_bounds(M.range_shards(indexed(spark, sf), 7, total=V.table(spark, sf, "orders").count()))


@query("index_slice", f"WITH {_IDX} SELECT id, row_index FROM ix WHERE row_index >= 100 AND row_index < 260")
def index_slice(spark, sf):
    return M.index_slice(indexed(spark, sf), 100, 260)


@query("union_roots", f"WITH {V.det_sql()} SELECT root, count(*) AS n, count(DISTINCT image_path) AS n_images FROM det GROUP BY 1")
def union_roots(spark, sf):
    d = V.detections(spark, sf, ["image_path", "root"])
    parts = {r: d.where(F.col("root") == r).select("image_path") for r in ("small", "large")}
    u = M.union_roots(parts)
    return u.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("image_path").alias("n_images"))


@query("distinct_in_order", f"WITH {V.det_sql()} SELECT label, min(order_key) AS first_position FROM det GROUP BY 1")
def distinct_in_order(spark, sf):
    return M.distinct_in_order(V.detections(spark, sf, ["label", "order_key"]), "label", "order_key")


@query("stale_versions", """WITH r AS (SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC) AS rk FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) d)
  SELECT l_suppkey, l_orderkey AS step FROM r WHERE rk > 3""")
def stale_versions(spark, sf):
    v = V.table(spark, sf, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("step")).distinct()
    return M.stale_versions(v, 3, "l_suppkey")


# ---------------------------------------------------------- archives and captions

_MEM = f"{V.members_sql()}, vis AS (SELECT * FROM members WHERE member NOT LIKE '%.txt')"
_META = """meta AS (SELECT concat('images/', split_part(split_part(url, '/', 3), '.', 1), '/', cast(page_id as varchar), '.jpg') AS file_name, page_id AS line_no, url AS text FROM pages WHERE page_id % 4 <> 1
  UNION ALL SELECT concat('images/', split_part(split_part(url, '/', 3), '.', 1), '/', cast(page_id as varchar), '.jpg'), page_id + 1000000, concat('again ', url) FROM pages WHERE page_id % 10 = 0),
  cap AS (SELECT split_part(file_name, '/', 2) AS tar_stem, split_part(split_part(file_name, '/', 3), '.', 1) AS image_stem, max_by(text, line_no) AS caption FROM meta GROUP BY 1, 2)"""


def captions(spark, sf):
    p = V.table(spark, sf, "pages")
    name = F.expr("concat('images/', split_part(split_part(url, '/', 3), '.', 1), '/', cast(page_id as string), '.jpg')")
    first = p.where("page_id % 4 <> 1").select(name.alias("file_name"), F.col("page_id").alias("line_no"), F.col("url").alias("text"))
    again = p.where("page_id % 10 = 0").select(name.alias("file_name"), (F.col("page_id") + 1000000).alias("line_no"), F.concat(F.lit("again "), "url").alias("text"))
    bad = p.select(F.lit("lonely.jpg").alias("file_name"), F.col("page_id").alias("line_no"), F.lit("x").alias("text"))
    return M.last_captions(first.unionByName(again).unionByName(bad))


@query("last_captions", f"WITH {_META} SELECT * FROM cap")
def last_captions(spark, sf):
    return captions(spark, sf)


def visible(spark, sf):
    return V.members(spark, sf).where(X.is_image_member(F.col("member")))


@query("image_members", f"WITH {_MEM} SELECT tar_stem, member FROM vis")
def image_members(spark, sf):
    return visible(spark, sf).select("tar_stem", "member")


@query("captioned_members", f"WITH {_MEM}, {_META} SELECT v.tar_stem, v.image_stem, coalesce(c.caption, '') AS caption FROM vis v LEFT JOIN cap c ON v.tar_stem = c.tar_stem AND v.image_stem = c.image_stem")
def captioned_members(spark, sf):
    return M.captioned_members(visible(spark, sf), captions(spark, sf)).select("tar_stem", "image_stem", "caption")


@query("captioned_members_only", f"WITH {_MEM}, {_META} SELECT v.tar_stem, v.image_stem, c.caption FROM vis v JOIN cap c ON v.tar_stem = c.tar_stem AND v.image_stem = c.image_stem")
def captioned_members_only(spark, sf):
    return M.captioned_members(visible(spark, sf), captions(spark, sf), False).select("tar_stem", "image_stem", "caption")


def _quota_sql(per, total):
    return f"""WITH {_MEM}, r AS (SELECT tar_stem, member_no, row_number() OVER (PARTITION BY tar_stem ORDER BY member_no) AS archive_rank FROM vis),
  k AS (SELECT *, row_number() OVER (ORDER BY tar_stem, archive_rank) AS g FROM r WHERE archive_rank <= {per}) SELECT tar_stem, member_no, archive_rank FROM k WHERE g <= {total}"""


@query("archive_quota", _quota_sql(5, 60))
def archive_quota(spark, sf):
    q = M.archive_quota(visible(spark, sf), 5, 60)
    return q.select("tar_stem", "member_no", F.col("archive_rank").cast("long").alias("archive_rank"))


@query("archive_quota_total_only", _quota_sql(10**6, 150))
def archive_quota_total_only(spark, sf):
    q = M.archive_quota(visible(spark, sf), None, 150)
    return q.select("tar_stem", "member_no", F.col("archive_rank").cast("long").alias("archive_rank"))


@query("archive_quota_large", _quota_sql(4000, 3000))
def archive_quota_large(spark, sf):
    """A quota beyond the map-side limit, so members are numbered in bands."""
    q = M.archive_quota(visible(spark, sf), 4000, 3000)
    return q.select("tar_stem", "member_no", F.col("archive_rank").cast("long").alias("archive_rank"))


@query("run_counters", f"""WITH {TI}, {CV}, s AS (SELECT CASE WHEN trim(coalesce(prompt, '')) = '' THEN 'failed' WHEN c.id IS NOT NULL THEN 'skipped' ELSE 'pending' END AS status
  FROM theme_images i LEFT JOIN canvas c ON i.id = c.id) SELECT 'generate' AS stage, status, count(*) AS n FROM s GROUP BY 2""")
def run_counters(spark, sf):
    s = M.prompt_status(V.order_view(spark, sf, "theme_images"), V.order_view(spark, sf, "canvas"), "prompt")
    return Q.run_counters(s.withColumn("stage", F.lit("generate")))


def _depth_sql(rule):
    src = "v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS d, unnest(range(len(embedding))) AS i FROM embeddings)"
    if rule == "minmax":
        return f"""WITH {src}, b AS (SELECT vec_id, min(d) AS lo, max(d) AS hi FROM v GROUP BY 1)
  SELECT v.vec_id, i, CASE WHEN hi - lo < 1e-8 THEN 0 ELSE cast(trunc((d - lo) / (hi - lo) * 65535.0::DOUBLE) as int) END AS depth_u16 FROM v JOIN b ON v.vec_id = b.vec_id"""
    return f"""WITH {src}, b AS (SELECT vec_id, quantile_cont(d, 0.02) AS lo, quantile_cont(d, 0.98) AS hi FROM v GROUP BY 1)
  SELECT v.vec_id, i, cast(round_even(greatest(0, least(1, (d - lo) / (hi - lo))) * 65535.0::DOUBLE, 0) as int) AS depth_u16 FROM v JOIN b ON v.vec_id = b.vec_id"""


def _depth(spark, sf, rule):
    e = V.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "d"))
    return Q.depth_scaled(e, "vec_id", "d", rule)


@query("depth_minmax", _depth_sql("minmax"))
def depth_minmax(spark, sf):
    return _depth(spark, sf, "minmax").select("vec_id", F.col("i").cast("long").alias("i"), "depth_u16")


@query("depth_percentile", _depth_sql("percentile"))
def depth_percentile(spark, sf):
    return _depth(spark, sf, "percentile").select("vec_id", F.col("i").cast("long").alias("i"), "depth_u16")
