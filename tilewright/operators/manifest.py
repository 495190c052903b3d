"""Joins between artifact tables: manifest assembly, pairing, resume and shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright import constants as K
from tilewright.functions import geometry as G
from tilewright.functions import text as X
from tilewright.functions.draws import int_div, let
from tilewright.functions.truthy import truthy_coalesce
from tilewright.operators.ranking import (
    GROUP_LIMIT, HOT_ROWS, first_per_key, global_ordinal, ordered_lists, ordinal,
)
from tilewright.operators.selection import up_to_rank, values_at_ranks


# ------------------------------------------------------------------ references

def reference_index(df: DataFrame, index_col: str = "bbox_index", stem_col: str = "stem") -> DataFrame:
    """``bbox_index`` from its field, else from the digits of a ``bboxN`` file stem."""
    digits = F.regexp_extract(F.col(stem_col), r"^bbox(\d+)$", 1)
    return df.withColumn(index_col, F.coalesce(F.col(index_col), F.when(digits != "", digits.cast("int"))))


def exploded_boxes(bbox_meta: DataFrame, objects: str = "objects", key: str = "id") -> DataFrame:
    """One row per box entry with a one-based index."""
    return bbox_meta.select(key, F.posexplode(objects).alias("__pos", "box")).select(
        key, (F.col("__pos") + 1).alias("bbox_index"), "box.*"
    )


def matched_references(refs: DataFrame, boxes: DataFrame, key: str = "id") -> DataFrame:
    """References joined to the N-th box of their sample; falsy fields fall back to the box.

    An index outside the box list simply finds no partner.
    """
    side = boxes.select(
        key, "bbox_index", F.col("object").alias("__object"), F.col("label").alias("__label"),
        F.col("score").alias("__score"), F.col("bbox").alias("__bbox"), F.col("bbox_norm").alias("source_bbox_norm"),
    )
    j = refs.join(side, [key, "bbox_index"], "left")
    fallback = F.concat(F.lit("bbox"), F.col("bbox_index").cast("string"), F.lit(".jpg"))
    sidecar = F.col("metadata") if "metadata" in refs.columns else F.lit(None).cast("string").alias("metadata")
    return j.select(
        key, "bbox_index",
        truthy_coalesce("string", F.col("object"), F.col("__object")).alias("object"),
        truthy_coalesce("string", F.col("detected_label"), F.col("__label")).alias("detected_label"),
        truthy_coalesce("double", F.col("detection_score"), F.col("__score")).alias("detection_score"),
        truthy_coalesce("array", F.col("source_bbox"), F.col("__bbox")).alias("source_bbox"),
        "source_bbox_norm",
        truthy_coalesce("string", F.col("output_image"), fallback).alias("image"),
        sidecar, "seed", "model_id",
    )


def reference_lists(matched: DataFrame, key: str = "id") -> DataFrame:
    """One ordered reference list per sample (a missing index sorts as 0)."""
    fields = [c for c in matched.columns if c != key]
    indexed = matched.withColumn("__at", F.coalesce(F.col("bbox_index"), F.lit(0)))
    listed = ordered_lists(indexed, [key], "__at", fields, "reference_images")
    return listed.withColumn("reference_images", F.transform("reference_images", lambda r: r.dropFields("__at")))


# -------------------------------------------------------------------- manifest

def assemble_manifest(
    theme_images: DataFrame, theme_prompts: DataFrame, boxes: DataFrame, canvas: DataFrame, depth: DataFrame,
    references: DataFrame, require_complete: bool = False, key: str = "id", nested: bool = True,
) -> DataFrame:
    """One record per sample from all artifact tables, of the same form at every size.

    Theme image, box and depth tables are required, their images too; the others
    are optional unless ``require_complete``, which also wants every stored path
    and a reference. All sides are hashed on the same key, so the chain reuses one
    partitioning; tables bucketed on it need no exchange at all.

    ``references`` is the keyed table of :func:`matched_references`. ``nested``
    puts a sample's references into its record as a list, which is one value of one
    row; without it the record holds ``n_references`` and the keyed table remains
    the place of the references, for samples of any size.
    """
    optional = "inner" if require_complete else "left"
    if nested:
        listed = reference_lists(references, key)
        refs = listed.withColumn("n_references", F.size("reference_images").cast("long"))
    else:
        refs = references.groupBy(key).agg(F.count(F.lit(1)).alias("n_references"))
    pack = lambda df, name: df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))
    j = (
        pack(theme_images, "ti")
        .join(pack(boxes, "bb"), key)
        .join(pack(depth, "dp"), key)
        .join(pack(theme_prompts, "tp"), key, optional)
        .join(pack(canvas, "cv"), key, optional)
        .join(refs, key, optional)
    )
    has = {n: set(df.columns) for n, df in
           (("ti", theme_images), ("tp", theme_prompts), ("bb", boxes), ("dp", depth), ("cv", canvas))}

    def at(path: str, cast: str) -> Column:
        side, field = path.split(".")
        return F.col(path) if field in has[side] else F.lit(None).cast(cast)

    def first(kind: str, cast: str, *paths: str) -> Column:
        return truthy_coalesce(kind, *[at(p, cast) for p in paths])

    def listed_from(*paths: str) -> Column:
        """First filled list, else the empty list of the same type."""
        kinds = [j.select(p).schema[0].dataType for p in paths if p.split(".")[1] in has[p.split(".")[0]]]
        kind = kinds[0] if kinds else "array<string>"
        lists = [truthy_coalesce("array", *[F.col(p) for p in paths if p.split(".")[1] in has[p.split(".")[0]]])] if kinds else []
        return F.coalesce(*lists, F.array().cast(kind))

    stored = ["ti.gt_image", "dp.image"]
    if require_complete:
        stored += ["dp.raw", "dp.metadata", "cv.image", "cv.metadata"]
    for path in stored:
        if path.split(".")[1] in has[path.split(".")[0]]:
            j = j.where(F.col(path).isNotNull())
    own_list = []
    if nested:
        own_list = [F.coalesce("reference_images", F.array().cast(refs.schema["reference_images"].dataType)).alias("reference_images")]
    return j.select(
        key,
        truthy_coalesce("string", at("ti.theme", "string"), at("tp.theme", "string"), X.theme_from_id(F.col(key))).alias("theme"),
        first("string", "string", "ti.prompt", "tp.combined_prompt", "tp.prompt").alias("caption"),
        first("string", "string", "ti.structured_prompt", "tp.structured_prompt").alias("structured_prompt"),
        first("int", "int", "ti.num_objects", "tp.num_objects").alias("num_objects"),
        listed_from("ti.objects", "tp.objects").alias("objects"),
        listed_from("ti.object_details", "tp.object_details").alias("object_details"),
        at("ti.gt_image", "string").alias("gt_image"),
        at("cv.image", "string").alias("canvas_image"),
        at("dp.image", "string").alias("depth_image"),
        at("dp.raw", "string").alias("depth_raw"),
        first("int", "int", "ti.gen_width", "bb.image_width", "dp.image_width").alias("image_width"),
        first("int", "int", "ti.gen_height", "bb.image_height", "dp.image_height").alias("image_height"),
        F.struct(*[at(f"ti.{c}", t).alias(c) for c, t in (
            ("seed", "bigint"), ("guidance_scale", "double"), ("num_inference_steps", "int"), ("model_id", "string"))]).alias("generation"),
        at("bb.bbox_information", "array<string>").alias("bbox_annotations"),
        F.struct(*[at(f"cv.{c}", t).alias(c) for c, t in (
            ("image", "string"), ("metadata", "string"), ("num_placements", "int"), ("placements", "array<string>"))]).alias("canvas"),
        F.struct(*[at(f"dp.{c}", t).alias(c) for c, t in (
            ("image", "string"), ("raw", "string"), ("metadata", "string"), ("depth_type", "string"),
            ("model_id", "string"), ("depth_min", "double"), ("depth_max", "double"))]).alias("depth"),
        F.coalesce("n_references", F.lit(0)).alias("n_references"),
        *own_list,
        F.struct(*[at(f"{side}.metadata", "string").alias(name) for side, name in (
            ("tp", "theme_prompt"), ("ti", "theme_metadata"), ("bb", "bbox_metadata"))]).alias("source_files"),
    )


def normalized_records(raw: DataFrame) -> DataFrame:
    """Flat training records: nested image paths as fallback, captions trimmed, sizes defaulting to 0."""
    text = lambda *cols: F.coalesce(truthy_coalesce("string", *cols), F.lit(""))
    size = lambda c: F.coalesce(F.expr(f"try_cast({c} AS int)"), F.lit(0))
    return raw.select(
        F.coalesce(F.col("id"), F.lit("")).alias("id"),
        X.strip(text(F.col("caption"))).alias("caption"),
        text(F.col("gt_image")).alias("gt_image"),
        text(F.col("canvas_image"), F.col("canvas.image")).alias("canvas_image"),
        text(F.col("depth_image"), F.col("depth.image")).alias("depth_image"),
        size("image_width").alias("image_width"),
        size("image_height").alias("image_height"),
    )


def with_drop_reason(records: DataFrame, files: DataFrame, file_col: str = "path") -> DataFrame:
    """``drop_reason`` by first failed test; null for valid records.

    ``files`` lists existing files once each. The three paths are unfolded and
    joined in one shuffle instead of three.
    """
    cols = ["gt_image", "canvas_image", "depth_image"]
    known = files.select(F.col(file_col).alias("__path")).distinct().withColumn("__there", F.lit(1))
    asked = records.select("id", F.explode(F.array(*cols)).alias("__path")).where(F.col("__path") != "").distinct()
    lacking = (
        asked.join(known, "__path", "left").where(F.col("__there").isNull())
        .select("id").distinct().withColumn("__lacks", F.lit(True))
    )
    reason = (
        F.when(F.col("caption") == "", "missing_caption")
        .when(F.col("gt_image") == "", "missing_gt")
        .when(F.col("canvas_image") == "", "missing_canvas")
        .when(F.col("depth_image") == "", "missing_depth")
        .when(F.coalesce("__lacks", F.lit(False)), "missing_file")
    )
    return records.join(lacking, "id", "left").withColumn("drop_reason", reason).drop("__lacks")


def drop_reason_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def prompt_status(df: DataFrame, done: DataFrame, prompt_col: str = "combined_prompt", key: str = "id") -> DataFrame:
    """failed when the prompt is missing, before anything else; skipped when done; else pending."""
    prompt = X.strip(F.coalesce(F.col(prompt_col), F.lit("")))
    known = done.select(key).distinct().withColumn("__done", F.lit(True))
    status = F.when(prompt == "", "failed").when(F.coalesce("__done", F.lit(False)), "skipped").otherwise("pending")
    return df.join(known, key, "left").withColumn("status", status).drop("__done")


# ---------------------------------------------------------------------- resume

def pending(work: DataFrame, *outputs: DataFrame, key: str | Sequence[str] = "id") -> DataFrame:
    """Work whose outputs do not all exist yet.

    A sample is done when its key is in every output table; outputs are
    intersected on the key and anti-joined.
    """
    keys = [key] if isinstance(key, str) else list(key)
    done = outputs[0].select(*keys)
    for extra in outputs[1:]:
        done = done.join(extra.select(*keys), keys, "left_semi")
    return work.join(done, keys, "left_anti")


def pending_views(crops: DataFrame, views: DataFrame, count: int, keys: Sequence[str] = ("stem", "crop_no")) -> DataFrame:
    """Views 1…count still missing per crop; crops with none missing disappear."""
    keys = list(keys)
    # Only wanted view numbers are collected, so a set holds at most ``count`` values.
    there = (
        views.where(F.col("view").between(1, count)).groupBy(*keys).agg(F.collect_set("view").alias("__have"))
    )
    wanted = F.sequence(F.lit(1), F.lit(count))
    have = F.coalesce("__have", F.array().cast("array<int>"))
    return (
        crops.join(there, keys, "left")
        .withColumn("pending", F.array_except(wanted, have)).drop("__have")
        .where(F.size("pending") > 0)
    )


def missing_view_rows(crops: DataFrame, views: DataFrame, count: int, keys: Sequence[str] = ("stem", "crop_no")) -> DataFrame:
    """Row form: wanted (crop, view) pairs without a file."""
    keys = list(keys)
    wanted = crops.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(count))).alias("view"))
    return wanted.join(views.select(*keys, "view"), [*keys, "view"], "left_anti")


# ------------------------------------------------------------------ asset joins

def caption_keys(df: DataFrame, name_col: str = "file_name") -> DataFrame:
    """(tar_stem, image_stem) from ``images/<tar>/<file>`` or ``…/<tar>/<file>``; other rows drop."""
    parts = X.path_parts(F.col(name_col))
    n = F.size(parts)
    tar = (
        F.when((n >= 3) & (F.try_element_at(parts, F.lit(1)) == "images"), F.try_element_at(parts, F.lit(2)))
        .when(n >= 2, F.try_element_at(parts, F.lit(-2)))
    )
    base = (
        F.when((n >= 3) & (F.try_element_at(parts, F.lit(1)) == "images"), F.try_element_at(parts, F.lit(3)))
        .when(n >= 2, F.try_element_at(parts, F.lit(-1)))
    )
    keyed = df.withColumn("tar_stem", tar).withColumn("image_stem", X.file_stem(base))
    return keyed.where(F.col("tar_stem").isNotNull())


def last_captions(meta: DataFrame, line_col: str = "line_no", text_col: str = "text") -> DataFrame:
    """Caption per (tar, image); the last line wins. An aggregate, so it combines before the shuffle."""
    keyed = caption_keys(meta)
    return keyed.groupBy("tar_stem", "image_stem").agg(
        F.max_by(F.coalesce(F.col(text_col), F.lit("")), F.col(line_col)).alias("caption")
    )


def captioned_members(members: DataFrame, captions: DataFrame, keep_uncaptioned: bool = True) -> DataFrame:
    """Archive members with caption text; without one: empty text, or dropped."""
    j = members.join(captions, ["tar_stem", "image_stem"], "left")
    if keep_uncaptioned:
        return j.withColumn("caption", F.coalesce("caption", F.lit("")))
    return j.where(F.col("caption").isNotNull())


def depth_candidates(rel: Column) -> Column:
    """Possible depth files for an image, best first, relative to the depth folder."""
    def listed(p: Column) -> Column:
        flat = [F.concat(p["stem"], F.lit(e)) for e in K.DEPTH_ASSET_SUFFIXES]
        nested = [F.when(p["parent"] != "", F.concat(p["parent"], F.lit("/"), p["stem"], F.lit(e))) for e in K.DEPTH_ASSET_SUFFIXES]
        return F.array_distinct(F.array_compact(F.array(*flat, *nested, p["name"], p["rel"])))

    return let(_path_pieces(rel), listed)


def caption_candidates(rel: Column) -> Column:
    return let(_path_pieces(rel), lambda p: F.array_distinct(F.array_compact(F.array(
        F.concat(p["stem"], F.lit(".txt")),
        F.when(p["parent"] != "", F.concat(p["parent"], F.lit("/"), p["stem"], F.lit(".txt"))),
    ))))


def _path_pieces(rel: Column) -> Column:
    return F.struct(
        X.file_stem(rel).alias("stem"), X.parent_dir(rel).alias("parent"), X.file_name(rel).alias("name"), rel.alias("rel"))


def resolve_assets(rels: DataFrame, files: DataFrame, candidates: Column, rel_col: str = "rel", name: str = "asset") -> DataFrame:
    """First existing candidate per image, null when none exists.

    Listings grow with the images, and their compressed size says little about their size as a hash table. So they are
    merged, never broadcast: several broadcasts of them at once do not fit the driver.
    """
    asked = rels.select(rel_col, F.posexplode(candidates).alias("__pos", "__path"))
    hit = (
        asked.join(files.select(F.col("path").alias("__path")).distinct().hint("merge"), "__path")
        .groupBy(rel_col).agg(F.min_by("__path", "__pos").alias(name))
    )
    return rels.join(hit.hint("merge"), rel_col, "left")


def pairing(rels: DataFrame, images: DataFrame, depth: DataFrame | None, captions: DataFrame | None, rel_col: str = "rel") -> DataFrame:
    """Existence of image, depth and caption per target; an absent side counts as satisfied."""
    col = F.col(rel_col)
    known = images.select(F.col("path").alias(rel_col)).distinct().withColumn("has_image", F.lit(True))
    out = rels.join(known.hint("merge"), rel_col, "left").withColumn("has_image", F.coalesce("has_image", F.lit(False)))
    for side, files, cands in (("depth", depth, depth_candidates(col)), ("caption", captions, caption_candidates(col))):
        if files is None:
            out = out.withColumn(f"has_{side}", F.lit(None).cast("boolean"))
            continue
        asset = resolve_assets(rels, files, cands, rel_col, f"{side}_asset")
        out = out.join(asset.hint("merge"), rel_col).withColumn(f"has_{side}", F.col(f"{side}_asset").isNotNull()).drop(f"{side}_asset")
    ok = F.col("has_image") & F.coalesce("has_depth", F.lit(True)) & F.coalesce("has_caption", F.lit(True))
    return out.withColumn("paired", ok)


def pairing_report(paired: DataFrame) -> DataFrame:
    t = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return paired.agg(
        F.count(F.lit(1)).alias("n_targets"), t("has_image").alias("n_image"), t("has_depth").alias("n_depth"),
        t("has_caption").alias("n_caption"), t("paired").alias("n_paired"),
    )


def pairing_examples(paired: DataFrame, rel_col: str = "rel", n: int = 12) -> DataFrame:
    """At most ``n`` missing targets per side."""
    sides = ["image", "depth", "caption"]
    lost = F.filter(
        F.array(*[F.when(~F.col(f"has_{s}"), F.lit(s)) for s in sides]), lambda s: s.isNotNull()
    )
    rows = paired.select(F.explode(lost).alias("side"), rel_col)
    return first_per_key(rows, ["side"], [F.asc(rel_col)], n, "example_no")


def resolved_references(samples: DataFrame, files: DataFrame, n: int, key: str = "id", col: str = "reference_images") -> DataFrame:
    """First ``n`` reference images per sample, split into found and missing; ``usable`` needs one found."""
    asked = samples.select(key, F.posexplode_outer(F.slice(F.col(col), 1, n)).alias("pos", "path"))
    known = files.select("path").distinct().withColumn("__there", F.lit(True))
    j = asked.join(known, "path", "left")
    there = F.coalesce("__there", F.lit(False))
    pair = F.struct("pos", "path")
    g = j.groupBy(key).agg(  # at most n items per sample
        F.sort_array(F.collect_list(F.when(there, pair))).alias("f"),
        F.sort_array(F.collect_list(F.when(~there & F.col("path").isNotNull(), pair))).alias("m"),
    )
    return g.select(
        key, F.transform("f", lambda s: s["path"]).alias("found_images"),
        F.transform("m", lambda s: s["path"]).alias("missing_images"), (F.size("f") > 0).alias("usable"),
    )


# ------------------------------------------------------------------ placements

def placement_candidates(boxes: DataFrame, refs: DataFrame, images: DataFrame, key: str = "id") -> DataFrame:
    """Found boxes with an existing reference image; metadata may override the default path.

    ``boxes`` (key, bbox_index, found, bbox, object, label, score), ``refs``
    (key, bbox_index, output_image) and ``images`` (path) are equi-joined.
    """
    default = F.concat(F.col(key), F.lit("/bbox"), F.col("bbox_index").cast("string"), F.lit(".jpg"))
    usable = boxes.where(F.coalesce("found", F.lit(False)) & F.col("bbox").isNotNull() & (F.size("bbox") > 0))
    meta = refs.select(key, "bbox_index", F.col("output_image").alias("__override"))
    named = usable.join(meta, [key, "bbox_index"], "left").withColumn(
        "reference_image", truthy_coalesce("string", F.col("__override"), default)
    ).drop("__override")
    known = images.select(F.col("path").alias("reference_image")).distinct()
    return named.join(known, "reference_image", "left_semi")


def placement_candidates_scanned(
    boxes: DataFrame, refs: DataFrame, images: DataFrame, key: str = "id"
) -> DataFrame:
    """Variant that trusts reference metadata first and scans image files for samples without boxes.

    ``images`` is (key, bbox_index, path). Area comes from the reference's box,
    else from the detected one.
    """
    listed = boxes.where(F.coalesce("found", F.lit(True))).select(
        key, "bbox_index", F.col("bbox").alias("__bbox"), F.col("object").alias("__object"),
        F.col("label").alias("__label"), F.col("score").alias("__score"),
    )
    nulls = {c: t for c, t in (("__bbox", "array<double>"), ("__object", "string"), ("__label", "string"), ("__score", "double"))}
    scanned = (
        images.join(boxes.select(key).distinct(), key, "left_anti").select(key, "bbox_index")
        .select("*", *[F.lit(None).cast(t).alias(c) for c, t in nulls.items()])
    )
    meta = refs.select(
        key, "bbox_index", F.col("source_bbox").alias("__rbox"), F.col("object").alias("__robject"),
        F.col("detected_label").alias("__rlabel"), F.col("detection_score").alias("__rscore"),
    )
    j = listed.unionByName(scanned).join(images, [key, "bbox_index"]).join(meta, [key, "bbox_index"], "left")
    area = lambda b: F.when(F.size(b) == 4, G.product_clamped_area(b[0], b[1], b[2], b[3])).otherwise(0.0)
    own = F.coalesce(area(F.col("__rbox")), F.lit(0.0))
    step = j.withColumn("__own", own)
    use_box = (F.col("__own") <= 0) & F.col("__bbox").isNotNull()
    box = F.when(use_box, truthy_coalesce("array", F.col("__bbox"), F.col("__rbox"))).otherwise(F.col("__rbox"))
    label = F.when(
        use_box, truthy_coalesce("string", F.col("__object"), F.col("__label"), F.col("__robject"), F.col("__rlabel"))
    ).otherwise(truthy_coalesce("string", F.col("__robject"), F.col("__rlabel")))
    score = F.when(use_box, truthy_coalesce("double", F.col("__score"), F.col("__rscore"))).otherwise(F.col("__rscore"))
    return step.select(
        key, "bbox_index", F.col("path").alias("reference_image"), label.alias("object"),
        score.alias("detection_score"), box.alias("source_bbox"),
        F.when(use_box, F.coalesce(area(F.col("__bbox")), F.lit(0.0))).otherwise(F.col("__own")).alias("bbox_area"),
    )


def merged_layout(rows: DataFrame, layout: DataFrame, on: str = "image_path") -> DataFrame:
    """Layout columns added by image path; rows without a layout stay."""
    return rows.join(layout, on, "left")


# ------------------------------------------------------- sets, shards, retention

def union_roots(roots: dict[str, DataFrame]) -> DataFrame:
    """Several dataset roots as one table with a ``root`` column."""
    out = None
    for name, df in roots.items():
        part = df.withColumn("root", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def distinct_in_order(df: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct keys with the position of their first appearance."""
    return df.groupBy(key).agg(F.min(position).alias("first_position"))


def discovered_ids(*tables: DataFrame, key: str = "id") -> DataFrame:
    """Distinct sample ids found in any of the tables."""
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.union(t.select(key))
    return out.distinct()


def indexed(df: DataFrame, order: Sequence[Column], bands: Sequence[Column], name: str = "row_index") -> DataFrame:
    return global_ordinal(df, order, bands, name)


def modulo_shard(indexed_df: DataFrame, shard_id: int, num_shards: int, index_col: str = "row_index") -> DataFrame:
    """Rows whose index falls on one shard; an id outside the range is an error."""
    if not 0 <= shard_id < num_shards:
        raise ValueError(f"shard {shard_id} is outside 0…{num_shards - 1}")
    return indexed_df.where(F.pmod(F.col(index_col), F.lit(num_shards)) == shard_id)


def range_shards(
    indexed_df: DataFrame, num_shards: int, index_col: str = "row_index", total: Column | int | None = None
) -> DataFrame:
    """Contiguous shard number per row; the first ``n mod k`` shards hold one row more.

    ``total`` is the number of rows where it is known; otherwise it is counted.
    """
    if num_shards < 1:
        raise ValueError("num_shards must be positive")
    n = indexed_df.agg(F.count(F.lit(1))).scalar() if total is None else (
        total if isinstance(total, Column) else F.lit(total)
    )
    i, k = F.col(index_col), F.lit(num_shards)
    small, extra = int_div(n, k), F.pmod(n, k)
    edge = extra * (small + 1)
    shard = F.when(i < edge, int_div(i, small + 1)).otherwise(
        extra + int_div(i - edge, F.greatest(small, F.lit(1)))
    )
    return indexed_df.withColumn("shard", shard.cast("int"))


def shard_bounds(sharded: DataFrame, index_col: str = "row_index") -> DataFrame:
    """Half-open index range per shard."""
    return sharded.groupBy("shard").agg(F.min(index_col).alias("start"), (F.max(index_col) + 1).alias("end"))


def index_slice(indexed_df: DataFrame, start: int = 0, end: int | None = None, index_col: str = "row_index") -> DataFrame:
    """Rows of an index range, clamped to the table."""
    start = max(0, start)
    if end is not None and end < start:
        raise ValueError("end lies before start")
    out = indexed_df.where(F.col(index_col) >= start)
    return out if end is None else out.where(F.col(index_col) < end)


def first_per_category(
    df: DataFrame, n: int, order_col: str, category: str = "category", hot_rows: int = HOT_ROWS, bands: int = 64,
) -> DataFrame:
    """First ``n`` rows per category in ascending order (nulls first), with their one-based rank.

    Small ``n`` is limited in the map tasks. For a large ``n`` over a number column
    the ``n``-th value of every category is selected first (no sort, no shuffle of
    rows); only rows up to it are numbered, those of a hot category in bands.
    """
    kind = dict(df.dtypes)[order_col]
    number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double")
    if n <= GROUP_LIMIT or not number:
        return first_per_key(df, [category], [F.asc(order_col)], n, "category_rank")
    top = up_to_rank(df, [category], order_col, n).withColumnRenamed(category, "__of")
    at = F.col(order_col)
    j = df.join(top, F.col(category).eqNullSafe(F.col("__of")), "left").where(at.isNull() | (at <= F.col("__nth")))
    span = F.col("__nth").cast("double") - F.col("__least").cast("double")
    share = (at.cast("double") - F.col("__least").cast("double")) / span * bands
    even = (span > 0) & (span < float("inf"))
    j = j.withColumn("__band", F.when(at.isNull(), -1).when(even, F.floor(share)).otherwise(0).cast("long"))
    numbered = ordinal(j, [category], [F.asc(order_col)], F.col("__band"), "category_rank", 1, hot_rows)
    return numbered.where(F.col("category_rank") <= n).select(*df.columns, "category_rank")


def archive_quota(
    members: DataFrame, per_archive: int | None, total: int | None, archive: str = "tar_stem",
    order_col: str = "member_no", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Members up to a quota per archive and in all, archives in name order.

    ``order_col`` is the member's number inside its archive. The grand total is
    spread with archive counts only; the table of archives is the one thing a
    single task sees.
    """
    limit = F.lit(per_archive if per_archive is not None else 2**62)
    sizes = members.groupBy(archive).agg(F.count(F.lit(1)).alias("__n"))
    take = F.least(F.col("__n"), limit)
    if total is None:
        quota = sizes.select(archive, take.alias("__quota"))
    else:
        before = F.coalesce(
            F.sum(take).over(Window.orderBy(archive).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )
        quota = sizes.select(archive, F.greatest(F.lit(0), F.least(take, F.lit(total) - before)).alias("__quota"))
    bound = min(x for x in (per_archive, total, 2**62) if x is not None)
    if bound <= GROUP_LIMIT:
        ranked = first_per_key(members, [archive], [F.asc(order_col)], bound, "archive_rank")
    else:
        band = int_div(F.col(order_col), 4096)
        ranked = ordinal(members, [archive], [F.asc(order_col)], band, "archive_rank", 1, hot_rows)
    return ranked.join(quota, archive).where(F.col("archive_rank") <= F.col("__quota")).drop("__quota")


def stale_versions(versions: DataFrame, keep: int, key: str, step_col: str = "step") -> DataFrame:
    """Versions beyond the ``keep`` newest per key.

    The step of the oldest version to keep is found first (a bounded top-k, or for
    a large ``keep`` by counting leading bits), then everything older is listed; no
    key is ever ranked in full.
    """
    if keep > GROUP_LIMIT:
        oldest = lambda total: F.array(F.struct((total - keep).alias("r"), F.lit(0).alias("tag")))
        floor = values_at_ranks(versions, step_col, oldest, [key]).select(key, F.col("value").alias("__floor"))
        return versions.join(floor, key).where(F.col(step_col) < F.col("__floor")).drop("__floor")
    top = first_per_key(versions.select(key, step_col), [key], [F.desc(step_col)], keep, "__r")
    floor = top.where(F.col("__r") == keep).select(key, F.col(step_col).alias("__floor"))
    return versions.join(floor, key).where(F.col(step_col) < F.col("__floor")).drop("__floor")
