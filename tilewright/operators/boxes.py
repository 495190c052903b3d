"""Detection tables: filters, running numbers, layout and size statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright import constants as K
from tilewright.functions import geometry as G
from tilewright.functions import text as X
from tilewright.functions.draws import draw_below, draw_digest, draw_int_between, draw_unit
from tilewright.operators.ranking import (
    HOT_ROWS, ordered_lists, digest_band, falling_band, first_per_key, hot_keys, mark_hot, ordinal,
)
from tilewright.operators.selection import exact_percentiles

CORNERS = ["x1", "y1", "x2", "y2"]
SCORE_BANDS = 1000


def box_order(score: str = "confidence") -> list[Column]:
    return [F.desc(score), *[F.asc(c) for c in CORNERS]]


def score_band(score: str = "confidence") -> Column:
    """Rises as the score falls; splits a hot image for :func:`ordinal`."""
    return falling_band(F.col(score), SCORE_BANDS)


# --------------------------------------------------------------------- filters

def parsed_boxes(raw: DataFrame, image_col: str = "image_path") -> DataFrame:
    """Rows with an image key and four numeric corners that span a positive box."""
    typed = raw.select(
        *[
            F.expr(f"try_cast({c} AS double)").alias(c) if c in (*CORNERS, "confidence") else F.col(c)
            for c in raw.columns
        ]
    )
    typed = typed.withColumn(image_col, X.strip(F.col(image_col)))
    ok = F.col(image_col) != ""
    for c in CORNERS:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return typed.where(ok & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def large_boxes(df: DataFrame, min_side: float) -> DataFrame:
    """Both sides strictly above ``min_side`` (0 keeps the positive boxes)."""
    return df.where((F.col("x2") - F.col("x1") > min_side) & (F.col("y2") - F.col("y1") > min_side))


def detection_status(df: DataFrame, min_score: float) -> DataFrame:
    """``skip_reason`` per box; null for boxes to use. A missing score passes."""
    return df.withColumn(
        "skip_reason",
        F.when(~F.coalesce("found", F.lit(False)), "not_found")
        .when(F.coalesce(F.col("score") < min_score, F.lit(False)), "low_score")
        .when(F.col("bbox").isNull() | (F.size("bbox") == 0), "missing_bbox"),
    )


# ------------------------------------------------------------- running numbers

def crop_numbers(
    df: DataFrame, image_col: str = "image_path", match_side: float = K.LARGE_SIDE, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``crop_no`` per image by falling confidence, ``mv_crop_no`` counting large boxes only.

    Both numbers come from one sort per band. For the second, large boxes are
    numbered among themselves.
    """
    big = (F.col("x2") - F.col("x1") > match_side) & (F.col("y2") - F.col("y1") > match_side)
    return _two_ordinals(df, image_col, big, hot_rows)


def _two_ordinals(df: DataFrame, key: str, big: Column, hot_rows: int) -> DataFrame:
    """Hot images are numbered in bands, all others in one sort, which leaves them dealt by image for what follows.

    The hot rows are a branch of their own: nothing else is shuffled by band or meets the band offsets, and where no
    image is hot AQE drops the branch before it starts.
    """
    def numbers(by: list[str]) -> tuple[Column, Column]:
        w = Window.partitionBy(*by).orderBy(*box_order())
        return F.row_number().over(w), F.sum(big.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    flagged = mark_hot(df, [key], hot_keys(df, [key], hot_rows), "__hot")
    rank, rank_big = numbers([key])
    others = flagged.where(~F.col("__hot")).select(
        *df.columns, (rank - 1).cast("long").alias("crop_no"), F.when(big, rank_big - 1).cast("long").alias("mv_crop_no"))

    banded = flagged.where(F.col("__hot")).withColumn("__band", score_band().cast("long")).drop("__hot")
    tally = banded.groupBy(key, "__band").agg(F.count(F.lit(1)).alias("__n"), F.count_if(big).alias("__nbig"))
    earlier = Window.partitionBy(key).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tally.select(
        F.col(key).alias("__key"), F.col("__band").alias("__kband"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__b"),
        F.coalesce(F.sum("__nbig").over(earlier), F.lit(0)).alias("__bbig"),
    )
    rank, rank_big = numbers([key, "__band"])
    numbered = banded.withColumn("__rn", rank).withColumn("__rbig", rank_big)
    joined = numbered.join(
        offsets, numbered[key].eqNullSafe(offsets["__key"]) & (numbered["__band"] == offsets["__kband"]), "left"
    )
    hot = joined.select(
        *df.columns,
        (F.col("__rn") - 1 + F.col("__b")).cast("long").alias("crop_no"),
        F.when(big, F.col("__rbig") - 1 + F.col("__bbig")).cast("long").alias("mv_crop_no"),
    )
    return others.unionByName(hot)


def z_order(
    df: DataFrame, area: Column, index_col: str, key: str = "id", index_desc: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One-based paint order: larger boxes first, ties by index (either way)."""
    tie = F.desc(index_col) if index_desc else F.asc(index_col)
    with_area = df.withColumn("bbox_area", area)
    band = falling_band(F.signum("bbox_area") * F.sqrt(F.abs("bbox_area")))
    return ordinal(with_area, [key], [F.desc("bbox_area"), tie], band, "z_order", 1, hot_rows)


def crop_counts(df: DataFrame, image_col: str = "image_path") -> DataFrame:
    return df.groupBy(image_col).agg(F.count(F.lit(1)).alias("__crops"))


def paste_order(df: DataFrame, image_col: str = "image_path", counts: DataFrame | None = None) -> DataFrame:
    """Crops 1, 2, … first and crop 0 last, so that crop 0 ends on top.

    Needs only the number of crops per image, not another sort. ``counts`` may
    come from the un-numbered boxes, which saves numbering them twice.
    """
    return (
        df.join(crop_counts(df, image_col) if counts is None else counts, image_col)
        .withColumn("paste_order", F.when(F.col("crop_no") == 0, F.col("__crops")).otherwise(F.col("crop_no")))
        .drop("__crops")
    )


def layer_order(df: DataFrame, key: str = "id", index_col: str = "idx", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Backgrounds before foregrounds, each by falling coverage, then input order."""
    limit = 10**9
    ground = F.when(F.col("is_background"), F.lit(0)).when(~F.col("is_background"), F.lit(1)).otherwise(F.lit(2))
    band = ground * F.lit(4 * limit) + falling_band(F.col("coverage"), 1000.0, limit)
    order = [F.desc("is_background"), F.desc("coverage"), F.asc(index_col)]
    return ordinal(df, [key], order, band, "layer", 1, hot_rows)


def first_images(df: DataFrame, n: int, image_col: str = "image_path") -> DataFrame:
    """All rows of the first ``n`` images by name, for any ``n``: Spark broadcasts the names where they are few."""
    names = df.select(image_col).distinct().orderBy(image_col).limit(n)
    return df.join(names, image_col, "left_semi")


def first_rows(df: DataFrame, n: int, image_col: str = "image_path") -> DataFrame:
    return df.orderBy(F.asc(image_col), *box_order()).limit(n)


def drawn_crops(df: DataFrame, k: int, seed: int, image_col: str = "image_path") -> DataFrame:
    """``k`` crops per image, drawn at random, for the stronger augmentation."""
    digest = draw_digest(seed, "extreme", F.col(image_col), F.col("crop_no"))
    return first_per_key(df, [image_col], [digest.asc(), F.asc("crop_no")], k, "draw")


# ---------------------------------------------------------------------- layout

def letterbox_boxes(df: DataFrame, canvas_w=K.CANVAS_WIDTH, canvas_h=K.CANVAS_HEIGHT) -> DataFrame:
    """Source and canvas corners for every box of an image of known size."""
    iw, ih = F.col("image_width"), F.col("image_height")
    names = ["scale", "off_x", "off_y", "fit_w", "fit_h"]
    step = df.select("*", *[c.alias(n) for c, n in zip(G.letterbox_layout(iw, ih, canvas_w, canvas_h), names)])
    src = ["sx1", "sy1", "sx2", "sy2"]
    step = step.select("*", *[c.alias(n) for c, n in zip(G.clamp_box(*[F.col(c) for c in CORNERS], iw, ih), src)])
    dst = G.box_to_letterbox(
        *[F.col(c) for c in src], F.col("scale"), F.col("off_x"), F.col("off_y"), canvas_w, canvas_h
    )
    return step.select("*", *[c.alias(n) for c, n in zip(dst, ["cx1", "cy1", "cx2", "cy2"])])


def cover_boxes(
    df: DataFrame, canvas_w=K.TARGET_WIDTH, canvas_h=K.TARGET_HEIGHT, clamp_source: bool = True
) -> DataFrame:
    """Boxes in the centre-cropped viewport; ``clamp_source`` clamps in the image first."""
    iw, ih = F.col("image_width"), F.col("image_height")
    names = ["scale", "crop_left", "crop_top", "fit_w", "fit_h"]
    step = df.select("*", *[c.alias(n) for c, n in zip(G.cover_layout(iw, ih, canvas_w, canvas_h), names)])
    corners = [F.col(c) for c in CORNERS]
    src = G.clamp_box(*corners, iw, ih) if clamp_source else [c.cast("int") for c in corners]
    step = step.select("*", *[c.alias(n) for c, n in zip(src, ["sx1", "sy1", "sx2", "sy2"])])
    dst = G.box_to_cover(
        *[F.col(c) for c in ("sx1", "sy1", "sx2", "sy2")],
        F.col("scale"), F.col("crop_left"), F.col("crop_top"), canvas_w, canvas_h,
    )
    return step.select("*", *[c.alias(n) for c, n in zip(dst, ["vx1", "vy1", "vx2", "vy2"])])


def margin_jitter(
    df: DataFrame, seed: int, min_side: float = 0.0,
    margin: tuple[int, int] = (K.MARGIN_MIN, K.MARGIN_MAX), expand_prob: float = K.MARGIN_EXPAND_PROB,
) -> DataFrame:
    """Grow or shrink clamped boxes ``sx1…sy2`` by a drawn margin; undo it when the box gets too small."""
    key = (F.col("image_path"), F.col("crop_no"))
    m = draw_int_between(*margin, seed, "margin", *key).cast("int")
    step = df.withColumn(
        "margin", F.when(draw_unit(seed, "expand", *key) < expand_prob, m).otherwise(-m)
    )
    moved = G.clamp_box(
        F.col("sx1") - F.col("margin"), F.col("sy1") - F.col("margin"),
        F.col("sx2") + F.col("margin"), F.col("sy2") + F.col("margin"),
        F.col("image_width"), F.col("image_height"),
    )
    names = ["mx1", "my1", "mx2", "my2"]
    step = step.select("*", *[c.alias(n) for c, n in zip(moved, names)])
    w, h = F.col("mx2") - F.col("mx1"), F.col("my2") - F.col("my1")
    undo = (w <= 0) | (h <= 0)
    if min_side > 0:
        undo = undo | (w <= min_side) | (h <= min_side)
    kept = [F.when(undo, F.col(s)).otherwise(F.col(m_)).alias(m_) for s, m_ in zip(["sx1", "sy1", "sx2", "sy2"], names)]
    return step.select(*[c for c in step.columns if c not in names], *kept, undo.alias("reverted"))


def choose_views(
    crops: DataFrame, views: DataFrame, prob: float, seed: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Pick one re-rendered view per crop with probability ``prob``, else the source crop.

    ``views`` has (stem, mv_crop_no, path). Views are numbered in hash order, and
    the drawn number is an equi-join key, so no list of views is ever built.
    """
    keys = ["stem", "mv_crop_no"]
    order = [F.md5("path").asc(), F.asc("path")]
    ranked = ordinal(views.select(*keys, "path"), keys, order, digest_band(F.md5("path")), "view_no", 0, hot_rows)
    sizes = views.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_views"))
    draw_key = (F.col("image_path"), F.col("crop_no"))
    asked = crops.join(sizes, keys, "left").withColumn(
        "view_no",
        F.when(
            (F.col("n_views") > 0) & (draw_unit(seed, "use_view", *draw_key) < prob),
            draw_below(F.greatest(F.col("n_views"), F.lit(1)), seed, "view", *draw_key),
        ),
    )
    return (
        asked.join(ranked.withColumnRenamed("path", "view_path"), [*keys, "view_no"], "left")
        .withColumn("crop_source", F.when(F.col("view_path").isNotNull(), "multiview").otherwise("source"))
        .drop("view_no")
    )


def place_layers(df: DataFrame, rules: Sequence[dict], bg: str = "label") -> DataFrame:
    """First rule whose keyword occurs in the label decides asset and fit; boxes get layer corners.

    A rule is ``{keyword, asset, asset_w, asset_h, fit}`` with fit ``width_bottom``,
    ``height_center`` or ``cover``. Rules are a short configured list, so they
    become one CASE expression rather than a join.
    """
    fields = ["keyword", "asset", "asset_w", "asset_h", "fit"]
    pick = None
    for r in rules:
        item = F.struct(*[F.lit(r[f]).alias(f) for f in fields])
        test = F.col(bg).contains(r["keyword"])
        pick = F.when(test, item) if pick is None else pick.when(test, item)
    step = df.withColumn("rule", pick).where(F.col("rule").isNotNull())
    x1, y1, x2, y2 = [F.col(c).cast("int") for c in CORNERS]
    step = step.select("*", x1.alias("bx1"), y1.alias("by1"), (x2 - x1).alias("bw"), (y2 - y1).alias("bh"))
    aw, ah, fit = F.col("rule.asset_w"), F.col("rule.asset_h"), F.col("rule.fit")
    bw, bh = F.col("bw"), F.col("bh")
    cover = F.greatest(bw / aw, bh / ah)
    lw = (
        F.when(fit == "width_bottom", bw)
        .when(fit == "height_center", (aw * (bh / ah)).cast("int"))
        .otherwise(F.greatest(F.lit(1), G.half_even(aw * cover)))
    )
    lh = (
        F.when(fit == "width_bottom", (ah * (bw / aw)).cast("int"))
        .when(fit == "height_center", bh)
        .otherwise(F.greatest(F.lit(1), G.half_even(ah * cover)))
    )
    step = step.select("*", lw.alias("layer_w"), lh.alias("layer_h"))
    half_gap = F.floor((bw - F.col("layer_w")) / 2).cast("int")
    step = step.select(
        "*",
        F.when(fit == "height_center", F.col("bx1") + half_gap).otherwise(F.col("bx1")).alias("layer_x"),
        F.when(fit == "width_bottom", F.col("by1") + bh - F.col("layer_h")).otherwise(F.col("by1")).alias("layer_y"),
        F.when(fit == "cover", F.floor((F.col("layer_w") - bw) / 2).cast("int")).otherwise(0).alias("cut_x"),
        F.when(fit == "cover", F.floor((F.col("layer_h") - bh) / 2).cast("int")).otherwise(0).alias("cut_y"),
    )
    return step.withColumn("keyword", F.col("rule.keyword")).withColumn("asset", F.col("rule.asset")).drop("rule")


def fallback_layers(images: DataFrame, placed: DataFrame, assets: Sequence[dict], key: str = "image_path") -> DataFrame:
    """Corner positions for images in which no rule matched a box.

    An asset is ``{asset, asset_w, asset_h, height, side, margin_x, margin_y}``
    with side ``left`` or ``right``.
    """
    empty = images.join(placed.select(key).distinct(), key, "left_anti")
    items = []
    for a in assets:
        lw = int(a["asset_w"] * (a["height"] / a["asset_h"]))
        x = F.lit(a["margin_x"]) if a["side"] == "left" else F.col("image_width") - F.lit(lw + a["margin_x"])
        items.append(F.struct(
            F.lit(a["asset"]).alias("asset"), F.lit(lw).alias("layer_w"), F.lit(a["height"]).alias("layer_h"),
            x.alias("layer_x"), (F.col("image_height") - F.lit(a["height"] + a["margin_y"])).alias("layer_y"),
        ))
    return empty.select(key, F.inline(F.array(*items)))


# ------------------------------------------------------------------ statistics

def size_totals(df: DataFrame, limit: float = K.LARGE_SIDE, image_col: str = "image_path") -> DataFrame:
    """Rows, distinct images, rows above (and at) the limit with percentages, images with one."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    gt, ge = (w > limit) & (h > limit), (w >= limit) & (h >= limit)
    per_image = df.groupBy(image_col).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(gt).alias("gt"), F.count_if(ge).alias("ge")
    )
    total = per_image.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(image_col).alias("n_images"),
        F.coalesce(F.sum("gt"), F.lit(0)).alias("n_gt"), F.coalesce(F.sum("ge"), F.lit(0)).alias("n_ge"),
        F.count_if((F.col("gt") > 0) & F.col(image_col).isNotNull()).alias("n_images_gt"),
    )
    pct = lambda c: F.when(F.col("n_rows") > 0, F.lit(100.0) * F.col(c) / F.col("n_rows")).otherwise(0.0)
    return total.select("*", pct("n_gt").alias("pct_gt"), pct("n_ge").alias("pct_ge"))


def side_percentiles(df: DataFrame, probs: Sequence[float] = tuple(K.SIDE_PERCENTILES)) -> DataFrame:
    side = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return exact_percentiles(df, side, probs)


def side_histogram(df: DataFrame) -> DataFrame:
    """Counts of the smaller side in fixed right-closed bins, empty bins included."""
    side = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    edges = K.SIDE_BIN_EDGES
    bin_no = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        bin_no = F.when(side <= edges[i], i).otherwise(bin_no)
    # The first bin opens just above -1 and the last one ends at 1e9.
    inside = (side > -1) & (side <= 1e9)
    n_bins = len(K.SIDE_BIN_LABELS)
    tallies = df.where(inside).agg(*[F.count_if(bin_no == i).alias(f"b{i}") for i in range(n_bins)])
    rows = F.array(*[
        F.struct(F.lit(i).alias("bin_no"), F.lit(lab).alias("bin"), F.col(f"b{i}").alias("n"))
        for i, lab in enumerate(K.SIDE_BIN_LABELS)
    ])
    return tallies.select(F.inline(rows))


def top_classes(df: DataFrame, limit: float = K.LARGE_SIDE, k: int = 15) -> DataFrame:
    """Most frequent classes among large boxes; a null class is a group of its own."""
    return (
        large_boxes(df, limit).groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_last("class_name")).limit(k)
    )


def side_summary(df: DataFrame) -> DataFrame:
    """mean, sample standard deviation, min and max of width and height, one row each."""
    sides = {"width": F.col("x2") - F.col("x1"), "height": F.col("y2") - F.col("y1")}
    aggs = []
    for name, c in sides.items():
        aggs += [F.avg(c).alias(f"{name}_mean"), F.stddev_samp(c).alias(f"{name}_std"),
                 F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max")]
    rows = F.array(*[
        F.struct(F.lit(n).alias("side"), *[F.col(f"{n}_{s}").alias(s) for s in ("mean", "std", "min", "max")])
        for n in sides
    ])
    return df.agg(*aggs).select(F.inline(rows))


def image_counts(df: DataFrame, path_col: str = "image_path", abs_col: str = "image_abspath", approx: bool = False) -> DataFrame:
    """Distinct images by base name and by absolute path."""
    count = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        count(X.file_name(F.col(path_col))).alias("n_by_name"),
        count(F.col(abs_col)).alias("n_by_abspath"),
    )


def grouped_boxes(numbered: DataFrame, image_col: str = "image_path") -> DataFrame:
    """One record per image with all its boxes in crop order.

    A record is one value, so a task holds as much as the largest image's list.
    Work that needs no list stays on ``numbered``, which is keyed by image and number.
    """
    return ordered_lists(numbered, [image_col], "crop_no", [*CORNERS, "class_name", "confidence", "mv_crop_no"], "boxes")


def group_prompts(df: DataFrame, prompt_col: str | None, order_col: str, image_col: str = "image_path") -> DataFrame:
    """First non-empty prompt of an image, else its distinct class names, else a constant."""
    prompt = X.strip(F.coalesce(F.col(prompt_col), F.lit(""))) if prompt_col else F.lit("")
    cls = X.strip(F.coalesce(F.col("class_name"), F.lit("")))
    rows = df.select(image_col, order_col, X.null_if_empty(prompt).alias("p"), X.null_if_empty(cls).alias("c"))
    # One row per (image, class) first, so repeated classes of a hot image collapse before the final merge.
    per_class = rows.groupBy(image_col, "c").agg(
        F.min(F.when(F.col("p").isNotNull(), F.struct(F.col(order_col).alias("o"), F.col("p").alias("p")))).alias("first")
    )
    g = per_class.groupBy(image_col).agg(
        F.min("first").alias("first"), F.sort_array(F.collect_set("c")).alias("classes")
    )
    listed = F.concat(F.lit(K.SCENE_OF_CLASSES), F.array_join("classes", ", "), F.lit("."))
    return g.select(
        image_col,
        F.coalesce(F.col("first.p"), F.when(F.size("classes") > 0, listed), F.lit(K.SCENE_DEFAULT)).alias("prompt"),
    )


def found_counts(boxes: DataFrame, key: str = "id") -> DataFrame:
    """Found and total objects per image."""
    return boxes.groupBy(key).agg(
        F.count_if(F.coalesce("found", F.lit(False))).alias("n_found"), F.count(F.lit(1)).alias("n_objects")
    )


def missing_objects(boxes: DataFrame, key: str = "id", index_col: str = "bbox_index") -> DataFrame:
    """Names of an image's objects that were not found, one ordered list per image that lacks any."""
    lost = boxes.where(~F.coalesce("found", F.lit(False)))
    listed = ordered_lists(lost, [key], index_col, ["object"], "items")
    return listed.select(key, F.transform("items", lambda i: i["object"]).alias("missing"))


def canvas_sources(results: DataFrame) -> DataFrame:
    """Run totals: images written, skipped by reason, and crops by source."""
    ok = F.col("status") == "ok"
    return results.agg(
        F.count_if(ok).alias("images_written"),
        F.coalesce(F.sum(F.when(ok, F.col("n_multiview"))), F.lit(0)).alias("multiview_crops"),
        F.coalesce(F.sum(F.when(ok, F.col("n_source"))), F.lit(0)).alias("source_crops"),
        F.count_if(F.col("status") == "skip_missing").alias("skipped_missing"),
        F.count_if(~F.col("status").isin("ok", "skip_missing")).alias("skipped_unreadable"),
    )
