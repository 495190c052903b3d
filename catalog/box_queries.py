"""Box geometry, running numbers, layout and size statistics over the detections view."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import query
from tilewright import constants as K
from tilewright.functions import geometry as G
from tilewright.operators import boxes as B
from tilewright.operators import manifest as M
from tilewright.operators import sampling as S
from tilewright.plans.layout import canvas_layout
from tilewright.sources import sinks

DET = V.det_sql()
CORNERS = ["x1", "y1", "x2", "y2"]
BOX = ["image_path", "class_name", "confidence", *CORNERS]
SIZED = [*BOX, "image_width", "image_height"]


def clamp_sql(x1, y1, x2, y2, w, h, pre="s"):
    r = lambda v: f"cast(round_even({v}, 0) as int)"
    a = f"greatest(0, least({r(x1)}, {w} - 1))"
    b = f"greatest(0, least({r(y1)}, {h} - 1))"
    return (f"{a} AS {pre}x1, {b} AS {pre}y1, greatest({a} + 1, least({r(x2)}, {w})) AS {pre}x2, "
            f"greatest({b} + 1, least({r(y2)}, {h})) AS {pre}y2")


def r_int(v):
    return f"cast(round_even({v}, 0) as int)"


def letterbox_sql(src, cw=1920, ch=1080):
    """CTEs lb (scale, offsets, clamped box) and boxed (canvas box)."""
    scale = f"least({cw} / image_width::DOUBLE, {ch} / image_height::DOUBLE)"
    nw = f"greatest(1, least({cw}, {r_int(f'image_width * {scale}')}))"
    nh = f"greatest(1, least({ch}, {r_int(f'image_height * {scale}')}))"
    m = lambda v, o: f"{o} + {r_int(f'{v} * scale')}"
    a, b = f"greatest(0, least({m('sx1', 'off_x')}, {cw - 1}))", f"greatest(0, least({m('sy1', 'off_y')}, {ch - 1}))"
    return (
        f"lb AS (SELECT *, {scale} AS scale, ({cw} - {nw}) // 2 AS off_x, ({ch} - {nh}) // 2 AS off_y, {nw} AS fit_w, "
        f"{nh} AS fit_h, {clamp_sql('x1', 'y1', 'x2', 'y2', 'image_width', 'image_height')} FROM {src}), "
        f"boxed AS (SELECT *, {a} AS cx1, {b} AS cy1, greatest({a} + 1, least({m('sx2', 'off_x')}, {cw})) AS cx2, "
        f"greatest({b} + 1, least({m('sy2', 'off_y')}, {ch})) AS cy2 FROM lb)"
    )


def cover_sql(src, clamp=True, cw=1280, ch=720):
    scale = f"greatest({cw} / image_width::DOUBLE, {ch} / image_height::DOUBLE)"
    nw, nh = f"greatest(1, {r_int(f'image_width * {scale}')})", f"greatest(1, {r_int(f'image_height * {scale}')})"
    box = clamp_sql("x1", "y1", "x2", "y2", "image_width", "image_height") if clamp else ", ".join(
        f"cast(trunc({c}) as int) AS s{c}" for c in CORNERS)
    m = lambda v, o: f"{r_int(f'{v} * scale')} - {o}"
    a, b = f"greatest(0, least({m('sx1', 'crop_left')}, {cw - 1}))", f"greatest(0, least({m('sy1', 'crop_top')}, {ch - 1}))"
    return (
        f"cv AS (SELECT *, {scale} AS scale, greatest(0, ({nw} - {cw}) // 2) AS crop_left, "
        f"greatest(0, ({nh} - {ch}) // 2) AS crop_top, {nw} AS fit_w, {nh} AS fit_h, {box} FROM {src}), "
        f"covered AS (SELECT *, {a} AS vx1, {b} AS vy1, greatest({a} + 1, least({m('sx2', 'crop_left')}, {cw})) AS vx2, "
        f"greatest({b} + 1, least({m('sy2', 'crop_top')}, {ch})) AS vy2 FROM cv)"
    )


# ------------------------------------------------------------------- geometry

@query("box_sides", f"WITH {DET} SELECT image_path, x1, y1, x2 - x1 AS w, y2 - y1 AS h, least(x2 - x1, y2 - y1) AS min_side, "
       f"greatest(x2 - x1, y2 - y1) AS max_side, (x2 - x1) * (y2 - y1) AS area FROM det")
def box_sides(spark, sf):
    return V.detections(spark, sf, BOX).select("image_path", "x1", "y1", *G.side_columns())


@query("clamped_areas", f"WITH {DET} SELECT image_path, x1, y1, greatest(0, x2 - x1) * greatest(0, y2 - y1) AS per_side, "
       f"greatest(0, (x2 - x1) * (y2 - y1)) AS of_product FROM det")
def clamped_areas(spark, sf):
    c = [F.col(x) for x in CORNERS]
    return V.detections(spark, sf, BOX).select(
        "image_path", "x1", "y1", G.clamped_area(*c).alias("per_side"), G.product_clamped_area(*c).alias("of_product"))


_N = lambda v, s: f"CASE WHEN found THEN round_even({v} / ({s} - 1), 6) END"


@query("box_records", f"""WITH {DET} SELECT image_path, confidence, found, CASE WHEN found THEN label END AS label,
  CASE WHEN found THEN round_even(sqrt(confidence), 6) END AS score, CASE WHEN found THEN round_even(x1, 2) END AS xmin,
  CASE WHEN found THEN round_even(y2, 2) END AS ymax, {_N('x1', 'image_width')} AS nxmin, {_N('y1', 'image_height')} AS nymin,
  {_N('x2', 'image_width')} AS nxmax, {_N('y2', 'image_height')} AS nymax FROM det""")
def box_records(spark, sf):
    d = V.detections(spark, sf, [*SIZED, "found", "label"])
    rec = G.box_record(F.col("found"), F.col("label"), F.sqrt("confidence"), *[F.col(c) for c in CORNERS],
                       F.col("image_width") - 1, F.col("image_height") - 1)  # odd sizes: no decimal ties
    s = d.select("image_path", "confidence", F.struct(*rec).alias("r"))
    return s.select(
        "image_path", "confidence", "r.found", "r.label", "r.score", F.col("r.xyxy.xmin").alias("xmin"),
        F.col("r.bbox")[3].alias("ymax"), *[F.col(f"r.xyxy_norm.{c}").alias(f"n{c}") for c in ("xmin", "ymin", "xmax", "ymax")])


@query("padded_crops", f"""WITH {DET}, p AS (SELECT image_path, confidence,
  greatest(0, x1 - (x2 - x1) * 0.1::DOUBLE) AS a, greatest(0, y1 - (y2 - y1) * 0.1::DOUBLE) AS b,
  least(image_width::DOUBLE, x2 + (x2 - x1) * 0.1::DOUBLE) AS c, least(image_height::DOUBLE, y2 + (y2 - y1) * 0.1::DOUBLE) AS d FROM det),
  q AS (SELECT image_path, confidence, {r_int('a')} AS px1, {r_int('b')} AS py1, greatest({r_int('c')}, {r_int('a')} + 1) AS px2,
  greatest({r_int('d')}, {r_int('b')} + 1) AS py2 FROM p)
  SELECT *, CASE WHEN px2 - px1 < 8 OR py2 - py1 < 8 THEN 'box_too_small' END AS reject_reason FROM q""")
def padded_crops(spark, sf):
    d = V.detections(spark, sf, SIZED)
    box, reason = G.crop_box(*[F.col(c) for c in CORNERS], F.col("image_width"), F.col("image_height"), 0.1)
    return d.select("image_path", "confidence", *[c.alias(f"p{n}") for c, n in zip(box, CORNERS)], reason.alias("reject_reason"))


@query("clamped_boxes", f"WITH {DET} SELECT image_path, confidence, {clamp_sql('x1', 'y1', 'x2', 'y2', 'image_width', 'image_height')} FROM det")
def clamped_boxes(spark, sf):
    d = V.detections(spark, sf, SIZED)
    box = G.clamp_box(*[F.col(c) for c in CORNERS], F.col("image_width"), F.col("image_height"))
    return d.select("image_path", "confidence", *[c.alias(f"s{n}") for c, n in zip(box, CORNERS)])


@query("letterbox_layouts", f"WITH {DET}, {letterbox_sql('det')} SELECT DISTINCT image_path, scale, off_x, off_y, fit_w, fit_h FROM boxed")
def letterbox_layouts(spark, sf):
    d = V.detections(spark, sf, ["image_path", "image_width", "image_height"]).distinct()
    cols = G.letterbox_layout(F.col("image_width"), F.col("image_height"))
    return d.select("image_path", *[c.alias(n) for c, n in zip(cols, ["scale", "off_x", "off_y", "fit_w", "fit_h"])])


@query("cover_layouts", f"WITH {DET}, {cover_sql('det')} SELECT DISTINCT image_path, scale, crop_left, crop_top, fit_w, fit_h FROM covered")
def cover_layouts(spark, sf):
    d = V.detections(spark, sf, ["image_path", "image_width", "image_height"]).distinct()
    cols = G.cover_layout(F.col("image_width"), F.col("image_height"))
    return d.select("image_path", *[c.alias(n) for c, n in zip(cols, ["scale", "crop_left", "crop_top", "fit_w", "fit_h"])])


@query("letterbox_boxes", f"WITH {DET}, {letterbox_sql('det')} SELECT image_path, confidence, cx1, cy1, cx2, cy2 FROM boxed")
def letterbox_boxes(spark, sf):
    return B.letterbox_boxes(V.detections(spark, sf, SIZED)).select("image_path", "confidence", "cx1", "cy1", "cx2", "cy2")


@query("cover_boxes", f"WITH {DET}, {cover_sql('det')} SELECT image_path, confidence, vx1, vy1, vx2, vy2 FROM covered")
def cover_boxes(spark, sf):
    return B.cover_boxes(V.detections(spark, sf, SIZED)).select("image_path", "confidence", "vx1", "vy1", "vx2", "vy2")


@query("cover_boxes_unclamped", f"WITH {DET}, {cover_sql('det', clamp=False)} SELECT image_path, confidence, vx1, vy1, vx2, vy2 FROM covered")
def cover_boxes_unclamped(spark, sf):
    return B.cover_boxes(V.detections(spark, sf, SIZED), clamp_source=False).select(
        "image_path", "confidence", "vx1", "vy1", "vx2", "vy2")


_LONG = "greatest(image_width, image_height)"


@query("target_sizes", f"""WITH {DET} SELECT DISTINCT image_path, {r_int(f'1024 * image_width / {_LONG}::DOUBLE / 16.0::DOUBLE')} * 16 AS tw,
  {r_int(f'1024 * image_height / {_LONG}::DOUBLE / 16.0::DOUBLE')} * 16 AS th,
  (32 + {V.u32(7, 'resolution', 'image_path')} % 49) * 16 AS resolution FROM det""")
def target_sizes(spark, sf):
    d = V.detections(spark, sf, ["image_path", "image_width", "image_height"]).distinct()
    tw, th = G.target_size(F.col("image_width"), F.col("image_height"), 1024)
    return d.select("image_path", tw.alias("tw"), th.alias("th"), S.random_resolution(7, F.col("image_path")).alias("resolution"))


def _fit(fit):
    f = "least" if fit == "contain" else "greatest"
    t = "radians(cast(line * 15 as double))"
    w = f"(abs(cos({t})) * 320 + abs(sin({t})) * 240)"
    h = f"(abs(sin({t})) * 320 + abs(cos({t})) * 240)"
    return (f"round({f}(greatest(1, x2 - x1) / greatest({w}, 1e-6), greatest(1, y2 - y1) / greatest({h}, 1e-6)), 9)")


@query("fit_scales", f"WITH {DET} SELECT image_path, confidence, {_fit('contain')} AS contain, {_fit('cover')} AS cover FROM det")
def fit_scales(spark, sf):
    d = V.detections(spark, sf, [*BOX, "line"])
    args = (F.lit(320), F.lit(240), *[F.col(c) for c in CORNERS])
    rot = F.col("line") * F.lit(15.0)
    return d.select("image_path", "confidence", *[F.round(G.fit_scale(*args, f, rot), 9).alias(f) for f in ("contain", "cover")])


_T = "radians(cast(line * 10 as double))"
_S = "(quantity / 10)"
_CX, _CY, _DX, _DY = "((x1 + x2) / 2)", "((y1 + y2) / 2)", "960.0::DOUBLE", "540.0::DOUBLE"
_TX = f"({_DX} - ({_S} * cos({_T}) * {_CX} + -{_S} * sin({_T}) * {_CY}))"
_TY = f"({_DY} - ({_S} * cos({_T}) * {_CY} - -{_S} * sin({_T}) * {_CX}))"


@query("similarity_matrices", f"""WITH {DET} SELECT image_path, confidence, round({_S} * cos({_T}), 6) AS m00, round(-({_S} * sin({_T})), 6) AS m01,
  round({_TX}, 6) AS m02, round({_S} * sin({_T}), 6) AS m10, round({_TY}, 6) AS m12,
  round(sqrt(pow({_S} * cos({_T}), 2) + pow({_S} * sin({_T}), 2)), 6) AS scale,
  round(degrees(atan2({_S} * sin({_T}), {_S} * cos({_T}))), 6) AS rotation_deg FROM det""")
def similarity_matrices(spark, sf):
    d = V.detections(spark, sf, [*BOX, "line", "quantity"])
    terms = G.similarity_terms(
        F.col("quantity") / 10, F.col("line") * F.lit(10.0), (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2,
        F.lit(960.0), F.lit(540.0))
    m, s = G.similarity_matrix(*terms), G.transform_summary(*terms)
    step = d.select("image_path", "confidence", m.alias("m"), *s)
    rd = lambda c: F.round(c, 6)
    return step.select(
        "image_path", "confidence", rd(F.col("m")[0][0]).alias("m00"), rd(F.col("m")[0][1]).alias("m01"),
        rd(F.col("m")[0][2]).alias("m02"), rd(F.col("m")[1][0]).alias("m10"), rd(F.col("m")[1][2]).alias("m12"),
        rd(F.col("scale")).alias("scale"), rd(F.col("rotation_deg")).alias("rotation_deg"))


# -------------------------------------------------------------------- filters

@query("large_boxes", f"WITH {DET} SELECT image_path, confidence, x1, y1, x2, y2 FROM det WHERE x2 - x1 > 200 AND y2 - y1 > 200")
def large_boxes(spark, sf):
    return B.large_boxes(V.detections(spark, sf, BOX), K.LARGE_SIDE).select("image_path", "confidence", *CORNERS)


@query("parsed_boxes", f"""WITH {DET} SELECT image_path, x1, y1, x2, y2 FROM det
  WHERE line % 5 <> 0 AND quantity <> 7 AND x2 > x1 AND y2 > y1""")
def parsed_boxes(spark, sf):
    """Corners arrive as text with some unreadable values and blank image keys."""
    d = V.detections(spark, sf, [*BOX, "line", "quantity"])
    raw = d.select(
        F.when(F.col("quantity") == 7, "  ").otherwise(F.concat(F.lit(" "), "image_path", F.lit("\t"))).alias("image_path"),
        F.when(F.col("line") % 5 == 0, "n/a").otherwise(F.col("x1").cast("string")).alias("x1"),
        *[F.col(c).cast("string").alias(c) for c in ("y1", "x2", "y2")])
    return B.parsed_boxes(raw)


@query("detection_status", f"""WITH {DET}, s AS (SELECT image_path, confidence, x1, y1,
  CASE WHEN NOT found THEN 'not_found' WHEN line <> 3 AND confidence < 0.5 THEN 'low_score' WHEN line = 2 THEN 'missing_bbox' END AS skip_reason FROM det)
  SELECT coalesce(skip_reason, 'use') AS status, count(*) AS n FROM s GROUP BY 1""")
def detection_status(spark, sf):
    d = V.detections(spark, sf, [*BOX, "found", "line"]).select(
        "image_path", "found", F.when(F.col("line") != 3, F.col("confidence")).alias("score"),
        F.when(F.col("line") != 2, F.array(*CORNERS)).alias("bbox"))
    s = B.detection_status(d, 0.5)
    return s.groupBy(F.coalesce("skip_reason", F.lit("use")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ running numbers

NUM = V.numbered_sql()


@query("crop_numbers", f"WITH {DET}, {NUM} SELECT image_path, confidence, x1, y1, crop_no, cast(mv_crop_no as bigint) AS mv_crop_no FROM numbered")
def crop_numbers(spark, sf):
    return B.crop_numbers(V.detections(spark, sf, BOX)).select("image_path", "confidence", "x1", "y1", "crop_no", "mv_crop_no")


_AREA = "greatest(0, x2 - x1) * greatest(0, y2 - y1)"


@query("paint_order", f"""WITH {DET}, {NUM} SELECT image_path, crop_no, {_AREA} AS bbox_area,
  row_number() OVER (PARTITION BY image_path ORDER BY {_AREA} DESC, crop_no) AS z_order FROM numbered""")
def paint_order(spark, sf):
    n = B.crop_numbers(V.detections(spark, sf, BOX))
    return B.z_order(n, G.clamped_area(*[F.col(c) for c in CORNERS]), "crop_no", "image_path").select(
        "image_path", "crop_no", "bbox_area", "z_order")


_PAREA = "greatest(0, (x2 - x1) * (y2 - y1))"


@query("paint_order_index_desc", f"""WITH {DET}, {NUM} SELECT image_path, crop_no,
  row_number() OVER (PARTITION BY image_path ORDER BY {_PAREA} DESC, crop_no DESC) AS z_order FROM numbered""")
def paint_order_index_desc(spark, sf):
    n = B.crop_numbers(V.detections(spark, sf, BOX))
    return B.z_order(n, G.product_clamped_area(*[F.col(c) for c in CORNERS]), "crop_no", "image_path", index_desc=True).select(
        "image_path", "crop_no", "z_order")


@query("paste_order", f"""WITH {DET}, {NUM} SELECT image_path, crop_no,
  row_number() OVER (PARTITION BY image_path ORDER BY crop_no = 0, crop_no) AS paste_order FROM numbered""")
def paste_order(spark, sf):
    n = B.crop_numbers(V.detections(spark, sf, BOX)).select("image_path", "crop_no")
    return B.paste_order(n).select("image_path", "crop_no", "paste_order")


_COVER = "round(greatest(0, x2 - x1) * greatest(0, y2 - y1) / (image_width * image_height), 4)"
_ISBG = "contains(lower(concat('/', CASE WHEN line % 3 = 0 THEN 'Landscapes' ELSE 'objects' END, '/', image_path)), '/landscapes/')"


@query("layer_order", f"""WITH {DET}, {NUM} SELECT image_path, crop_no, {_ISBG} AS is_background,
  row_number() OVER (PARTITION BY image_path ORDER BY {_ISBG} DESC, {_COVER} DESC, crop_no) AS layer FROM numbered""")
def layer_order(spark, sf):
    from tilewright.functions.text import is_background_path

    n = B.crop_numbers(V.detections(spark, sf, [*SIZED, "line"]))
    path = F.concat(F.lit("/"), F.when(F.col("line") % 3 == 0, "Landscapes").otherwise("objects"), F.lit("\\"), "image_path")
    cover = F.round(G.clamped_area(*[F.col(c) for c in CORNERS]) / (F.col("image_width") * F.col("image_height")), 4)
    p = n.select("image_path", "crop_no", is_background_path(path).alias("is_background"), cover.alias("coverage"))
    return B.layer_order(p, "image_path", "crop_no").select("image_path", "crop_no", "is_background", "layer")


@query("canvas_layout", f"""WITH {DET}, {V.numbered_sql(where='x2 > x1 AND y2 > y1')}, {letterbox_sql('numbered')}
  SELECT image_path, crop_no, cast(mv_crop_no as bigint) AS mv_crop_no, sx1, sy1, sx2, sy2, cx1, cy1, cx2, cy2,
  CASE WHEN crop_no = 0 THEN count(*) OVER (PARTITION BY image_path) ELSE crop_no END AS paste_order FROM boxed""")
def canvas_layout_query(spark, sf):
    return canvas_layout(V.detections(spark, sf, SIZED)).select(
        "image_path", "crop_no", "mv_crop_no", "sx1", "sy1", "sx2", "sy2", "cx1", "cy1", "cx2", "cy2", "paste_order")


@query("first_images", f"""WITH {DET}, r AS (SELECT *, dense_rank() OVER (ORDER BY image_path) AS rk FROM det)
  SELECT image_path, confidence, x1, y1 FROM r WHERE rk <= 50""")
def first_images(spark, sf):
    return B.first_images(V.detections(spark, sf, BOX), 50).select("image_path", "confidence", "x1", "y1")


@query("first_rows", f"WITH {DET} SELECT image_path, confidence, x1, y1 FROM det ORDER BY image_path, confidence DESC, x1, y1, x2, y2 LIMIT 100")
def first_rows(spark, sf):
    return B.first_rows(V.detections(spark, sf, BOX), 100).select("image_path", "confidence", "x1", "y1")


@query("sorted_detections", f"WITH {DET} SELECT image_path, confidence, x1, y1, x2, y2 FROM det ORDER BY image_path, confidence DESC, x1, y1, x2, y2")
def sorted_detections(spark, sf):
    return V.detections(spark, sf, BOX).select("image_path", "confidence", *CORNERS).orderBy(F.asc("image_path"), *B.box_order())


@query("drawn_crops", f"""WITH {DET}, {NUM}, r AS (SELECT image_path, crop_no, row_number() OVER (PARTITION BY image_path
  ORDER BY {V.digest(11, 'extreme', 'image_path', 'crop_no')}, crop_no) AS draw FROM numbered) SELECT * FROM r WHERE draw <= 2""")
def drawn_crops(spark, sf):
    n = B.crop_numbers(V.detections(spark, sf, BOX)).select("image_path", "crop_no")
    return B.drawn_crops(n, 2, 11).select("image_path", "crop_no", F.col("draw").cast("long").alias("draw"))


# ----------------------------------------------------------------- statistics

@query("size_totals", f"""WITH {DET}, t AS (SELECT count(*) AS n_rows, count(DISTINCT image_path) AS n_images,
  count(*) FILTER (x2 - x1 > 200 AND y2 - y1 > 200) AS n_gt, count(*) FILTER (x2 - x1 >= 200 AND y2 - y1 >= 200) AS n_ge,
  count(DISTINCT image_path) FILTER (x2 - x1 > 200 AND y2 - y1 > 200) AS n_images_gt FROM det)
  SELECT *, 100.0::DOUBLE * n_gt / n_rows AS pct_gt, 100.0::DOUBLE * n_ge / n_rows AS pct_ge FROM t""")
def size_totals(spark, sf):
    return B.size_totals(V.detections(spark, sf, BOX))


_P = "[0.05, 0.25, 0.5, 0.75, 0.95, 0.99]"


@query("side_percentiles", f"""WITH {DET}, q AS (SELECT quantile_cont(least(x2 - x1, y2 - y1), {_P}) AS q FROM det)
  SELECT cast(unnest({_P}) as double) AS p, round(unnest(q), 6) AS value FROM q""")
def side_percentiles(spark, sf):
    return B.side_percentiles(V.detections(spark, sf, BOX)).select("p", F.round("value", 6).alias("value"))


_LABS = ", ".join(f"({i}, '{b}')" for i, b in enumerate(K.SIDE_BIN_LABELS))
_BIN = "CASE " + " ".join(f"WHEN s <= {e} THEN {i}" for i, e in enumerate(K.SIDE_BIN_EDGES)) + " ELSE 8 END"


@query("side_histogram", f"""WITH {DET}, s AS (SELECT least(x2 - x1, y2 - y1) AS s FROM det), b AS (SELECT {_BIN} AS bin_no, count(*) AS n
  FROM s WHERE s > -1 AND s <= 1e9 GROUP BY 1), l(bin_no, bin) AS (VALUES {_LABS})
  SELECT l.bin_no, l.bin, coalesce(b.n, 0) AS n FROM l LEFT JOIN b ON l.bin_no = b.bin_no""")
def side_histogram(spark, sf):
    return B.side_histogram(V.detections(spark, sf, BOX))


@query("top_classes", f"""WITH {DET} SELECT class_name, count(*) AS n FROM det WHERE x2 - x1 > 200 AND y2 - y1 > 200
  GROUP BY 1 ORDER BY n DESC, class_name NULLS LAST LIMIT 15""")
def top_classes(spark, sf):
    return B.top_classes(V.detections(spark, sf, BOX))


_SUM = lambda n, e: (f"SELECT '{n}' AS side, round(avg({e}), 6) AS mean, round(stddev_samp({e}), 6) AS std, "  # noqa: E731
                     f"min({e}) AS min, max({e}) AS max FROM det")


@query("side_summary", f"WITH {DET} {_SUM('width', 'x2 - x1')} UNION ALL {_SUM('height', 'y2 - y1')}")
def side_summary(spark, sf):
    s = B.side_summary(V.detections(spark, sf, BOX))
    return s.select("side", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max")


@query("image_counts", f"""WITH {DET} SELECT count(*) AS n_rows, count(DISTINCT image_path) AS n_by_name,
  count(DISTINCT concat('/data/', root, '/', image_path)) AS n_by_abspath FROM det""")
def image_counts(spark, sf):
    d = V.detections(spark, sf, ["image_path", "root"])
    return B.image_counts(d.withColumn("image_abspath", F.concat(F.lit("/data/"), "root", F.lit("/"), "image_path")))


@query("detection_totals", f"WITH {DET} SELECT count(*) AS n_rows, count(DISTINCT image_path) AS n_images FROM det")
def detection_totals(spark, sf):
    return sinks.detection_totals(V.detections(spark, sf, ["image_path"]))


@query("grouped_boxes", f"""WITH {DET}, {NUM} SELECT image_path, count(*) AS n_boxes,
  string_agg(concat(cast(crop_no as varchar), ':', coalesce(class_name, '?')), ' ' ORDER BY crop_no) AS boxes FROM numbered GROUP BY 1""")
def grouped_boxes(spark, sf):
    n = B.crop_numbers(V.detections(spark, sf, BOX))
    g = B.grouped_boxes(n)
    item = lambda b: F.concat(b["crop_no"].cast("string"), F.lit(":"), F.coalesce(b["class_name"], F.lit("?")))
    return g.select("image_path", F.size("boxes").cast("long").alias("n_boxes"),
                    F.array_join(F.transform("boxes", item), " ").alias("boxes"))


@query("group_prompts", f"""WITH {DET}, {NUM}, p AS (SELECT *, CASE WHEN line = 4 THEN concat('prompt ', cast(crop_no as varchar)) WHEN line = 2 THEN '  ' END AS prompt FROM numbered),
  g AS (SELECT image_path, min_by(prompt, crop_no) FILTER (trim(prompt) <> '') AS first,
  string_agg(DISTINCT class_name, ', ' ORDER BY class_name) AS classes FROM p GROUP BY 1)
  SELECT image_path, coalesce(first, 'A scene containing: ' || classes || '.', 'A scene image.') AS prompt FROM g""")
def group_prompts(spark, sf):
    n = B.crop_numbers(V.detections(spark, sf, [*BOX, "line"]))
    p = n.withColumn("prompt", F.when(F.col("line") == 4, F.concat(F.lit("prompt "), F.col("crop_no").cast("string"))).when(F.col("line") == 2, "  "))
    return B.group_prompts(p, "prompt", "crop_no")


@query("found_counts", f"WITH {DET} SELECT image_path, count(*) FILTER (found) AS n_found, count(*) AS n_objects FROM det GROUP BY 1")
def found_counts(spark, sf):
    return B.found_counts(V.detections(spark, sf, ["image_path", "found"]), "image_path")


@query("missing_objects", f"""WITH {DET}, {NUM} SELECT image_path, string_agg(label, '|' ORDER BY crop_no) AS missing
  FROM numbered WHERE NOT found GROUP BY 1""")
def missing_objects(spark, sf):
    n = B.crop_numbers(V.detections(spark, sf, [*BOX, "label", "found"]))
    n = n.select("image_path", (F.col("crop_no") + 1).alias("bbox_index"), F.col("label").alias("object"), "found")
    return B.missing_objects(n, "image_path").select("image_path", F.array_join("missing", "|").alias("missing"))


# --------------------------------------------------------- training-input plans

_MK = ("image_path", "crop_no")
_M = f"(10 + {V.u32(5, 'margin', *_MK)} % 21)"
_MARGIN = f"(CASE WHEN {V.unit(5, 'expand', *_MK)} < 0.5 THEN {_M} ELSE -{_M} END)"


@query("margin_jitter", f"""WITH {DET}, {NUM}, {letterbox_sql('numbered')}, m AS (SELECT *, cast({_MARGIN} as int) AS margin FROM lb),
  k AS (SELECT *, {clamp_sql('sx1 - margin', 'sy1 - margin', 'sx2 + margin', 'sy2 + margin', 'image_width', 'image_height', pre='m')} FROM m),
  u AS (SELECT *, (mx2 - mx1 <= 40 OR my2 - my1 <= 40) AS reverted FROM k)
  SELECT image_path, crop_no, margin, CASE WHEN reverted THEN sx1 ELSE mx1 END AS mx1, CASE WHEN reverted THEN sy1 ELSE my1 END AS my1,
  CASE WHEN reverted THEN sx2 ELSE mx2 END AS mx2, CASE WHEN reverted THEN sy2 ELSE my2 END AS my2, reverted FROM u""")
def margin_jitter(spark, sf):
    n = B.letterbox_boxes(B.crop_numbers(V.detections(spark, sf, SIZED)))
    return B.margin_jitter(n, 5, 40).select("image_path", "crop_no", "margin", "mx1", "my1", "mx2", "my2", "reverted")


_AK = ("image_path", "crop_no")
_hit = lambda p, s: f"{V.unit(9, s, *_AK)} < {p}::DOUBLE"


def _signed(mild, wild, salt):
    r = f"(CASE WHEN crop_no = 0 THEN {wild}::DOUBLE ELSE {mild}::DOUBLE END)"
    return f"(-{r} + {V.unit(9, salt, *_AK)} * ({r} * 2))"


@query("augmentation_plan", f"""WITH {DET}, {NUM} SELECT image_path, crop_no,
  round(CASE WHEN {_hit(0.88, 'bright')} THEN CASE WHEN {_hit(0.5, 'b_side')} THEN {V.between(*K.BRIGHTNESS_DIM, 9, 'b_dim', *_AK)}
    ELSE {V.between(*K.BRIGHTNESS_LIT, 9, 'b_lit', *_AK)} END END, 9) AS brightness,
  round(CASE WHEN {_hit(0.55, 'contrast')} THEN {V.between(*K.CONTRAST_RANGE, 9, 'c_value', *_AK)} END, 9) AS contrast,
  {_hit(0.5, 'flip')} AS flip,
  round(CASE WHEN {_hit(0.55, 'rotate')} THEN {_signed(8.0, 14.0, 'r_deg')} END, 9) AS rotate_deg,
  round(CASE WHEN {_hit(0.45, 'shear')} THEN {_signed(10.0, 18.0, 's_x')} END, 9) AS shear_x,
  round(CASE WHEN {_hit(0.45, 'shear')} THEN {_signed(10.0, 18.0, 's_y')} END, 9) AS shear_y FROM numbered""")
def augmentation_plan(spark, sf):
    n = B.crop_numbers(V.detections(spark, sf, BOX)).select("image_path", "crop_no")
    a = S.augmentation_plan(n, 9, F.col("crop_no") == 0)
    return a.select("image_path", "crop_no", *[F.round(c, 9).alias(c) for c in ("brightness", "contrast")], "flip",
                    *[F.round(c, 9).alias(c) for c in ("rotate_deg", "shear_x", "shear_y")])


_DK = "image_path"
_KERN = f"[11, 15, 21, 31, 41][{V.u32(9, 'kernel', _DK)} % 5 + 1]"
_ODD = lambda k: (f"(CASE WHEN least({k}, w, h) - (CASE WHEN least({k}, w, h) % 2 = 0 THEN 1 ELSE 0 END) >= 3 THEN "  # noqa: E731
                  f"least({k}, w, h) - (CASE WHEN least({k}, w, h) % 2 = 0 THEN 1 ELSE 0 END) ELSE 0 END)")


@query("depth_degradation_plan", f"""WITH {DET}, i AS (SELECT DISTINCT image_path, cast(image_width // 64 as int) AS w, cast(image_height // 64 as int) AS h FROM det),
  p AS (SELECT image_path, CASE WHEN {V.unit(9, 'blur', _DK)} < 0.7::DOUBLE THEN {_ODD(_KERN)} END AS blur_kernel,
  round(CASE WHEN {V.unit(9, 'noise', _DK)} < 0.4::DOUBLE THEN {V.between(*K.DEPTH_NOISE_STD, 9, 'noise_std', _DK)} END, 9) AS noise_std,
  CASE WHEN {V.unit(9, 'patch', _DK)} < 0.3::DOUBLE THEN 0.3::DOUBLE END AS patch_drop, {_ODD('21')} AS pk FROM i)
  SELECT image_path, blur_kernel, noise_std, patch_drop, round(CASE WHEN blur_kernel >= 3 THEN greatest(0.15::DOUBLE, blur_kernel / 6.0::DOUBLE) END, 9) AS blur_sigma,
  CASE WHEN patch_drop IS NOT NULL THEN pk END AS patch_kernel FROM p""")
def depth_degradation_plan(spark, sf):
    d = V.detections(spark, sf, ["image_path", "image_width", "image_height"]).distinct().select(
        "image_path", F.floor(F.col("image_width") / 64).cast("int").alias("image_width"),
        F.floor(F.col("image_height") / 64).cast("int").alias("image_height"))
    p = S.depth_plan(d, 9)
    return p.select("image_path", "blur_kernel", F.round("noise_std", 9).alias("noise_std"), "patch_drop",
                    F.round("blur_sigma", 9).alias("blur_sigma"), "patch_kernel")


# --------------------------------------------------------------- rules and views

RULES = [
    {"keyword": "ring", "asset": "ring.png", "asset_w": 300, "asset_h": 410, "fit": "width_bottom"},
    {"keyword": "widget", "asset": "widget.png", "asset_w": 170, "asset_h": 230, "fit": "height_center"},
    {"keyword": "red", "asset": "red.png", "asset_w": 333, "asset_h": 211, "fit": "cover"},
]
_RW = "CASE " + " ".join(f"WHEN contains(label, '{r['keyword']}') THEN {i + 1}" for i, r in enumerate(RULES)) + " END"
_RF = lambda f: "[" + ", ".join(f"'{r[f]}'" if isinstance(r[f], str) else str(r[f]) for r in RULES) + "][r]"


@query("placed_layers", f"""WITH {DET}, a AS (SELECT image_path, confidence, {_RW} AS r, cast(trunc(x1) as int) AS bx, cast(trunc(y1) as int) AS by_,
  cast(trunc(x2) as int) - cast(trunc(x1) as int) AS bw, cast(trunc(y2) as int) - cast(trunc(y1) as int) AS bh FROM det),
  b AS (SELECT *, {_RF('keyword')} AS keyword, {_RF('asset')} AS asset, {_RF('asset_w')}::DOUBLE AS aw, {_RF('asset_h')}::DOUBLE AS ah, {_RF('fit')} AS fit FROM a WHERE r IS NOT NULL),
  c AS (SELECT *, CASE fit WHEN 'width_bottom' THEN bw WHEN 'height_center' THEN cast(trunc(aw * (bh / ah)) as int)
    ELSE greatest(1, {r_int('aw * greatest(bw / aw, bh / ah)')}) END AS layer_w,
    CASE fit WHEN 'width_bottom' THEN cast(trunc(ah * (bw / aw)) as int) WHEN 'height_center' THEN bh
    ELSE greatest(1, {r_int('ah * greatest(bw / aw, bh / ah)')}) END AS layer_h FROM b)
  SELECT image_path, confidence, keyword, asset, layer_w, layer_h,
    CASE WHEN fit = 'height_center' THEN bx + cast(floor((bw - layer_w) / 2.0) as int) ELSE bx END AS layer_x,
    CASE WHEN fit = 'width_bottom' THEN by_ + bh - layer_h ELSE by_ END AS layer_y,
    CASE WHEN fit = 'cover' THEN cast(floor((layer_w - bw) / 2.0) as int) ELSE 0 END AS cut_x,
    CASE WHEN fit = 'cover' THEN cast(floor((layer_h - bh) / 2.0) as int) ELSE 0 END AS cut_y FROM c""")
def placed_layers(spark, sf):
    d = V.detections(spark, sf, [*BOX, "label"])
    return B.place_layers(d, RULES).select(
        "image_path", "confidence", "keyword", "asset", "layer_w", "layer_h", "layer_x", "layer_y", "cut_x", "cut_y")


ASSETS = [
    {"asset": "pot.png", "asset_w": 300, "asset_h": 410, "height": 200, "side": "right", "margin_x": 100, "margin_y": 50},
    {"asset": "lamp.png", "asset_w": 256, "asset_h": 199, "height": 120, "side": "left", "margin_x": 100, "margin_y": 50},
]


def _asset_sql(a):
    lw = int(a["asset_w"] * (a["height"] / a["asset_h"]))
    x = str(a["margin_x"]) if a["side"] == "left" else f"image_width - {lw + a['margin_x']}"
    return (f"SELECT image_path, '{a['asset']}' AS asset, {lw} AS layer_w, {a['height']} AS layer_h, cast({x} as int) AS layer_x, "
            f"image_height - {a['height'] + a['margin_y']} AS layer_y FROM e")


@query("fallback_layers", f"""WITH {DET}, e AS (SELECT DISTINCT image_path, image_width, image_height FROM det WHERE image_path NOT IN
  (SELECT image_path FROM det WHERE {_RW} IS NOT NULL)) {' UNION ALL '.join(_asset_sql(a) for a in ASSETS)}""")
def fallback_layers(spark, sf):
    d = V.detections(spark, sf, [*SIZED, "label"])
    images = d.select("image_path", "image_width", "image_height").distinct()
    return B.fallback_layers(images, B.place_layers(d, RULES), ASSETS)


# Re-rendered views of large crops: three per crop, some missing.
_VIEWS = "views AS (SELECT stem, mv_crop_no, v, concat(stem, '/', cast(mv_crop_no as bigint), '/', v, '.png') AS path FROM numbered, (VALUES (1), (2), (3)) t(v) WHERE mv_crop_no IS NOT NULL AND (cast(quantity as bigint) + v) % 4 <> 0)"


def _view_table(numbered):
    return numbered.where(F.col("mv_crop_no").isNotNull()).select(
        "stem", "mv_crop_no", "quantity", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("view")
    ).where((F.col("quantity").cast("long") + F.col("view")) % 4 != 0).select(
        "stem", "mv_crop_no", "view", F.concat_ws("/", "stem", F.col("mv_crop_no").cast("string"),
                                                  F.concat(F.col("view").cast("string"), F.lit(".png"))).alias("path"))


@query("chosen_views", f"""WITH {DET}, {NUM}, {_VIEWS}, ranked AS (SELECT stem, mv_crop_no, path, row_number() OVER (PARTITION BY stem, mv_crop_no ORDER BY md5(path), path) - 1 AS view_no,
  count(*) OVER (PARTITION BY stem, mv_crop_no) AS n FROM views),
  sizes AS (SELECT DISTINCT stem, mv_crop_no, n FROM ranked),
  asked AS (SELECT d.image_path, d.crop_no, d.stem, d.mv_crop_no, CASE WHEN s.n > 0 AND {V.unit(3, 'use_view', 'd.image_path', 'd.crop_no')} < 0.8::DOUBLE THEN {V.u32(3, 'view', 'd.image_path', 'd.crop_no')} % s.n END AS view_no
    FROM numbered d LEFT JOIN sizes s ON d.stem = s.stem AND d.mv_crop_no = s.mv_crop_no)
  SELECT a.image_path, a.crop_no, r.path AS view_path, CASE WHEN r.path IS NULL THEN 'source' ELSE 'multiview' END AS crop_source
  FROM asked a LEFT JOIN ranked r ON a.stem = r.stem AND a.mv_crop_no = r.mv_crop_no AND a.view_no = r.view_no""")
def chosen_views(spark, sf):
    n = B.crop_numbers(V.detections(spark, sf, [*BOX, "stem", "quantity"]))
    crops = n.select("image_path", "crop_no", "stem", "mv_crop_no")
    return B.choose_views(crops, _view_table(n), 0.8, 3).select("image_path", "crop_no", "view_path", "crop_source")


@query("pending_views", f"""WITH {DET}, {NUM}, {_VIEWS}, w AS (SELECT stem, mv_crop_no, t.v AS v FROM numbered, (VALUES (1), (2), (3)) t(v) WHERE mv_crop_no IS NOT NULL)
  SELECT w.stem, cast(w.mv_crop_no as bigint) AS crop_no, string_agg(cast(w.v as varchar), ',' ORDER BY w.v) AS pending
  FROM w LEFT JOIN views x ON w.stem = x.stem AND w.mv_crop_no = x.mv_crop_no AND w.v = x.v WHERE x.v IS NULL GROUP BY 1, 2""")
def pending_views(spark, sf):
    n = B.crop_numbers(V.detections(spark, sf, [*BOX, "stem", "quantity"]))
    views = _view_table(n).withColumnRenamed("mv_crop_no", "crop_no")
    crops = n.where(F.col("mv_crop_no").isNotNull()).select("stem", F.col("mv_crop_no").alias("crop_no"))
    p = M.pending_views(crops, views, 3)
    return p.select("stem", "crop_no", F.array_join(F.col("pending").cast("array<string>"), ",").alias("pending"))


@query("missing_view_rows", f"""WITH {DET}, {NUM}, {_VIEWS} SELECT stem, cast(mv_crop_no as bigint) AS crop_no, t.v AS view FROM numbered, (VALUES (1), (2), (3)) t(v) WHERE mv_crop_no IS NOT NULL
  EXCEPT SELECT stem, cast(mv_crop_no as bigint), v FROM views""")
def missing_view_rows(spark, sf):
    n = B.crop_numbers(V.detections(spark, sf, [*BOX, "stem", "quantity"]))
    views = _view_table(n).withColumnRenamed("mv_crop_no", "crop_no")
    crops = n.where(F.col("mv_crop_no").isNotNull()).select("stem", F.col("mv_crop_no").alias("crop_no"))
    return M.missing_view_rows(crops, views, 3)


@query("canvas_sources", f"""WITH {DET}, i AS (SELECT image_path, CASE order_key % 10 WHEN 0 THEN 'skip_missing' WHEN 1 THEN 'skip_unreadable' ELSE 'ok' END AS status,
  count(*) FILTER (quantity > 25) AS mv, count(*) FILTER (quantity <= 25) AS sc FROM det GROUP BY image_path, order_key)
  SELECT count(*) FILTER (status = 'ok') AS images_written, cast(sum(mv) FILTER (status = 'ok') as bigint) AS multiview_crops,
  cast(sum(sc) FILTER (status = 'ok') as bigint) AS source_crops, count(*) FILTER (status = 'skip_missing') AS skipped_missing,
  count(*) FILTER (status = 'skip_unreadable') AS skipped_unreadable FROM i""")
def canvas_sources(spark, sf):
    d = V.detections(spark, sf, ["image_path", "order_key", "quantity"])
    k = F.col("order_key") % 10
    status = F.when(k == 0, "skip_missing").when(k == 1, "skip_unreadable").otherwise("ok")
    i = d.groupBy("image_path", status.alias("status")).agg(
        F.count_if(F.col("quantity") > 25).alias("n_multiview"), F.count_if(F.col("quantity") <= 25).alias("n_source"))
    return B.canvas_sources(i)
