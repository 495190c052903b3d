"""Box geometry as column expressions (no shuffles, whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright import constants as K


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def half_even(x) -> Column:
    """Nearest integer, ties to even."""
    return F.bround(_c(x).cast("double"), 0).cast("int")


def clamp(x, lo, hi) -> Column:
    return F.greatest(_c(lo), F.least(_c(x), _c(hi)))


def side_columns(x1="x1", y1="y1", x2="x2", y2="y2") -> list[Column]:
    w, h = F.col(x2) - F.col(x1), F.col(y2) - F.col(y1)
    return [
        w.alias("w"), h.alias("h"),
        F.least(w, h).alias("min_side"), F.greatest(w, h).alias("max_side"),
        (w * h).alias("area"),
    ]


def clamped_area(x1, y1, x2, y2) -> Column:
    """Each side floored at zero, so an inverted box has no area."""
    return F.greatest(F.lit(0.0), _c(x2) - _c(x1)) * F.greatest(F.lit(0.0), _c(y2) - _c(y1))


def product_clamped_area(x1, y1, x2, y2) -> Column:
    """Product floored at zero: two inverted sides still give a positive area."""
    return F.greatest(F.lit(0.0), (_c(x2) - _c(x1)) * (_c(y2) - _c(y1)))


def box_record(found, label, score, x1, y1, x2, y2, width, height) -> list[Column]:
    """Rounded corners, normalised corners and score; nulls when nothing was found."""
    def keep(c: Column) -> Column:
        return F.when(_c(found), c)

    corners = [F.bround(_c(v), 2) for v in (x1, y1, x2, y2)]
    norms = [
        F.bround(_c(v) / _c(s), 6) for v, s in ((x1, width), (y1, height), (x2, width), (y2, height))
    ]
    names = ["xmin", "ymin", "xmax", "ymax"]
    as_struct = lambda cols: F.struct(*[c.alias(n) for c, n in zip(cols, names)])
    return [
        _c(found).alias("found"), keep(_c(label)).alias("label"), keep(F.bround(_c(score), 6)).alias("score"),
        keep(F.array(*corners)).alias("bbox"), keep(F.array(*norms)).alias("bbox_norm"),
        keep(as_struct(corners)).alias("xyxy"), keep(as_struct(norms)).alias("xyxy_norm"),
    ]


def pad_box(x1, y1, x2, y2, width, height, frac: float) -> list[Column]:
    """Box grown by a fraction of its own size and clamped to the image."""
    px, py = (_c(x2) - _c(x1)) * F.lit(float(frac)), (_c(y2) - _c(y1)) * F.lit(float(frac))
    return [
        F.greatest(F.lit(0.0), _c(x1) - px), F.greatest(F.lit(0.0), _c(y1) - py),
        F.least(_c(width).cast("double"), _c(x2) + px), F.least(_c(height).cast("double"), _c(y2) + py),
    ]


def crop_box(x1, y1, x2, y2, width, height, frac: float, min_side: int = K.MIN_CROP_SIDE):
    """Integer crop corners after padding, and the reason when the crop is too small."""
    cx1, cy1, cx2, cy2 = [half_even(v) for v in pad_box(x1, y1, x2, y2, width, height, frac)]
    cx2, cy2 = F.greatest(cx2, cx1 + 1), F.greatest(cy2, cy1 + 1)
    small = ((cx2 - cx1) < min_side) | ((cy2 - cy1) < min_side)
    return [cx1, cy1, cx2, cy2], F.when(small, "box_too_small")


def clamp_box(x1, y1, x2, y2, width, height) -> list[Column]:
    """Rounded corners inside the image, at least one pixel wide and high."""
    ix1 = clamp(half_even(x1), 0, _c(width) - 1)
    iy1 = clamp(half_even(y1), 0, _c(height) - 1)
    ix2 = F.greatest(ix1 + 1, F.least(half_even(x2), _c(width)))
    iy2 = F.greatest(iy1 + 1, F.least(half_even(y2), _c(height)))
    return [ix1, iy1, ix2, iy2]


def _valid_size(*sizes) -> Column:
    ok = F.lit(True)
    for s in sizes:
        ok = ok & (_c(s) >= 1)
    return ok


def letterbox_layout(width, height, canvas_w=K.CANVAS_WIDTH, canvas_h=K.CANVAS_HEIGHT) -> list[Column]:
    """scale, off_x, off_y, new width, new height; all null for an invalid size."""
    ok = _valid_size(width, height, canvas_w, canvas_h)
    cw, ch = _c(canvas_w), _c(canvas_h)
    scale = F.least(cw / _c(width), ch / _c(height))
    nw = F.greatest(F.lit(1), F.least(cw, half_even(_c(width) * scale)))
    nh = F.greatest(F.lit(1), F.least(ch, half_even(_c(height) * scale)))
    off_x = F.floor((cw - nw) / 2).cast("int")
    off_y = F.floor((ch - nh) / 2).cast("int")
    return [F.when(ok, c) for c in (scale, off_x, off_y, nw.cast("int"), nh.cast("int"))]


def cover_layout(width, height, canvas_w=K.TARGET_WIDTH, canvas_h=K.TARGET_HEIGHT) -> list[Column]:
    """scale, crop_left, crop_top, new width, new height; all null for an invalid size."""
    ok = _valid_size(width, height, canvas_w, canvas_h)
    cw, ch = _c(canvas_w), _c(canvas_h)
    scale = F.greatest(cw / _c(width), ch / _c(height))
    nw = F.greatest(F.lit(1), half_even(_c(width) * scale))
    nh = F.greatest(F.lit(1), half_even(_c(height) * scale))
    left = F.greatest(F.lit(0), F.floor((nw - cw) / 2).cast("int"))
    top = F.greatest(F.lit(0), F.floor((nh - ch) / 2).cast("int"))
    return [F.when(ok, c) for c in (scale, left, top, nw, nh)]


def _inside_canvas(X1, Y1, X2, Y2, canvas_w, canvas_h) -> list[Column]:
    X1, Y1 = clamp(X1, 0, _c(canvas_w) - 1), clamp(Y1, 0, _c(canvas_h) - 1)
    X2 = F.greatest(X1 + 1, F.least(X2, _c(canvas_w)))
    Y2 = F.greatest(Y1 + 1, F.least(Y2, _c(canvas_h)))
    return [X1, Y1, X2, Y2]


def box_to_letterbox(x1, y1, x2, y2, scale, off_x, off_y, canvas_w=K.CANVAS_WIDTH, canvas_h=K.CANVAS_HEIGHT):
    """Clamped source box to letterboxed canvas coordinates."""
    moved = [
        _c(off) + half_even(_c(v) * _c(scale)) for v, off in ((x1, off_x), (y1, off_y), (x2, off_x), (y2, off_y))
    ]
    return _inside_canvas(*moved, canvas_w, canvas_h)


def box_to_cover(x1, y1, x2, y2, scale, left, top, canvas_w=K.TARGET_WIDTH, canvas_h=K.TARGET_HEIGHT):
    """Clamped source box to the centre-cropped viewport."""
    moved = [
        half_even(_c(v) * _c(scale)) - _c(off) for v, off in ((x1, left), (y1, top), (x2, left), (y2, top))
    ]
    return _inside_canvas(*moved, canvas_w, canvas_h)


def snap16(x) -> Column:
    """Nearest multiple of 16, ties to the even multiple."""
    return half_even(_c(x) / F.lit(float(K.SIZE_MULTIPLE))) * K.SIZE_MULTIPLE


def target_size(width, height, long_side: int) -> list[Column]:
    """Width and height scaled so that the long side is ``long_side``, both multiples of 16."""
    long = F.greatest(_c(width), _c(height))
    return [snap16(F.lit(long_side) * _c(width) / long), snap16(F.lit(long_side) * _c(height) / long)]


def fit_scale(content_w, content_h, x1, y1, x2, y2, fit: str, rot_deg) -> Column:
    """Uniform scale that fits a rotated rectangle in a box (``contain`` or ``cover``)."""
    theta = F.radians(_c(rot_deg))
    c, s = F.abs(F.cos(theta)), F.abs(F.sin(theta))
    span_w = c * _c(content_w) + s * _c(content_h)
    span_h = s * _c(content_w) + c * _c(content_h)
    sx = F.greatest(F.lit(1.0), _c(x2) - _c(x1)) / F.greatest(span_w, F.lit(1e-6))
    sy = F.greatest(F.lit(1.0), _c(y2) - _c(y1)) / F.greatest(span_h, F.lit(1e-6))
    if fit not in ("contain", "cover"):
        raise ValueError(f"unknown fit {fit!r}")
    return F.least(sx, sy) if fit == "contain" else F.greatest(sx, sy)


def similarity_terms(scale, rot_deg, src_cx, src_cy, dst_cx, dst_cy) -> list[Column]:
    """a, b, tx, ty of ``[a b tx; -b a ty; 0 0 1]`` that maps one centre to the other."""
    theta = F.radians(_c(rot_deg))
    a, b = _c(scale) * F.cos(theta), -_c(scale) * F.sin(theta)
    tx = _c(dst_cx) - (a * _c(src_cx) + b * _c(src_cy))
    ty = _c(dst_cy) - (a * _c(src_cy) - b * _c(src_cx))
    return [a, b, tx, ty]


def similarity_matrix(a, b, tx, ty) -> Column:
    row = lambda *v: F.array(*[_c(x).cast("double") for x in v])
    return F.array(row(a, b, tx), row(-_c(b), a, ty), row(0.0, 0.0, 1.0))


def transform_summary(a, b, tx, ty) -> list[Column]:
    return [
        F.hypot(_c(a), _c(b)).alias("scale"),
        F.degrees(F.atan2(-_c(b), _c(a))).alias("rotation_deg"),
        _c(tx).alias("tx"), _c(ty).alias("ty"),
    ]
