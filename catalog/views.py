"""Stand-in views: the operators' input tables derived from the star-schema tables.

Every view is one list of (column, expression) pairs that Spark SQL and DuckDB
both accept, so the two sides of a check cannot drift apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


X1 = "(l_partkey % 1000 + l_discount*10)"
Y1 = "((l_suppkey*7) % 500 + l_tax*10)"
DETECTION_COLUMNS = [
    ("image_path", "concat('img_', lpad(cast(l_orderkey as string), cast(greatest(7, length(cast(l_orderkey as string))) as int), '0'), '.png')"),
    ("stem", "concat('img_', lpad(cast(l_orderkey as string), cast(greatest(7, length(cast(l_orderkey as string))) as int), '0'))"),
    ("class_id", "p_size"),
    ("class_name", "case when p_size % 10 = 0 then null else p_type end"),
    ("confidence", "l_extendedprice / 100000"),
    ("x1", X1),
    ("y1", Y1),
    ("x2", f"{X1} + l_quantity*9 - 20"),
    ("y2", f"{Y1} + l_linenumber*60 - cast(30.5 as double)"),
    ("image_width", "cast(1280 + 128*(l_orderkey % 6) as int)"),
    ("image_height", "cast(720 + 72*(l_orderkey % 4) as int)"),
    ("root", "case when l_suppkey % 11 = 0 then 'small' else 'large' end"),
    ("order_key", "l_orderkey"),
    ("label", "p_name"),
    ("found", "l_returnflag <> 'R'"),
    ("quantity", "l_quantity"),
    ("line", "l_linenumber"),
]

SAMPLE_ID = "concat('theme', cast({k} % 7 as string), '_', lpad(cast({k} as string), cast(greatest(9, length(cast({k} as string))) as int), '0'))"


def sample_id(key: str) -> str:
    return SAMPLE_ID.replace("{k}", key)


_O = "o_orderkey"
_ID = sample_id(_O)
ORDER_VIEWS = {
    "theme_images": ([
        ("id", _ID),
        ("prompt", f"case when {_O} % 13 = 0 then null when {_O} % 11 = 0 then '' else concat('scene ', cast({_O} as string)) end"),
        ("theme", f"case when {_O} % 4 = 0 then null else concat('theme', cast({_O} % 7 as string)) end"),
        ("structured_prompt", f"case when {_O} % 2 = 0 then '' else 'lines' end"),
        ("num_objects", f"cast({_O} % 6 as int)"),
        ("gen_width", f"cast(case when {_O} % 9 = 0 then 0 else 1280 end as int)"),
        ("gen_height", f"cast(case when {_O} % 9 = 0 then 0 else 720 end as int)"),
        ("seed", "o_custkey"),
        ("gt_image", f"concat('theme_images/', {_ID}, '.png')"),
        ("object_details", f"case when {_O} % 8 <> 0 then split(concat('tall ', cast({_O} % 5 as string), ',wide'), ',') end"),
        ("metadata", f"concat('theme_images/', {_ID}, '.json')"),
        ("model_id", "'generator'"),
    ], "true"),
    "theme_prompts": ([
        ("id", _ID),
        ("theme", f"concat('theme', cast({_O} % 7 as string))"),
        ("combined_prompt", f"case when {_O} % 17 = 0 then null else concat('combined ', cast({_O} as string)) end"),
        ("prompt", f"concat('plain ', cast({_O} as string))"),
        ("structured_prompt", "'fallback lines'"),
        ("num_objects", "cast(6 as int)"),
        ("object_details", f"case when {_O} % 16 <> 0 then split('plain,small,round', ',') end"),
        ("metadata", f"concat('theme_prompts/', {_ID}, '.json')"),
    ], "true"),
    "canvas": ([
        ("id", _ID),
        ("image", f"concat('canvas/', {_ID}, '.png')"),
        ("metadata", f"concat('canvas/', {_ID}, '.json')"),
        ("num_placements", f"cast({_O} % 5 as int)"),
        ("placements", f"split(concat('p', cast({_O} % 5 as string), ',q'), ',')"),
    ], f"{_O} % 3 <> 0"),
    "depth": ([
        ("id", _ID),
        ("image", f"concat('depth/', {_ID}, '.png')"),
        ("raw", f"concat('depth/', {_ID}, '.npy')"),
        ("metadata", f"concat('depth/', {_ID}, '.json')"),
        ("depth_type", "'relative'"),
        ("depth_min", "o_totalprice / 1000"),
        ("depth_max", "o_totalprice / 1000 + 5"),
        ("image_width", "cast(640 as int)"),
        ("image_height", "cast(360 as int)"),
    ], f"{_O} % 5 <> 0"),
    "bbox_meta": ([
        ("id", _ID),
        ("image_width", f"cast(case when {_O} % 18 = 0 then 0 else 1280 + 128*({_O} % 6) end as int)"),
        ("image_height", f"cast(case when {_O} % 18 = 0 then 0 else 720 + 72*({_O} % 4) end as int)"),
        ("bbox_information", f"split(concat('b', cast({_O} as string), ',c'), ',')"),
        ("metadata", f"concat('bbox/', {_ID}, '.json')"),
    ], f"{_O} % 7 <> 0"),
}

REF_COLUMNS = [
    ("id", "concat(d.source, '/', cast(d.doc_id as string))"),
    ("doc_id", "d.doc_id"),
    ("category", "case d.doc_id % 5 when 0 then 'celeb' when 1 then 'object' when 2 then 'cuisine' when 3 then 'landmark' else 'person' end"),
    ("quality", "case when l.quality = 1 then 'GOOD' when l.quality = 0 then 'BAD' end"),
    ("error", "case when d.doc_id % 17 = 0 then 'timeout' end"),
    ("caption", "case when d.doc_id % 19 = 0 then '' else d.text end"),
    ("text", "d.text"),
    ("raw_response", "concat('QUALITY: ', lower(case when l.quality = 1 then 'GOOD' when l.quality = 0 then 'BAD' else '?' end), chr(10), 'REASON: ', d.lang, chr(10), 'CAPTION: ', d.text)"),
    ("source", "d.source"),
]
_CAT = REF_COLUMNS[2][1]
REF_COLUMNS.append(
    ("saved_image_path", f"concat('outputs/', {_CAT}, '/images/', d.source, '/', cast(d.doc_id as string), '.jpg')")
)

MEMBER_COLUMNS = [
    ("tar_stem", "split_part(split_part(url, '/', 3), '.', 1)"),
    ("image_stem", "cast(page_id as string)"),
    ("member_no", "page_id"),
    ("member", "concat('./', cast(page_id as string), case when page_id % 9 = 0 then '.txt' when page_id % 7 = 0 then '.PNG' else '.jpg' end)"),
]


def _exprs(cols: list[tuple[str, str]], only: list[str] | None = None) -> list[str]:
    return [f"{e} AS {c}" for c, e in cols if only is None or c in only]


def detections(spark: SparkSession, sf: str, only: list[str] | None = None) -> DataFrame:
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.expr("l_partkey = p_partkey"))
    return j.selectExpr(*_exprs(DETECTION_COLUMNS, only))


def order_view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    cols, where = ORDER_VIEWS[name]
    return table(spark, sf, "orders").where(where).selectExpr(*_exprs(cols))


def refs(spark: SparkSession, sf: str, only: list[str] | None = None) -> DataFrame:
    d, l = table(spark, sf, "documents").alias("d"), table(spark, sf, "labels").alias("l")
    return d.join(l, "doc_id", "left").selectExpr(*_exprs(REF_COLUMNS, only))


def members(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").selectExpr(*_exprs(MEMBER_COLUMNS))


# ------------------------------------------------------------------ SQL forms

def det_sql(name: str = "det") -> str:
    return f"{name} AS (SELECT {', '.join(_exprs(DETECTION_COLUMNS))} FROM lineitem JOIN part ON l_partkey = p_partkey)"


def order_sql(view: str) -> str:
    cols, where = ORDER_VIEWS[view]
    return f"{view} AS (SELECT {', '.join(_exprs(cols))} FROM orders WHERE {where})"


def refs_sql(name: str = "refs") -> str:
    return f"{name} AS (SELECT {', '.join(_exprs(REF_COLUMNS))} FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def members_sql(name: str = "members") -> str:
    return f"{name} AS (SELECT {', '.join(_exprs(MEMBER_COLUMNS))} FROM pages)"


def numbered_sql(src: str = "det", name: str = "numbered", side: int = 200, where: str = "true") -> str:
    order = "confidence DESC, x1, y1, x2, y2"
    big = f"(x2 - x1 > {side} AND y2 - y1 > {side})"
    return (
        f"{name} AS (SELECT *, row_number() OVER (PARTITION BY image_path ORDER BY {order}) - 1 AS crop_no, "
        f"CASE WHEN {big} THEN sum(CASE WHEN {big} THEN 1 ELSE 0 END) OVER (PARTITION BY image_path ORDER BY {order} "
        f"ROWS UNBOUNDED PRECEDING) - 1 END AS mv_crop_no FROM {src} WHERE {where})"
    )


def u32(seed: int, salt: str, *keys: str) -> str:
    parts = ", ".join([f"'{seed}'", f"'{salt}'", *[f"cast({k} as varchar)" for k in keys]])
    return f"(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8))::BIGINT)"


def u60(seed: int, salt: str, *keys: str) -> str:
    return f"(('0x' || substr({digest(seed, salt, *keys)}, 1, 15))::BIGINT)"


def digest(seed: int, salt: str, *keys: str) -> str:
    parts = ", ".join([f"'{seed}'", f"'{salt}'", *[f"cast({k} as varchar)" for k in keys]])
    return f"md5(concat_ws('|', {parts}))"


def unit(seed: int, salt: str, *keys: str) -> str:
    return f"({u32(seed, salt, *keys)} / 4294967296.0::DOUBLE)"


def between(lo: float, hi: float, seed: int, salt: str, *keys: str) -> str:
    return f"({lo}::DOUBLE + {unit(seed, salt, *keys)} * {hi - lo!r}::DOUBLE)"


def quoted(values) -> str:
    """SQL list literal of strings."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
