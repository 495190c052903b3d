"""File sources: JSON lines, sidecars, detection CSVs, captions, listings and image shards."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from tilewright import constants as K
from tilewright.functions import text as X

_CORRUPT = "_corrupt"


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """Tolerant JSON lines: (records, rejected lines with their file).

    Blank lines are ignored; a malformed line goes to the second table.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = lines.where(X.strip(F.col("value")) != "")
    parsed = lines.withColumn(
        "r", F.from_json("value", f"{schema}, {_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    )
    good = parsed.where(F.col(f"r.{_CORRUPT}").isNull()).select("r.*").drop(_CORRUPT)
    bad = parsed.where(F.col(f"r.{_CORRUPT}").isNotNull()).select("file", "value")
    return good, bad


def json_lines_strict(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines in which a malformed line, or no line at all, is an error."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if df.isEmpty():
        raise ValueError(f"manifest is empty: {path}")
    return df


def sidecars(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON document per file; the id is the field, else the file stem."""
    df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    stem = X.file_stem(F.col("_metadata.file_name"))
    return df.select(
        F.coalesce(F.when(F.col("id") != "", F.col("id")), stem).alias("id"), stem.alias("stem"),
        *[c for c in df.columns if c != "id"],
    )


def detections_csv(
    spark: SparkSession, path: str | list[str],
    required: Sequence[str] = ("x1", "y1", "x2", "y2", "image_path", "class_name", "confidence"),
    with_file: bool = False,
) -> DataFrame:
    """Detection rows as text: header names and values stripped, nulls as empty strings.

    A missing required column is an error. Corners are parsed later, row by row
    (``parsed_boxes``), so one bad value never fails the file.
    """
    raw = spark.read.option("header", True).csv(path)
    names = [c.strip() for c in raw.columns]
    lacking = [c for c in required if c not in names]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    cols = [X.strip(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(n) for c, n in zip(raw.columns, names)]
    if with_file:
        cols.append(F.col("_metadata.file_path").alias("file"))
    return raw.select(*cols)


def split_roots(text: str | None) -> list[str]:
    """Root folders from a list split on newline, comma or semicolon."""
    return [p.strip() for p in re.split(r"[\n,;]+", text or "") if p.strip()]


def root_layout(root: str) -> dict[str, str]:
    root = root.rstrip("/")
    return {
        "csv": f"{root}/{K.ROOT_DETECTIONS}", "images": f"{root}/{K.ROOT_IMAGES}", "depth": f"{root}/{K.ROOT_DEPTH}",
        "captions": f"{root}/{K.ROOT_CAPTIONS}", "multiview": f"{root}/{K.ROOT_MULTIVIEW}",
    }


def dataset_roots(spark: SparkSession, text: str) -> DataFrame:
    """Detections of several dataset roots, with a ``root`` column; a root may be a glob pattern.

    A root without its CSV fails the read. Each root is a scan of its own under its own header, and its name a constant:
    taken from the address of every row, it costs more than parsing the row.
    """
    out = None
    for root in [found for r in split_roots(text) for found in _roots_found(spark, r)]:
        part = detections_csv(spark, root_layout(root)["csv"]).withColumn("root", F.lit(re.sub("^file:/*", "/", root)))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no dataset root given")
    return out.na.fill("")  # columns that another root lacks


def _roots_found(spark: SparkSession, root: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root_layout(root)["csv"])
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [str(f.getPath().toString()) for f in system.globStatus(path) or []]
    if not found:
        raise ValueError(f"no {K.ROOT_DETECTIONS} below {root}")
    return [f[: -len("/" + K.ROOT_DETECTIONS)] for f in found]


def caption_files(spark: SparkSession, folder: str) -> DataFrame:
    """One caption per text file: (stem, path, caption)."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return df.select(
        X.file_stem(F.col("_metadata.file_name")).alias("stem"), F.col("_metadata.file_path").alias("path"),
        X.strip(F.col("value")).alias("caption"),
    )


# -------------------------------------------------------------------- listings

def _listing(spark: SparkSession, paths, recursive: bool) -> DataFrame:
    """Paths and lengths of non-empty files; the content column is pruned, so no bytes are read."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    return reader.load(paths).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length")


def listed_root(spark: SparkSession, root: str) -> str:
    """A folder as listings spell it: qualified by its file system, on the local one without a scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return re.sub("^file:/*", "/", system.makeQualified(path).toString())


def images_by_glob(spark: SparkSession, globs: dict[str, str]) -> DataFrame:
    """Images per category from one glob pattern each: (category, path, length)."""
    out = None
    for category, pattern in globs.items():
        part = _listing(spark, pattern, False).withColumn("category", F.lit(category))
        out = part if out is None else out.unionByName(part)
    return out.select("category", "path", "length")


def images_under(
    spark: SparkSession, root: str, suffixes: Sequence[str] = tuple(K.CAPTION_INPUT_SUFFIXES), recursive: bool = True
) -> DataFrame:
    """Image files by suffix in either case; a listing names each path once.

    Order by :func:`listing_order` where an order is needed.
    """
    df = _listing(spark, root, recursive)
    return df.where(X.file_suffix(F.col("path")).isin(*suffixes))


def listing_order() -> list:
    return [F.lower("path").asc(), F.asc("path")]


def depth_inputs(spark: SparkSession, root: str) -> DataFrame:
    """Images to estimate depth for: no top-level ``depth`` folder, no depth outputs.

    The root may be written with or without its scheme, or relative to the working folder.
    """
    df = images_under(spark, root, K.DEPTH_INPUT_SUFFIXES)
    rel = X.relative_to(F.col("path"), listed_root(spark, root))
    stem = F.lower(X.file_stem(F.col("path")))
    return df.withColumn("rel", rel).where(~F.col("rel").startswith("depth/") & ~stem.rlike("_depth(_raw)?$"))


def split_empty(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """Wanted paths with ``skip_reason`` ``missing`` or ``empty``; null for files to use.

    ``listing`` comes from :func:`tilewright.sources.listing.folder_files`.
    """
    reason = F.when(F.col("length").isNull(), "missing").when(F.col("length") == 0, "empty")
    return wanted.join(listing.select("path", "length"), "path", "left").withColumn("skip_reason", reason)


def skip_counts(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("skip_reason") == "empty").alias("n_empty"),
        F.count_if(F.col("skip_reason") == "missing").alias("n_missing"),
    )


# ---------------------------------------------------------------- image shards

def image_column(schema: StructType, wanted: str | None = None) -> str:
    """Named column, else the first that is binary or a struct with binary ``bytes``."""
    def holds_bytes(t) -> bool:
        if isinstance(t, BinaryType):
            return True
        return isinstance(t, StructType) and any(f.name == "bytes" and isinstance(f.dataType, BinaryType) for f in t)

    if wanted is not None:
        if wanted not in schema.names:
            raise ValueError(f"no column {wanted!r}")
        return wanted
    for f in schema:
        if holds_bytes(f.dataType):
            return f.name
    raise ValueError("no image column")


def _shard_reader(spark: SparkSession) -> DataFrameReader:
    return (
        spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True).option("pathGlobFilter", "*.parquet")
    )


def image_shards(spark: SparkSession, path: str, column: str | None = None, id_column: str | None = None) -> DataFrame:
    """Image bytes of all Parquet shards below a folder: (shard, row_index, id, content).

    Unreadable files are skipped; :func:`shard_report` names them. ``row_index`` is the row's place in its file,
    so a running number needs no sort.
    """
    try:
        df = _shard_reader(spark).parquet(path)
    except AnalysisException as failed:  # the one file that the columns are taken from is unreadable: look at all
        if failed.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        df = _shard_reader(spark).option("mergeSchema", True).parquet(path)
    name = image_column(df.schema, column)
    cell = F.col(name) if isinstance(df.schema[name].dataType, BinaryType) else F.col(f"{name}.bytes")
    ident = F.col(id_column).cast("string") if id_column else F.lit(None).cast("string")
    return df.select(
        F.col("_metadata.file_path").alias("shard"), F.col("_metadata.row_index").alias("row_index"),
        ident.alias("id"), cell.alias("content"),
    ).where(F.col("content").isNotNull())


def shard_report(spark: SparkSession, path: str) -> DataFrame:
    """Every Parquet shard below a folder: (shard, length, n_rows, status).

    ``status`` is ``read`` or ``no_rows`` (unreadable, or readable without a row;
    n_rows is 0). Spark's listing leaves out files without bytes. It reads no
    contents, and the counts read no column.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    found = found.select(X.file_url(F.col("path")).alias("shard"), "length")
    rows = (
        _shard_reader(spark).schema(StructType([])).parquet(path)
        .groupBy(X.file_url(F.col("_metadata.file_path")).alias("shard")).agg(F.count(F.lit(1)).alias("n_rows"))
    )
    n = F.coalesce("n_rows", F.lit(0))
    status = F.when(n > 0, "read").otherwise("no_rows")
    return found.join(rows, "shard", "left").select("shard", "length", n.alias("n_rows"), status.alias("status"))


def find_by_id(spark: SparkSession, paths: str | list[str], wanted: str, key: str = "id") -> DataFrame:
    """First row with an id; the filter reaches the Parquet scan, which skips row groups."""
    return spark.read.option("recursiveFileLookup", True).parquet(*([paths] if isinstance(paths, str) else paths)).where(
        F.col(key) == wanted
    ).limit(1)
