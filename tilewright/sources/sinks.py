"""Sinks: manifests, keyed tables, previews, reports and byte export."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tilewright.functions import text as X

PREVIEW_CHARS = 60


def write_json_lines(df: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """One record per line, null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(folder)


def write_keyed(df: DataFrame, folder: str, *partition: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Records partitioned by category or theme instead of one file each.

    The rebalance hint merges small partitions and lets AQE split a large one, so
    a dominant category is written by many tasks.
    """
    df.hint("rebalance", *partition).write.mode(mode).partitionBy(*partition).format(fmt).save(folder)


def composition_preview(df: DataFrame) -> DataFrame:
    """Flat columns of composed samples for a CSV."""
    captions = F.transform("reference_captions", lambda c: F.substring(c, 1, PREVIEW_CHARS))
    return df.select(
        "id", F.size("reference_categories").alias("num_references"),
        F.concat_ws("|", "reference_categories").alias("ref_categories"),
        F.concat_ws(" || ", captions).alias("ref_captions_preview"),
        *[F.coalesce(f"conditions.{c}", F.lit("")).alias(c) for c in ("scale", "rotation", "lighting", "interaction")],
    )


def theme_preview(df: DataFrame) -> DataFrame:
    """Flat columns of theme prompts for a CSV."""
    joined = lambda f: F.concat_ws("|", F.transform("object_details", lambda d: d[f]))
    return df.select(
        "id", "theme", "shot_type", "has_character", joined("object").alias("objects"),
        joined("location_key").alias("locations"), joined("orientation_key").alias("orientations"),
        joined("color").alias("colors"), joined("material").alias("materials"), joined("surface_text").alias("surfaces"),
    )


def write_csv(df: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("emptyValue", "").option("nullValue", "").csv(folder)


def write_report(lines: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Ordered text lines of a report; reports are small aggregates, so one file."""
    lines.coalesce(1).write.mode(mode).text(folder)


def detection_totals(df: DataFrame) -> DataFrame:
    """Rows and distinct images of a detection table."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("image_path").alias("n_images"))


def append_metrics(df: DataFrame, folder: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(folder)


def export_names(shards: DataFrame, index_col: str = "row_no") -> DataFrame:
    """Output name per image: id, else ``<shard stem>_<8-digit number>``.

    The first holder of a name keeps it, the first holder in each other shard (and
    the second in the first holder's shard) gets the shard stem, and all further
    ones also their number. A name that still occurs twice (an id that looks like
    another one's extended name, or shards of equal stem) fails the job instead of
    overwriting an image. Holders are found by aggregates, so a much repeated id
    is not gathered in one task.
    """
    stem = X.file_stem(F.col("shard"))
    base = F.coalesce(
        F.when(F.col("id") != "", F.regexp_replace("id", r"[/\\]", "_")), F.concat(stem, F.format_string("_%08d", index_col))
    )
    named = shards.withColumn("base", base).withColumn("ext", X.extension_from_magic(F.col("content")))
    at = F.struct("shard", index_col)
    keys = ["base", "ext"]
    first = named.groupBy(*keys).agg(F.min(at).alias("first"))
    rest = named.join(first, keys).withColumn("repeated", at > F.col("first"))
    second = rest.where("repeated").groupBy(*keys, "shard").agg(F.min(index_col).alias("second"))
    j = rest.join(second, [*keys, "shard"], "left")
    longer = F.concat("base", F.lit("_"), stem)
    name = F.when(~F.col("repeated"), F.col("base")).when(F.col(index_col) == F.col("second"), longer).otherwise(
        F.concat(longer, F.format_string("_%08d", index_col)))
    out = j.select(*shards.columns, "ext", name.alias("name"))
    holders = out.groupBy("name", "ext").agg(F.count(F.lit(1)).alias("holders"))
    clash = F.raise_error(F.concat(F.lit("output name held twice: "), "name", "ext"))
    return out.join(holders, ["name", "ext"]).select(
        *shards.columns, "ext", F.when(F.col("holders") > 1, clash.cast("string")).otherwise(F.col("name")).alias("name"))


def write_bytes(named: DataFrame, folder: str) -> None:
    """Write each image to ``folder/name+ext`` from the executors (a shared folder).

    A file is written under a temporary name and moved, so a retried task leaves
    no half file.
    """
    def save(rows: Iterator[Row]) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            target = os.path.join(folder, r["name"] + r["ext"])
            part = f"{target}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(r["content"])
            os.replace(part, target)

    named.select("name", "ext", "content").foreachPartition(save)


def caption_texts(members: DataFrame, write_empty: bool) -> DataFrame:
    """Caption text per image; images without one get empty text or are left out."""
    if write_empty:
        return members.select("unq_id", F.coalesce("caption", F.lit("")).alias("caption"))
    return members.where(F.col("caption").isNotNull()).select("unq_id", "caption")
