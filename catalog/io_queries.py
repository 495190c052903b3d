"""Sources, sinks, streaming and model calls, each fed from the tables through files written for the run."""

from __future__ import annotations

import hashlib
import os
import struct
import zlib

from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import query
from catalog.text_queries import CONDITION_SQL, REFS, REPORT_SQL, SECTIONS, conditions, event_records
from tilewright import schemas
from tilewright.functions import text as X
from tilewright.operators import quality as Q
from tilewright.operators.apply import apply_model, content_boxes
from tilewright.operators.ranking import global_ordinal
from tilewright.session import scratch_dir
from tilewright.sources import archives, files, sinks
from tilewright.sources.listing import folder_files
from tilewright.streaming import incremental as inc

_COLS = "id, category, quality, error, saved_image_path"


def manifest_rows(spark, sf):
    return V.refs(spark, sf, ["id", "category", "quality", "error", "saved_image_path"])


@query("json_lines", f"WITH {REFS} SELECT {_COLS} FROM refs")
def json_lines(spark, sf):
    """Manifest written with blank and broken lines between the records; the good ones come back whole."""
    out = scratch_dir(spark, "jsonl")
    rows = manifest_rows(spark, sf)
    lines = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    noise = rows.where("category = 'celeb'").select(F.explode(F.array(F.lit(""), F.lit("   "), F.lit('{"id": "cut'))).alias("value"))
    lines.union(noise).write.text(out)
    good, _ = files.json_lines(spark, out, schemas.REFS)
    return good.select(*_COLS.split(", "))


@query("json_rejects", f"WITH {REFS} SELECT '{{\"id\": \"cut' AS value, count(*) AS n FROM refs WHERE category = 'celeb'")
def json_rejects(spark, sf):
    out = scratch_dir(spark, "rejects")
    manifest_rows(spark, sf).select(F.when(F.col("category") == "celeb", '{"id": "cut').otherwise(F.to_json(F.struct("*"))).alias("value")).write.text(out)
    _, bad = files.json_lines(spark, out, schemas.REFS)
    return bad.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("json_lines_strict", f"WITH {REFS} SELECT {_COLS} FROM refs")
def json_lines_strict(spark, sf):
    out = scratch_dir(spark, "strict")
    sinks.write_json_lines(manifest_rows(spark, sf), out)
    return files.json_lines_strict(spark, out, schemas.REFS).select(*_COLS.split(", "))


@query("keyed_table", f"WITH {REFS} SELECT category, count(*) AS n, count(DISTINCT id) AS n_ids FROM refs WHERE category <> 'person' GROUP BY 1")
def keyed_table(spark, sf):
    """Records partitioned by category; reading one category opens only its folder."""
    out = scratch_dir(spark, "keyed")
    sinks.write_keyed(manifest_rows(spark, sf), out, "category")
    back = spark.read.parquet(out).where("category <> 'person'")
    return back.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"))


@query("mirrored_table", f"WITH {REFS} SELECT category, source AS rel_dir, count(*) AS n FROM refs GROUP BY 1, 2")
def mirrored_table(spark, sf):
    out = scratch_dir(spark, "mirror")
    r = V.refs(spark, sf, ["doc_id", "category", "source"])
    path = F.concat(F.lit("/pool/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    m = r.select("category", *X.mirrored_paths(F.col("category"), path, "/pool", "out"))
    sinks.write_keyed(m, out, "category", "rel_dir", fmt="json")
    return spark.read.json(out, "id string, saved_image_path string, category string, rel_dir string").groupBy("category", "rel_dir").agg(F.count(F.lit(1)).alias("n"))


@query("preview_csv", f"""WITH {CONDITION_SQL} SELECT id, cast(len(cats) as varchar) AS num_references, array_to_string(cats, '|') AS ref_categories,
  scale, rotation, lighting, interaction FROM k""")
def preview_csv(spark, sf):
    """The written rows as text; captions are empty here, so their column (null once read) is left to composition_preview."""
    out = scratch_dir(spark, "preview")
    sinks.write_csv(sinks.composition_preview(conditions(spark, sf)), out)
    back = spark.read.option("header", True).csv(out)
    return back.select("id", "num_references", *[F.coalesce(c, F.lit("")).alias(c) for c in (
        "ref_categories", "scale", "rotation", "lighting", "interaction")])


@query("report_text", REPORT_SQL)
def report_text(spark, sf):
    out = scratch_dir(spark, "report")
    sinks.write_report(Q.report_lines(Q.composition_distribution(conditions(spark, sf)), SECTIONS), out)
    return spark.read.text(out)


@query("appended_metrics", "SELECT l_linenumber AS global_step, count(*) AS n, cast(2 as bigint) AS n_appends FROM lineitem GROUP BY 1")
def appended_metrics(spark, sf):
    out = scratch_dir(spark, "metrics")
    m = V.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("global_step")).agg(F.count(F.lit(1)).alias("n"))
    sinks.append_metrics(m, out)
    sinks.append_metrics(m, out)
    back = spark.read.json(out, "global_step int, n bigint")
    return back.groupBy("global_step").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("n_appends"))


_DETS = V.det_sql()


@query("detections_csv", f"WITH {_DETS} SELECT image_path, coalesce(class_name, '') AS class_name, confidence, x1, y1, x2, y2 FROM det")
def detections_csv(spark, sf):
    """Padded header names and values are stripped; nulls come back as empty text."""
    out = scratch_dir(spark, "csv")
    d = V.detections(spark, sf, ["image_path", "class_name", "confidence", "x1", "y1", "x2", "y2"])
    sinks.write_csv(d.select(*[F.col(c).alias(f" {c} ") for c in d.columns]), out)
    return files.detections_csv(spark, out).select(
        "image_path", "class_name", *[F.col(c).cast("double").alias(c) for c in ("confidence", "x1", "y1", "x2", "y2")])


@query("dataset_roots", f"WITH {_DETS} SELECT root, count(*) AS n, count(DISTINCT image_path) AS n_images FROM det GROUP BY 1")
def dataset_roots(spark, sf):
    base = scratch_dir(spark, "roots")
    d = V.detections(spark, sf, ["root", "image_path", "class_name", "confidence", "x1", "y1", "x2", "y2"])
    for r in ("small", "large"):
        sinks.write_csv(d.where(F.col("root") == r).drop("root"), files.root_layout(f"{base}/{r}")["csv"])
    back = files.dataset_roots(spark, f"{base}/small; {base}/large\n")
    return back.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("image_path").alias("n_images")).withColumn(
        "root", X.file_name(F.col("root")))


# -------------------------------------------------- byte tables and image files

@query("image_shard_index", "SELECT count(*) AS n, min(doc_id) AS first_id, cast(0 as bigint) AS min_no, count(*) - 1 AS max_no, count(*) AS n_distinct FROM documents WHERE doc_id % 10 <> 3")
def image_shard_index(spark, sf):
    """Running number over non-null images of all shards, from counts per block of rows."""
    shards = files.image_shards(spark, _shards(spark, sf), id_column="id")
    block = F.floor(F.col("row_index") / 65536)
    n = global_ordinal(shards, [F.asc("shard"), F.asc("row_index")], [F.col("shard"), block], "global_idx")
    return n.agg(F.count(F.lit(1)).alias("n"), F.min(F.col("id").cast("long")).alias("first_id"), F.min("global_idx").alias("min_no"),
                 F.max("global_idx").alias("max_no"), F.count_distinct("global_idx").alias("n_distinct"))


def _shards(spark, sf):
    """Shards as many as the table has input splits (4 at least), so that none grows with the table."""
    out = scratch_dir(spark, "shards")
    documents = V.table(spark, sf, "documents")
    d = documents.select(
        F.col("doc_id").cast("string").alias("id"), F.struct(F.when(F.col("doc_id") % 10 != 3, F.concat(
            F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("FFD8FFE0"))).otherwise(F.unhex(F.lit("89504E470D0A1A0A"))), F.col("text").cast("binary")
        )).alias("bytes"), F.lit("p").alias("path")).alias("image"))
    d.repartition(max(4, documents.rdd.getNumPartitions()), "id").write.parquet(out)
    return out


@query("export_names", "SELECT CASE WHEN doc_id % 2 = 0 THEN '.jpg' ELSE '.png' END AS ext, concat('id_', doc_id % 400) AS base, count(*) AS n, cast(1 as bigint) AS n_plain, count(*) AS n_names FROM documents WHERE doc_id % 10 <> 3 GROUP BY 1, 2")
def export_names(spark, sf):
    """Repeated ids: one holder keeps the plain name, the others get their shard's stem (and number); all names differ."""
    s = files.image_shards(spark, _shards(spark, sf), id_column="id").withColumn("id", F.concat(F.lit("id_"), (F.col("id").cast("long") % 400).cast("string")))
    e = sinks.export_names(s, "row_index")
    return e.groupBy("ext", F.col("id").alias("base")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("name") == F.col("id")).alias("n_plain"), F.count_distinct("name").alias("n_names"))


@query("found_by_id", "SELECT cast(doc_id as varchar) AS id, octet_length(encode(text)) + CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 8 END AS n_bytes FROM documents WHERE doc_id = 17")
def found_by_id(spark, sf):
    return files.find_by_id(spark, _shards(spark, sf), "17").select("id", F.length("image.bytes").cast("long").alias("n_bytes"))


def png(seed: str) -> bytes:
    """A small picture: white with a dark box whose place follows from the seed."""
    h = hashlib.md5(seed.encode()).digest()
    w, x, y, s = 24, h[0] % 10, h[1] % 10, 4 + h[2] % 8
    rows = b"".join(b"\0" + b"".join(b"\x20\x20\x20" if x <= i < x + s and y <= j < y + s else b"\xff\xff\xff" for i in range(w)) for j in range(w))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, w, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def _picture_folder(spark, sf):
    """One picture per supplier, written by the executors: a category folder, mixed-case suffixes and some other files."""
    root = scratch_dir(spark, "pictures")

    def save(rows):
        for r in rows:
            k = r["s_suppkey"]
            name = f"{k}{('.png', '.PNG', '.txt')[k % 3 if k % 3 < 2 else (2 if k % 6 == 5 else 0)]}"
            folder = os.path.join(root, "depth" if k % 10 == 0 else f"cat{k % 2}")
            os.makedirs(folder, exist_ok=True)
            stem = name if k % 7 else name.replace(".", "_depth.")
            with open(os.path.join(folder, stem), "wb") as f:
                f.write(b"" if k % 11 == 1 else png(str(k)))

    V.table(spark, sf, "supplier").select("s_suppkey").foreachPartition(save)
    return root


_SUFFIX = "CASE WHEN s_suppkey % 6 = 5 THEN '.txt' WHEN s_suppkey % 3 = 1 THEN '.PNG' ELSE '.png' END"
_NAME = f"concat(s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN '_depth' ELSE '' END, {_SUFFIX})"
_PIC = f"pic AS (SELECT s_suppkey AS k, {_NAME} AS name, {_SUFFIX} AS suffix, s_suppkey % 10 = 0 AS in_depth FROM supplier)"


@query("images_by_glob", f"WITH {_PIC} SELECT concat('c', k % 2) AS category, count(*) AS n FROM pic WHERE NOT in_depth AND suffix <> '.txt' AND k % 11 <> 1 GROUP BY 1")
def images_by_glob(spark, sf):
    root = _picture_folder(spark, sf)
    g = files.images_by_glob(spark, {f"c{i}": f"{root}/cat{i}/*.[pP][nN][gG]" for i in (0, 1)})
    return g.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("images_under", f"WITH {_PIC} SELECT name FROM pic WHERE suffix <> '.txt' AND k % 11 <> 1")
def images_under(spark, sf):
    return files.images_under(spark, _picture_folder(spark, sf)).orderBy(*files.listing_order()).select(X.file_name(F.col("path")).alias("name"))


@query("depth_inputs", f"WITH {_PIC} SELECT name FROM pic WHERE suffix <> '.txt' AND NOT in_depth AND k % 11 <> 1 AND name NOT LIKE '%_depth.%'")
def depth_inputs(spark, sf):
    return files.depth_inputs(spark, _picture_folder(spark, sf)).select(X.file_name(F.col("path")).alias("name"))


@query("skipped_files", f"WITH {_PIC} SELECT 2 * count(*) AS n_files, count(*) FILTER (k % 11 = 1) AS n_empty, count(*) AS n_missing FROM pic")
def skipped_files(spark, sf):
    """Every written picture and one that was never written per supplier, checked against the listing."""
    root = _picture_folder(spark, sf)
    there = folder_files(spark, root)
    never = V.table(spark, sf, "supplier").select(F.concat(F.lit(root + "/gone/"), F.col("s_suppkey").cast("string")).alias("path"))
    return files.skip_counts(files.split_empty(there.select("path").union(never), there))


@query("content_boxes")
def content_boxes_query(spark, sf):
    """Visible content of every readable picture."""
    root = _picture_folder(spark, sf)
    img = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(root)
    return content_boxes(img).select(X.file_name(F.col("origin")).alias("name"), "width", "height", "x0", "y0", "x1", "y1")


@query("sidecars", "SELECT CASE WHEN s_suppkey % 3 = 0 THEN concat('stem', s_suppkey) ELSE concat('id', s_suppkey) END AS id, s_name AS caption FROM supplier")
def sidecars(spark, sf):
    """One JSON document per supplier; a third of them lack the id field."""
    root = scratch_dir(spark, "sidecars")

    def save(rows):
        os.makedirs(root, exist_ok=True)
        for r in rows:
            k = r["s_suppkey"]
            ident = "" if k % 3 == 0 else f'\n  "id": "id{k}",'
            with open(os.path.join(root, f"stem{k}.json"), "w") as f:
                f.write(f'{{{ident}\n  "caption": "{r["s_name"]}"\n}}')

    V.table(spark, sf, "supplier").select("s_suppkey", "s_name").foreachPartition(save)
    return files.sidecars(spark, root, "id string, caption string").select("id", "caption")


@query("caption_files", "SELECT cast(s_suppkey as varchar) AS stem, s_name AS caption FROM supplier")
def caption_files(spark, sf):
    root = scratch_dir(spark, "captions")

    def save(rows):
        for r in rows:
            os.makedirs(os.path.join(root, str(r["s_suppkey"] % 3)), exist_ok=True)
            with open(os.path.join(root, str(r["s_suppkey"] % 3), f"{r['s_suppkey']}.txt"), "w") as f:
                f.write(f"\n {r['s_name']} \n")

    V.table(spark, sf, "supplier").select("s_suppkey", "s_name").foreachPartition(save)
    return files.caption_files(spark, root).select("stem", "caption")


@query("archive_members", "SELECT concat('a', s_nationkey) AS tar_stem, concat('a', s_nationkey, '_', s_suppkey) AS unq_id, length(s_name)::BIGINT AS length, md5(s_name) AS content_md5 FROM supplier WHERE s_suppkey % 4 <> 0")
def archive_members(spark, sf):
    """One archive per nation, packed by the executors; hidden files and other suffixes stay out."""
    root = scratch_dir(spark, "tars")

    def pack(key, pdf):
        import io
        import tarfile

        import pandas as pd

        os.makedirs(root, exist_ok=True)
        with tarfile.open(os.path.join(root, f"a{key[0]}.tar"), "w") as tf:
            for k, name in zip(pdf["s_suppkey"], pdf["s_name"]):
                body = name.encode()
                ends = [".jpg", ".JPEG", ".png", ".webp"][k % 4] if k % 4 else (".txt" if k % 8 else ".jpg")
                info = tarfile.TarInfo(f"./images/{'.' if k % 8 == 0 else ''}{k}{ends}")
                info.size = len(body)
                tf.addfile(info, io.BytesIO(body))
        return pd.DataFrame({"n": [len(pdf)]})

    s = V.table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    s.groupBy("s_nationkey").applyInPandas(pack, "n bigint").write.format("noop").mode("overwrite").save()
    m = archives.archive_members(spark, root, split_bytes=4096)
    return m.select("tar_stem", "unq_id", "length", F.md5("content").alias("content_md5"))


@query("caption_texts", """SELECT cast(page_id as varchar) AS unq_id, CASE WHEN page_id % 4 = 1 THEN '' ELSE url END AS caption FROM pages""")
def caption_texts(spark, sf):
    p = V.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("unq_id"), F.when(F.col("page_id") % 4 != 1, F.col("url")).alias("caption"))
    out = scratch_dir(spark, "texts")
    sinks.write_json_lines(sinks.caption_texts(p, True), out)
    return spark.read.schema("unq_id string, caption string").json(out)


# ------------------------------------------------------------------- streaming

_REC = "id string, quality string, error string"


def _event_files(spark, sf):
    out = scratch_dir(spark, "events")
    event_records(spark, sf).repartition(4).write.option("ignoreNullFields", False).json(out)
    return out


_EV = "ev AS (SELECT cast(event_id as varchar) AS id, CASE event_type WHEN 'purchase' THEN 'GOOD' WHEN 'signup' THEN 'BAD' END AS quality, CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM events)"


@query("appended_records", f"WITH {_EV} SELECT * FROM ev")
def appended_records(spark, sf):
    src, out = _event_files(spark, sf), scratch_dir(spark, "appended")
    inc.append_finished(inc.record_stream(spark, src, _REC, per_trigger=2), out, out + "-cp", "parquet").awaitTermination()
    return spark.read.schema(_REC).parquet(out)


@query("live_counters", f"WITH {_EV} SELECT CASE WHEN error IS NOT NULL THEN 'ERROR' ELSE quality END AS status, count(*) AS n FROM ev WHERE error IS NOT NULL OR quality IS NOT NULL GROUP BY 1")
def live_counters(spark, sf):
    src, out = _event_files(spark, sf), scratch_dir(spark, "counters")
    inc.live_counters(inc.record_stream(spark, src, _REC, per_trigger=2), out, out + "-cp").awaitTermination()
    return spark.read.parquet(out)


@query("appended_unfinished", f"WITH {_EV} SELECT * FROM ev")
def appended_unfinished(spark, sf):
    """The stream is replayed from scratch with a new checkpoint; the sink's keys keep it from doubling."""
    src, out = _event_files(spark, sf), scratch_dir(spark, "unfinished")
    for run in ("-cp1", "-cp2"):
        inc.append_unfinished(inc.record_stream(spark, src, _REC, per_trigger=2), out, out + run).awaitTermination()
    return spark.read.schema(_REC).parquet(out).drop(inc.KEY_PART)


# ----------------------------------------------------------------- model calls

@query("model_replies", f"WITH {REFS} SELECT id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE concat('len ', length(text)) END AS reply, CASE WHEN doc_id % 13 = 0 THEN 'cannot read' END AS error FROM refs")
def model_replies(spark, sf):
    """A stand-in model that fails on some rows; failures stay as rows with their error."""
    def call(client, batch):
        if (batch["doc_id"] % 13 == 0).any():
            raise ValueError("cannot read")
        return [f"len {len(t)}" for t in batch["text"]]

    r = V.refs(spark, sf, ["id", "doc_id", "text"])
    return apply_model(r, lambda endpoint: endpoint, call, endpoints=["a", "b"], wait=0.0).select("id", "reply", "error")


@query("model_replicas", f"WITH {REFS} SELECT category, count(*) AS n FROM refs GROUP BY 1")
def model_replicas(spark, sf):
    """One loaded model per worker: the client is made once per task of a fixed number."""
    def make(endpoint):
        return {"calls": 0}

    def call(client, batch):
        client["calls"] += 1
        return list(batch["category"])

    r = V.refs(spark, sf, ["id", "category"])
    out = apply_model(r, make, call, output="echo", replicas=3)
    return out.where("echo = category AND error IS NULL").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
