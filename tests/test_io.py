"""Sources, sinks, streaming restarts and model calls."""

import os

import pytest
from pyspark.sql import functions as F

from tilewright.operators.apply import apply_model
from tilewright.session import scratch_dir
from tilewright.sources import archives, files, sinks
from tilewright.streaming import incremental as inc


def test_strict_lines_reject_bad_and_empty(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n{"id": \n')
    (tmp_path / "empty.jsonl").write_text("")
    with pytest.raises(Exception):
        files.json_lines_strict(spark, str(tmp_path / "bad.jsonl"), "id string").collect()
    with pytest.raises(ValueError, match="empty"):
        files.json_lines_strict(spark, str(tmp_path / "empty.jsonl"), "id string")


def test_missing_columns_and_roots(spark, tmp_path):
    (tmp_path / "d.csv").write_text("image_path, x1\na,1\n")
    with pytest.raises(ValueError, match="missing columns"):
        files.detections_csv(spark, str(tmp_path / "d.csv"))
    with pytest.raises(Exception):
        files.dataset_roots(spark, f"{tmp_path}/nowhere").collect()
    assert files.split_roots(" a, b;\n\nc ;") == ["a", "b", "c"]


def test_each_root_is_read_under_its_own_header(spark, tmp_path):
    for root, head, row in (("a", "x1,y1,x2,y2,image_path,class_name,confidence", "1,2,3,4,p,cup,0.5"),
                            ("b c", "confidence,class_name,image_path,note,y2,x2,y1,x1", "0.5,cup,p,n,4,3,2,1")):
        folder = tmp_path / root / "bbox_results"
        folder.mkdir(parents=True)
        (folder / "yolo26_detections.csv").write_text(f"{head}\n{row}\n")
    df = files.dataset_roots(spark, f"{tmp_path}/a/; file://{tmp_path}/b c")
    got = {r.root: (r.x1, r.y1, r.x2, r.y2, r.image_path, r.confidence, r.note) for r in df.collect()}
    assert got == {f"{tmp_path}/a": ("1", "2", "3", "4", "p", "0.5", ""), f"{tmp_path}/b c": ("1", "2", "3", "4", "p", "0.5", "n")}
    assert {r.root for r in files.dataset_roots(spark, f"{tmp_path}/*").collect()} == set(got)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "_metadata" not in plan  # no address comes with the rows


def test_depth_folder_is_left_out_under_every_root(spark, tmp_path):
    for name in ("a.png", "depth/b.png", "sub/depth/c.png", "sub/d_depth.png"):
        (tmp_path / "root" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / name).write_bytes(b"x")
    plain = str(tmp_path / "root")
    names = lambda root: sorted(r.rel for r in files.depth_inputs(spark, root).collect())
    for root in (plain, plain + "/", "file:" + plain, "file://" + plain + "/", os.path.relpath(plain)):
        assert names(root) == ["a.png", "sub/depth/c.png"]
    mount = {"fs.defaultFS": "viewfs://shelf/", "fs.viewfs.mounttable.shelf.link./data": "file:" + plain}
    try:
        for k, v in mount.items():
            spark.conf.set(k, v)
        assert names("/data") == names("viewfs://shelf/data") == ["a.png", "sub/depth/c.png"]
    finally:
        for k in mount:
            spark.conf.unset(k)


def test_nulls_are_kept_in_manifests(spark, tmp_path):
    out = str(tmp_path / "m")
    sinks.write_json_lines(spark.sql("select 'a' id, cast(null as string) caption"), out)
    text = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".json"))
    assert text.strip() == '{"id":"a","caption":null}'


def test_bytes_export(spark, tmp_path):
    rows = [("s1.parquet", 0, "a", bytearray(b"\xff\xd8\xff1")), ("s2.parquet", 0, "a", bytearray(b"\xff\xd8\xff2")), ("s2.parquet", 5, None, bytearray(b"GIF89a"))]
    df = spark.createDataFrame(rows, "shard string, row_no bigint, id string, content binary")
    sinks.write_bytes(sinks.export_names(df), str(tmp_path / "img"))
    assert sorted(os.listdir(tmp_path / "img")) == ["a.jpg", "a_s2.jpg", "s2_00000005.gif"]


def test_image_column_choice(spark):
    from pyspark.sql.types import _parse_datatype_string as parse

    assert files.image_column(parse("id string, image struct<bytes:binary,path:string>, raw binary")) == "image"
    assert files.image_column(parse("id string, raw binary")) == "raw"
    with pytest.raises(ValueError):
        files.image_column(parse("id string"))


def test_unreadable_shards_are_skipped(spark, tmp_path):
    spark.createDataFrame([("1", bytearray(b"x"))], "id string, image binary").coalesce(1).write.parquet(str(tmp_path / "ok"))
    (tmp_path / "ok" / "zz-broken.parquet").write_bytes(b"not parquet")
    assert files.image_shards(spark, str(tmp_path / "ok"), id_column="id").count() == 1


def test_large_archive_is_split(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "big.tar", "w") as tf:
        for i in range(40):
            info = tarfile.TarInfo(f"{i}.png")
            info.size = 700
            tf.addfile(info, io.BytesIO(bytes([i]) * 700))
    m = archives.archive_members(spark, str(tmp_path), split_bytes=8192)
    assert m.rdd.getNumPartitions() > 3
    assert sorted(r.member_no for r in m.where("length(content) = 700").collect()) == list(range(40))


def records(spark, path, ids):
    spark.createDataFrame([(i, "GOOD", None) for i in ids], "id string, quality string, error string").write.mode("append").json(path)


def test_restart_adds_only_new_records(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    schema = "id string, quality string, error string"
    records(spark, src, ["a", "b", "b"])
    inc.append_unfinished(inc.record_stream(spark, src, schema), out, cp).awaitTermination()
    records(spark, src, ["b", "c"])
    for checkpoint in (cp, cp + "2"):
        inc.append_unfinished(inc.record_stream(spark, src, schema, per_trigger=1), out, checkpoint).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_counters_grow_over_batches(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for want, ids in ((2, ["a", "b"]), (5, ["c", "d", "e"])):
        records(spark, src, ids)
        inc.live_counters(inc.record_stream(spark, src, "id string, quality string, error string", per_trigger=1), out, cp).awaitTermination()
        assert [tuple(r) for r in spark.read.parquet(out).collect()] == [("GOOD", want)]


def test_model_that_recovers(spark, tmp_path):
    mark = str(tmp_path / "tries")

    def call(client, batch):
        with open(mark, "a") as f:
            f.write("x")
        if os.path.getsize(mark) < 3:
            raise RuntimeError("busy")
        return ["fine"] * len(batch)

    row = apply_model(spark.range(1).coalesce(1), lambda e: None, call, wait=0.0).first()
    assert (row.reply, row.error) == ("fine", None)


def test_model_that_always_fails_keeps_rows(spark):
    def call(client, batch):
        raise RuntimeError("down")

    got = apply_model(spark.range(5), lambda e: None, call, wait=0.0).collect()
    assert len(got) == 5 and {(r.reply, r.error) for r in got} == {(None, "down")}


def test_bad_rows_are_found_by_halving(spark, tmp_path):
    mark = str(tmp_path / "calls")

    def call(client, batch):
        with open(mark, "a") as f:
            f.write("x")
        if (batch["id"] == 37).any():
            raise RuntimeError("bad")
        return ["fine"] * len(batch)

    df = spark.range(0, 256, 1, 1)
    got = apply_model(df, lambda e: None, call, wait=0.0).collect()
    assert {r.id for r in got if r.error} == {37} and len(got) == 256
    assert os.path.getsize(mark) <= 1 + 2 * 8 + 3
    pooled = apply_model(df, lambda e: None, call, wait=0.0, rows_per_call=16, concurrency=4).collect()
    assert [r.id for r in pooled] == list(range(256)) and [r.id for r in pooled if r.error] == [37]


def test_shard_report_names_unreadable_files(spark, tmp_path):
    spark.range(7).select(F.col("id").cast("string").cast("binary").alias("image")).coalesce(1).write.parquet(str(tmp_path / "good"))
    (tmp_path / "bad.parquet").write_bytes(b"not a table")
    got = {os.path.basename(r.shard).split(".")[0].split("-")[0]: (r.n_rows, r.status) for r in files.shard_report(spark, str(tmp_path)).collect()}
    assert got == {"part": (7, "read"), "bad": (0, "no_rows")}
    assert files.image_shards(spark, str(tmp_path)).count() == 7


def test_export_names_are_unique(spark):
    rows = [("s1.parquet", i, "x", b"\xff\xd8\xff") for i in range(3)] + [("s2.parquet", 0, "x", b"\xff\xd8\xff")]
    df = spark.createDataFrame(rows, "shard string, row_index long, id string, content binary")
    assert sorted(r.name for r in sinks.export_names(df, "row_index").collect()) == ["x", "x_s1", "x_s1_00000002", "x_s2"]
    clash = df.unionByName(spark.createDataFrame([("s3.parquet", 0, "x_s1", b"\xff\xd8\xff")], df.schema))
    with pytest.raises(Exception, match="held twice"):
        sinks.export_names(clash, "row_index").collect()


def test_client_that_cannot_start(spark):
    def make(endpoint):
        raise RuntimeError("no weights")

    assert {r.error for r in apply_model(spark.range(3), make, lambda c, b: [1], wait=0.0).collect()} == {"no weights"}


def test_scratch_uses_the_shared_folder():
    from types import SimpleNamespace

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: "file:///shared/cp/"))
    assert scratch_dir(session, "x").startswith("/shared/cp/tilewright-x-")


def test_content_boxes(spark, tmp_path):
    import hashlib

    from catalog.io_queries import png
    from tilewright.operators.apply import content_boxes

    (tmp_path / "7.png").write_bytes(png("7"))
    h = hashlib.md5(b"7").digest()
    x, y, s = h[0] % 10, h[1] % 10, 4 + h[2] % 8
    r = content_boxes(spark.read.format("image").load(str(tmp_path))).first()
    assert (r.x0, r.y0, r.x1, r.y1) == (x, y, x + s, y + s)
    blank = content_boxes(spark.read.format("image").load(str(tmp_path)), white=0).first()
    assert (blank.x0, blank.y0, blank.x1, blank.y1) == (0, 0, 24, 24)


def test_keyed_sink_splits_a_large_key(spark, tmp_path):
    df = spark.range(1000).select(F.lit("big").alias("category"), "id")
    sinks.write_keyed(df, str(tmp_path / "k"), "category")
    assert spark.read.parquet(str(tmp_path / "k")).count() == 1000


def test_shards_grow_in_number_with_the_documents(spark):
    """Every input split more gives a shard more; the shards hold all documents."""
    from catalog.io_queries import _shards

    sf, before = "/root/testdata/sf0.01", spark.conf.get("spark.sql.files.maxPartitionBytes")
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        out = _shards(spark, sf)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    shards = spark.read.parquet(out)
    assert len(shards.inputFiles()) > 4 and shards.select("id").distinct().count() == n


def test_headers_are_walked_at_most_twice(spark, tmp_path, monkeypatch):
    """Blocks begin at their own header, whatever precedes it: long names, global headers, files that are no images."""
    import io
    import tarfile

    with tarfile.open(tmp_path / "a.tar", "w", format=tarfile.PAX_FORMAT, pax_headers={"comment": "global"}) as tf:
        for i in range(300):
            info = tarfile.TarInfo(("deep/" * 40 if i % 7 == 0 else "") + f"{i}.{'txt' if i % 5 == 0 else 'png'}")
            info.size = i
            tf.addfile(info, io.BytesIO(bytes([i % 256]) * i))
    blocks = list(archives.BlockReader({"path": str(tmp_path), "blockBytes": "2048"}).read(archives.WholeArchive(str(tmp_path / "a.tar"))))
    assert len(blocks) > 50
    walked, step = [], tarfile.TarFile.next
    monkeypatch.setattr(tarfile.TarFile, "next", lambda self: walked.append(1) or step(self))
    got = [row for b in blocks for row in archives._block_members(*b, True)]
    images = [i for i in range(300) if i % 5]
    assert [(r[1], r[3], r[4], r[5]) for r in got] == [(n, str(i), i, bytes([i % 256]) * i) for n, i in enumerate(images)]
    assert len(walked) <= 2 * 300 + 2 * len(blocks)
    m = archives.archive_members(spark, str(tmp_path), split_bytes=2048).collect()
    assert sorted((r.member_no, r.image_stem, r.length, bytes(r.content)) for r in m) == [(n, str(i), i, bytes([i % 256]) * i) for n, i in enumerate(images)]
