"""Text, path, seed and reference-quality queries over the references view."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import query
from tilewright import constants as K
from tilewright.functions import text as X
from tilewright.functions.draws import draw_u32
from tilewright.functions.truthy import truthy_coalesce
from tilewright.operators import manifest as M
from tilewright.operators import quality as Q
from tilewright.operators import sampling as S
from tilewright.sources import sinks

REFS = V.refs_sql()
WS = r"'^\s+|\s+$', '', 'g'"


def strip(e: str) -> str:
    return f"regexp_replace({e}, {WS})"


def nn(e: str) -> str:
    return f"nullif({e}, '')"


_QUAL = f"upper({nn('regexp_extract(raw_response, ' + chr(39) + '(?i)QUALITY:' + chr(92) + 's*(GOOD|BAD)' + chr(39) + ', 1)')})"
_CAPT = f"replace({strip(nn('regexp_extract(raw_response, ' + chr(39) + '(?s)CAPTION:' + chr(92) + 's*(.+)' + chr(39) + ', 1)'))}, chr(10), ' ')"


@query("parsed_replies", f"""WITH {REFS} SELECT id, {_QUAL} AS quality, lang AS reason, {_CAPT} AS caption
  FROM (SELECT r.*, split_part(split_part(raw_response, 'REASON: ', 2), chr(10), 1) AS lang FROM refs r)""")
def parsed_replies(spark, sf):
    return Q.parsed_replies(V.refs(spark, sf, ["id", "raw_response"])).select("id", "quality", "reason", "caption")


@query("path_categories", f"""WITH {REFS} SELECT id, CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE category END AS category,
  doc_id % 3 = 0 AS is_background FROM refs""")
def path_categories(spark, sf):
    r = V.refs(spark, sf, ["id", "doc_id", "saved_image_path"])
    path = F.when(F.col("doc_id") % 4 == 0, "data/elsewhere/a.jpg").otherwise(F.concat(F.lit("/mnt/"), "saved_image_path"))
    bg = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("C:\\Data\\Background\\"), "id")).otherwise(F.concat(F.lit("C:\\Data\\Foreground\\"), "id"))
    return r.select("id", X.category_from_path(path).alias("category"), X.is_background_path(bg).alias("is_background"))


@query("mirrored_paths", f"""WITH {REFS} SELECT concat(category, '/', source, '/', doc_id) AS id, source AS rel_dir,
  concat('out/', category, '/images/', source, '/', doc_id, '.v1.jpg') AS saved_image_path,
  concat('out/', category, '/metadata/', source, '/', doc_id, '.v1.json') AS saved_metadata_path FROM refs""")
def mirrored_paths(spark, sf):
    r = V.refs(spark, sf, ["doc_id", "category", "source"])
    path = F.concat(F.lit("/data/pool/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".v1.jpg"))
    m = r.select(*X.mirrored_paths(F.col("category"), path, "/data/pool/", "out"))
    return m.withColumn("id", F.regexp_replace("id", r"\.v1$", ""))


@query("resolved_paths", f"""WITH {REFS} SELECT id, CASE WHEN doc_id % 2 = 0 THEN concat('/abs/', id) ELSE concat('/root_dir/', id) END AS absolute,
  CASE WHEN doc_id % 2 = 0 THEN concat('/abs/', id) ELSE id END AS relative FROM refs""")
def resolved_paths(spark, sf):
    r = V.refs(spark, sf, ["id", "doc_id"])
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/abs/"), "id")).otherwise(F.col("id"))
    absolute = X.resolve_path(raw, "/root_dir/")
    return r.select("id", absolute.alias("absolute"), X.relative_to(absolute, "/root_dir").alias("relative"))


_TYPES = [("FFD8FFE0", ".jpg"), ("89504E470D0A1A0A", ".png"), ("524946460000000057454250", ".webp"), ("474946383961", ".gif"), ("00010203", ".bin")]


@query("magic_extensions", f"WITH {REFS} SELECT id, {V.quoted([e for _, e in _TYPES])}[doc_id % 5 + 1] AS ext FROM refs")
def magic_extensions(spark, sf):
    heads = F.array(*[F.lit(h) for h, _ in _TYPES])
    content = F.unhex(F.concat(F.element_at(heads, (F.col("doc_id") % 5 + 1).cast("int")), F.hex("text")))
    return V.refs(spark, sf, ["id", "doc_id", "text"]).select("id", X.extension_from_magic(content).alias("ext"))


@query("data_urls", f"""WITH {REFS} SELECT id, concat('data:image/', CASE doc_id % 3 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' ELSE 'webp' END,
  ';base64,', base64(encode(text))) AS url FROM refs""")
def data_urls(spark, sf):
    k = F.col("doc_id") % 3
    path = F.concat("id", F.when(k == 0, ".JPG").when(k == 1, ".png").otherwise(".webp"))
    return V.refs(spark, sf, ["id", "doc_id", "text"]).select("id", X.data_url(path, F.col("text").cast("binary")).alias("url"))


_OPEN = "|".join(sorted(K.META_OPENERS, key=len, reverse=True))
_TRAIL = r"[ \t\n\r:–—\-•]*"
_DIRTY = "concat(CASE doc_id % 4 WHEN 0 THEN 'The image shows: this photograph shows ' WHEN 1 THEN '  THE SCENE DEPICTS — ' ELSE '' END, text)"


def _words(e):
    return f"list_filter(regexp_split_to_array({e}, '\\s+'), lambda w: w <> '')"


_CLEAN = strip(f"regexp_replace({strip(_DIRTY)}, '^(?i:(?:{_OPEN}){_TRAIL})+', '')")
_CUT = f"array_to_string(list_slice({_words('clean')}, 1, 100), ' ')"


@query("cleaned_captions", f"""WITH {REFS}, c AS (SELECT id, {_CLEAN} AS clean FROM refs), n AS (SELECT *, len({_words('clean')}) AS n_words FROM c)
  SELECT id, clean, n_words, CASE WHEN n_words > 115 THEN {_CUT} || CASE WHEN right({_CUT}, 1) IN ('.', '!', '?', '…') THEN '' ELSE '.' END ELSE clean END AS caption FROM n""")
def cleaned_captions(spark, sf):
    k = F.col("doc_id") % 4
    dirty = F.concat(F.when(k == 0, "The image shows: this photograph shows ").when(k == 1, "  THE SCENE DEPICTS — ").otherwise(""), "text")
    r = V.refs(spark, sf, ["id", "doc_id", "text"]).select("id", dirty.alias("t"))
    return r.select("id", X.drop_meta_openers(F.col("t")).alias("clean"),
                    X.word_count(X.drop_meta_openers(F.col("t"))).cast("long").alias("n_words"), X.finish_caption(F.col("t"), 100).alias("caption"))


@query("stripped_quotes", f"""WITH {REFS} SELECT id, concat('"', source, '''') AS one, source AS every FROM refs""")
def stripped_quotes(spark, sf):
    r = V.refs(spark, sf, ["id", "source"])
    t = F.concat(F.lit("\"\""), "source", F.lit("''"))
    return r.select("id", X.strip_one_quote(t).alias("one"), X.strip_quotes(t).alias("every"))


_PART = "concat(CASE p_partkey % 3 WHEN 0 THEN 'A ' WHEN 1 THEN ' an  ' ELSE '' END, upper(replace(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '  ' END)))"


@query("normalized_labels", "SELECT p_partkey, lower(p_name) AS label FROM part")
def normalized_labels(spark, sf):
    p = V.table(spark, sf, "part").selectExpr("p_partkey", f"{_PART} AS raw")
    return p.select("p_partkey", X.normalize_label(F.col("raw")).alias("label"))


@query("detection_texts", f"""WITH {V.det_sql()}, o AS (SELECT DISTINCT image_path, split_part(label, ' ', 2) AS o FROM det)
  SELECT image_path, string_agg(CASE WHEN lower(o[1]) IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END || o || '.', ' ' ORDER BY o) AS text FROM o GROUP BY 1""")
def detection_texts(spark, sf):
    d = V.detections(spark, sf, ["image_path", "label"]).select("image_path", F.split("label", " ")[1].alias("o"))
    g = d.groupBy("image_path").agg(F.sort_array(F.collect_set("o")).alias("objects"))  # distinct class names only
    return g.select("image_path", X.detection_text(F.col("objects")).alias("text"))


@query("sample_seeds", f"""WITH {REFS} SELECT id, (42 + doc_id + cast(regexp_extract(source, '[0-9]+') as bigint) * pow(10, length(cast(doc_id as varchar)))::BIGINT) % 2147483647 AS digits,
  (7 + list_sum(list_transform(string_split(id, ''), lambda c: ord(c)))::BIGINT) % 2147483647 AS codes,
  xor(('0x' || substr(md5(id), 1, 8))::BIGINT, 123::BIGINT) AS md5_seed FROM refs""")
def sample_seeds(spark, sf):
    r = V.refs(spark, sf, ["id"])
    c = F.col("id")
    return r.select("id", X.seed_from_digits(c, 42).alias("digits"), X.seed_from_codes(c, 7).alias("codes"),
                    X.seed_from_md5(c, 123).alias("md5_seed"))


@query("themes_from_ids", f"WITH {V.order_sql('theme_images')} SELECT id, split_part(id, '_', 1) AS theme FROM theme_images")
def themes_from_ids(spark, sf):
    return V.order_view(spark, sf, "theme_images").select("id", X.theme_from_id(F.col("id")).alias("theme"))


@query("fallback_values", f"""WITH {V.order_sql('theme_images')}, {V.order_sql('theme_prompts')} SELECT i.id,
  coalesce(nullif(i.prompt, ''), p.combined_prompt, p.prompt) AS caption, coalesce(nullif(i.num_objects, 0), p.num_objects) AS num_objects,
  coalesce(nullif(i.structured_prompt, ''), p.structured_prompt) AS structured_prompt FROM theme_images i JOIN theme_prompts p ON i.id = p.id""")
def fallback_values(spark, sf):
    i = V.order_view(spark, sf, "theme_images").alias("i")
    p = V.order_view(spark, sf, "theme_prompts").alias("p")
    c = F.col
    return i.join(p, "id").select(
        "id", truthy_coalesce("string", c("i.prompt"), c("p.combined_prompt"), c("p.prompt")).alias("caption"),
        truthy_coalesce("int", c("i.num_objects"), c("p.num_objects")).alias("num_objects"),
        truthy_coalesce("string", c("i.structured_prompt"), c("p.structured_prompt")).alias("structured_prompt"))


_TWO = "concat(cast(1 as varchar), '. [landmark] (LANDSCAPE/ENVIRONMENT) ', text, chr(10), '2. [', category, '] ', source)"


@query("reference_blocks", f"WITH {REFS} SELECT id, {_TWO} AS block FROM refs")
def reference_blocks(spark, sf):
    r = V.refs(spark, sf, ["id", "category", "source", "text"])
    item = lambda c, t: F.struct(c.alias("category"), t.alias("caption"))
    return r.select("id", X.numbered_references(F.array(item(F.lit("landmark"), F.col("text")), item(F.col("category"), F.col("source")))).alias("block"))


def _lit(s):
    return "'" + s.replace("'", "''") + "'"


@query("multi_reference_prompts", f"""WITH {REFS} SELECT id, CASE WHEN doc_id % 3 = 0 THEN
  concat_ws(chr(10), {strip('caption')}, '', concat({_lit(K.ONE_REF_HEADER)}, source), {_lit(K.ONE_REF_CLOSING)})
  ELSE concat_ws(chr(10), {strip('caption')}, '', {_lit(K.MANY_REFS_HEADER)}, concat('- Image 1: ', source), concat('- Image 2: ', category), {_lit(K.MANY_REFS_CLOSING)}) END AS prompt FROM refs""")
def multi_reference_prompts(spark, sf):
    r = V.refs(spark, sf, ["id", "doc_id", "caption", "source", "category"])
    caps = F.array(F.concat(F.lit(" "), "source", F.lit(" ")), "category", "id")
    n = F.when(F.col("doc_id") % 3 == 0, F.lit(1)).otherwise(F.lit(2))
    return r.select("id", X.multi_reference_prompt(F.col("caption"), caps, n).alias("prompt"))


# -------------------------------------------------------------------- quality

_GOOD = "coalesce(error, '') = '' AND quality = 'GOOD' AND coalesce(caption, '') <> ''"


@query("good_references", f"WITH {REFS} SELECT id, category FROM refs WHERE {_GOOD}")
def good_references(spark, sf):
    r = V.refs(spark, sf, ["id", "category", "quality", "error", "caption"])
    return Q.require_category(Q.good_references(r)).select("id", "category")


@query("outcome_counts", f"""WITH {REFS} SELECT count(*) FILTER (error IS NULL AND quality = 'GOOD') AS n_good,
  count(*) FILTER (error IS NULL AND quality = 'BAD') AS n_bad, count(*) FILTER (error IS NOT NULL) AS n_error FROM refs""")
def outcome_counts(spark, sf):
    return Q.outcome_counts(V.refs(spark, sf, ["quality", "error"]))


@query("event_outcomes", """SELECT count(*) FILTER (event_type = 'purchase') AS n_good, count(*) FILTER (event_type = 'signup') AS n_bad,
  count(*) FILTER (event_type = 'error') AS n_error FROM events""")
def event_outcomes(spark, sf):
    return Q.outcome_counts(event_records(spark, sf))


def event_records(spark, sf):
    kind = F.col("event_type")
    return V.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"), F.when(kind == "purchase", "GOOD").when(kind == "signup", "BAD").alias("quality"),
        F.when(kind == "error", "failed").alias("error"))


@query("category_counts", f"WITH {REFS} SELECT category, count(*) AS n FROM refs WHERE {_GOOD} GROUP BY 1")
def category_counts(spark, sf):
    return Q.category_counts(Q.good_references(V.refs(spark, sf, ["category", "quality", "error", "caption"])))


# Generated samples: two or three reference paths per document, by number.
_CATS = ["landmark", "cuisine", "object", "celeb", "person"]


def _cat_sql(e):
    return f"{V.quoted(_CATS)}[{e} % 5 + 1]"


_LIST = f"CASE WHEN doc_id % 2 = 0 THEN [{_cat_sql('doc_id')}, {_cat_sql('doc_id // 5')}] ELSE [{_cat_sql('doc_id')}, {_cat_sql('doc_id // 5')}, {_cat_sql('doc_id // 25')}] END"
_SAMP = f"s AS (SELECT doc_id, concat('sample_', lpad(cast(doc_id as varchar), cast(greatest(7, length(cast(doc_id as varchar))) as int), '0')) AS id, {_LIST} AS cats FROM documents), st AS (SELECT *, len(list_filter(cats, lambda c: c = 'landmark')) AS landmark_count FROM s)"


def sample_refs(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id")
    pool = F.array(*[F.lit(c) for c in _CATS])
    at = lambda k: F.element_at(pool, (F.floor(F.col("doc_id") / k) % 5 + 1).cast("int"))
    cats = F.when(F.col("doc_id") % 2 == 0, F.array(at(1), at(5))).otherwise(F.array(at(1), at(5), at(25)))
    return d.select("doc_id", F.format_string("sample_%07d", "doc_id").alias("id"),
                    F.transform(cats, lambda c: F.concat(F.lit("outputs/"), c, F.lit("/images/x.jpg"))).alias("reference_images"))


def status(spark, sf):
    return Q.landmark_status(sample_refs(spark, sf))


@query("landmark_status", f"WITH {_SAMP} SELECT id, array_to_string(cats, '|') AS categories, landmark_count, landmark_count >= 2 AS is_bad FROM st")
def landmark_status(spark, sf):
    return status(spark, sf).select("id", F.array_join("categories", "|").alias("categories"), F.col("landmark_count").cast("long").alias("landmark_count"), "is_bad")


@query("landmark_totals", f"""WITH {_SAMP}, t AS (SELECT count(*) AS total, count(*) FILTER (landmark_count < 2) AS good, count(*) FILTER (landmark_count >= 2) AS bad FROM st)
  SELECT *, 100.0::DOUBLE * good / total AS good_pct, 100.0::DOUBLE * bad / total AS bad_pct FROM t""")
def landmark_totals(spark, sf):
    return Q.landmark_totals(status(spark, sf))


@query("landmark_histogram", f"WITH {_SAMP} SELECT landmark_count, count(*) AS n FROM st GROUP BY 1")
def landmark_histogram(spark, sf):
    return Q.landmark_histogram(status(spark, sf)).select(F.col("landmark_count").cast("long").alias("landmark_count"), "n")


@query("category_combos", f"WITH {_SAMP} SELECT array_to_string(list_sort(cats), ' + ') AS combo, count(*) AS n FROM st GROUP BY 1")
def category_combos(spark, sf):
    return Q.combo_counts(status(spark, sf))


@query("bad_examples", f"WITH {_SAMP} SELECT id, array_to_string(cats, '|') AS categories FROM st WHERE landmark_count >= 2 ORDER BY id LIMIT 10")
def bad_examples(spark, sf):
    return Q.bad_examples(status(spark, sf)).select("id", F.array_join("categories", "|").alias("categories"))


@query("top_pairings", f"""WITH {_SAMP}, p AS (SELECT list_sort(list_distinct(cats)) AS d FROM st)
  SELECT array_to_string(d, '+') AS pairing, count(*) AS n FROM p WHERE len(d) > 1 GROUP BY 1 ORDER BY n DESC, pairing LIMIT 20""")
def top_pairings(spark, sf):
    return Q.top_pairings(status(spark, sf), "categories")


def conditions(spark, sf):
    d = status(spark, sf).withColumnRenamed("categories", "reference_categories")
    return d.select("id", "reference_categories", F.array().cast("array<string>").alias("reference_captions"),
                    *S.condition_columns(F.col("doc_id") * 37 % S.grid_size()))


def _axis(pool, div):
    return f"{V.quoted([k for k, _ in pool])}[(combo // {div}) % {len(pool)} + 1]"


_COND = f"""c AS (SELECT *, doc_id * 37 % 1960 AS combo FROM st), k AS (SELECT *, {_axis(K.SCALES, 392)} AS scale, {_axis(K.ROTATIONS, 56)} AS rotation,
  {_axis(K.LIGHTINGS, 7)} AS lighting, {_axis(K.INTERACTIONS, 1)} AS interaction FROM c)"""
_ONE = lambda name, e: f"SELECT '{name}' AS section, cast({e} as varchar) AS key FROM k"


_SECTIONS = {"num_references": "len(cats)", "scale": "scale", "rotation": "rotation", "lighting": "lighting", "interaction": "interaction",
             "person_refs": "len(list_filter(cats, lambda c: c = 'person'))", "category": "unnest(cats)"}
_COUNTED = f"""{_SAMP}, {_COND}, u AS ({' UNION ALL '.join(_ONE(k, e) for k, e in _SECTIONS.items())}),
  t AS (SELECT section, key, count(*) AS n, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM k) AS pct FROM u GROUP BY 1, 2)"""


@query("composition_distribution", f"WITH {_COUNTED} SELECT section, key, n, pct FROM t")
def composition_distribution(spark, sf):
    return Q.composition_distribution(conditions(spark, sf))


REPORT_SQL = f"""WITH {_COUNTED}
  SELECT printf('  %s: %d  (%.2f%%)', key, n, pct) AS value FROM t UNION ALL SELECT DISTINCT concat('--- ', section, ' ---') FROM t"""
SECTIONS = list(_SECTIONS)


@query("composition_report", REPORT_SQL)
def composition_report(spark, sf):
    return Q.report_lines(Q.composition_distribution(conditions(spark, sf)), SECTIONS)


CONDITION_SQL = f"{_SAMP}, {_COND}"


@query("composition_preview", f"""WITH {_SAMP}, {_COND} SELECT id, len(cats) AS num_references, array_to_string(cats, '|') AS ref_categories,
  concat_ws(' || ', substr(text, 1, 60), source) AS ref_captions_preview, scale, rotation, lighting, interaction
  FROM k JOIN (SELECT doc_id AS did, text, source FROM documents) d ON k.doc_id = d.did""")
def composition_preview(spark, sf):
    d = V.table(spark, sf, "documents").select(F.format_string("sample_%07d", "doc_id").alias("id"), F.array("text", "source").alias("reference_captions"))
    p = sinks.composition_preview(conditions(spark, sf).drop("reference_captions").join(d, "id"))
    return p.withColumn("num_references", F.col("num_references").cast("long"))


# ------------------------------------------------------------- orders and limits

@query("first_per_category", f"""WITH {REFS}, r AS (SELECT category, saved_image_path, row_number() OVER (PARTITION BY category ORDER BY saved_image_path) AS rk FROM refs)
  SELECT category, saved_image_path FROM r WHERE rk <= 7""")
def first_per_category(spark, sf):
    r = V.refs(spark, sf, ["category", "saved_image_path"])
    return M.first_per_category(r, 7, "saved_image_path").select("category", "saved_image_path")


@query("seeded_order", f"WITH {REFS} SELECT id, row_number() OVER (ORDER BY {V.digest(4, 'shuffle', 'id')}, id) AS place FROM refs")
def seeded_order(spark, sf):
    """The order itself, numbered by digest bands so that the check can see it."""
    from tilewright.functions.draws import draw_digest
    from tilewright.operators.ranking import digest_band, global_ordinal

    h = draw_digest(4, "shuffle", F.col("id"))
    return global_ordinal(V.refs(spark, sf, ["id"]), [h.asc(), F.asc("id")], [digest_band(h)], "place").withColumn("place", F.col("place") + 1)


@query("seeded_pick", f"WITH {REFS} SELECT id FROM refs ORDER BY {V.digest(104, 'perm', 'id')}, id LIMIT 25")
def seeded_pick(spark, sf):
    return S.seeded_pick(V.refs(spark, sf, ["id"]), 25, 4, 100)


@query("bounded_examples", f"""WITH {REFS}, b AS (SELECT id, CASE WHEN error IS NOT NULL THEN 'error' WHEN quality = 'BAD' THEN 'bad' WHEN caption = '' THEN 'empty' END AS side FROM refs),
  r AS (SELECT side, id, row_number() OVER (PARTITION BY side ORDER BY id) AS rk FROM b WHERE side IS NOT NULL) SELECT side, id FROM r WHERE rk <= 12""")
def bounded_examples(spark, sf):
    r = V.refs(spark, sf, ["id", "error", "quality", "caption"])
    side = F.when(F.col("error").isNotNull(), "error").when(F.col("quality") == "BAD", "bad").when(F.col("caption") == "", "empty")
    s = r.select("id", side.alias("side")).where(F.col("side").isNotNull())
    return Q.bounded_examples(s, "side", [F.asc("id")], 12).select("side", "id")


@query("caption_dropout", f"""WITH {REFS} SELECT id, CASE WHEN {V.unit(8, 'caption_drop', 'id')} < 0.1::DOUBLE THEN ' '
  WHEN {V.u32(8, 'caption', 'id')} % 2 = 0 THEN text ELSE source END AS caption FROM refs""")
def caption_dropout(spark, sf):
    r = V.refs(spark, sf, ["id", "text", "source"])
    return r.select("id", S.caption_dropout(F.array("text", "source"), 8, F.col("id")).alias("caption"))


@query("dropout_plan", f"""WITH {REFS} SELECT id, doc_id, {V.unit(8, 'keep_canvas', 'id', 'doc_id')} < 0.75::DOUBLE AS keep_canvas, true AS keep_depth,
  CASE WHEN doc_id < 100 THEN '' ELSE source END AS prompt_eff FROM refs""")
def dropout_plan(spark, sf):
    r = V.refs(spark, sf, ["id", "doc_id", "source"])
    return S.dropout_plan(r, 8, 0.75, 1.0, "id", "doc_id", 100, "source").select("id", "doc_id", "keep_canvas", "keep_depth", "prompt_eff")


_VP = f"(SELECT id, {V.u32(2, 'view_prompt', 'id')} % 95 AS u FROM refs)"
_IDV = (K.AZIMUTHS.index(K.IDENTITY_VIEW[0]) * 4 + K.ELEVATIONS.index(K.IDENTITY_VIEW[1])) * 3 + K.DISTANCES.index(K.IDENTITY_VIEW[2])


@query("view_prompts", f"""WITH {REFS}, v AS (SELECT id, u + CASE WHEN u >= {_IDV} THEN 1 ELSE 0 END AS v FROM {_VP})
  SELECT id, concat('<sks> ', {V.quoted(K.AZIMUTHS)}[v // 12 + 1], ' ', {V.quoted(K.ELEVATIONS)}[v // 3 % 4 + 1], ' ', {V.quoted(K.DISTANCES)}[v % 3 + 1]) AS prompt FROM v""")
def view_prompts(spark, sf):
    return V.refs(spark, sf, ["id"]).select("id", S.view_prompt(2, F.col("id")).alias("prompt"))
