"""String, path and caption expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright import constants as K


def strip(col: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def null_if_empty(col: Column) -> Column:
    return F.when(col != "", col)


def words(col: Column) -> Column:
    """Runs of non-space characters."""
    return F.filter(F.split(col, r"(?U)\s+"), lambda w: w != "")


# ------------------------------------------------------------- model replies

def reply_quality(reply: Column) -> Column:
    return F.upper(null_if_empty(F.regexp_extract(reply, r"(?i)QUALITY:\s*(GOOD|BAD)", 1)))


def reply_reason(reply: Column) -> Column:
    """First line after the reason marker."""
    return strip(null_if_empty(F.regexp_extract(reply, r"REASON:\s*([^\n]+)", 1)))


def reply_caption(reply: Column) -> Column:
    """Everything after the caption marker, on one line."""
    body = null_if_empty(F.regexp_extract(reply, r"(?s)CAPTION:\s*(.+)", 1))
    return F.translate(strip(body), "\n", " ")


def parse_reply(reply: Column) -> list[Column]:
    return [
        reply_quality(reply).alias("quality"),
        reply_reason(reply).alias("reason"),
        reply_caption(reply).alias("caption"),
    ]


def strip_one_quote(text: Column) -> Column:
    """At most one quote character at each end."""
    return strip(F.regexp_replace(text, "^[\"']|[\"']$", ""))


def strip_quotes(text: Column) -> Column:
    """All quote characters at both ends."""
    return F.regexp_replace(strip(text), "^[\"']+|[\"']+$", "")


# -------------------------------------------------------------------- captions

def drop_meta_openers(caption: Column) -> Column:
    """Remove stacked 'the image shows'-like openers and the punctuation after each."""
    longest_first = sorted(K.META_OPENERS, key=len, reverse=True)
    one = "(?:" + "|".join(longest_first) + ")[" + K.OPENER_TRAILERS + "]*"
    return strip(F.regexp_replace(strip(caption), "^(?i:" + one + ")+", ""))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def trim_to_words(text: Column, n: int) -> Column:
    """First ``n`` words, closed with a full stop unless they end a sentence."""
    w = words(text)
    cut = F.array_join(F.slice(w, 1, n), " ")
    closed = F.when(cut.rlike("[.!?…]$"), cut).otherwise(F.concat(cut, F.lit(".")))
    return F.when(F.size(w) <= n, strip(text)).otherwise(closed)


def finish_caption(text: Column, target_words: int, slack: int = K.CAPTION_WORD_SLACK) -> Column:
    """Openers dropped; trimmed only when well over the target length."""
    clean = drop_meta_openers(text)
    if target_words <= 0:
        return clean
    return F.when(word_count(clean) > target_words + slack, trim_to_words(clean, target_words)).otherwise(clean)


# ---------------------------------------------------------------------- labels

def normalize_label(label: Column) -> Column:
    bare = F.regexp_replace(strip(F.lower(label)), r"^(a|an)\s+", "")
    return strip(F.regexp_replace(bare, r"[\s\-]+", " "))


def indefinite_article(noun: Column) -> Column:
    return F.when(F.lower(F.substring(noun, 1, 1)).isin("a", "e", "i", "o", "u"), "an").otherwise("a")


def detection_text(objects: Column) -> Column:
    """Phrase list for an open-vocabulary detector: ``a cup. an oven.``"""
    phrases = F.transform(objects, lambda o: F.concat(indefinite_article(o), F.lit(" "), o, F.lit(".")))
    return F.array_join(phrases, " ")


# ----------------------------------------------------------------------- paths

def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_url(path: Column) -> Column:
    """One spelling of a file's address, whether it has one slash after the scheme or three."""
    return F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def file_stem(path: Column) -> Column:
    """Name without its last suffix; a leading dot is part of the stem."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_suffix(path: Column) -> Column:
    """Lower-case last suffix with its dot, or the empty string."""
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]*)$", 1))


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def category_from_path(path: Column, anchor: str = "outputs") -> Column:
    """Path part after the first ``anchor`` part, else ``unknown``."""
    parts = path_parts(path)
    at = F.array_position(parts, anchor)
    return F.when(
        (at > 0) & (at < F.size(parts)), F.try_element_at(parts, (at + 1).cast("int"))
    ).otherwise("unknown")


def is_background_path(path: Column) -> Column:
    slashed = F.lower(F.translate(path, "\\", "/"))
    return slashed.rlike("|".join(K.BACKGROUND_MARKERS))


def relative_to(path: Column, root: Column | str) -> Column:
    """Path below ``root``; a path outside the root is returned as it is."""
    root = root if isinstance(root, Column) else F.lit(root)
    prefix = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    inside = F.substring(path, F.length(prefix) + 1, F.length(path))
    return F.when(path.startswith(prefix), inside).otherwise(path)


def resolve_path(path: Column, root: Column | str) -> Column:
    """Relative paths joined to ``root``; absolute ones unchanged."""
    root = root if isinstance(root, Column) else F.lit(root)
    joined = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), path)
    return F.when(path.startswith("/") | (root == "") | root.isNull(), path).otherwise(joined)


def mirrored_paths(category: Column, source_path: Column, root: Column | str, output_root: str) -> list[Column]:
    """Record id and saved image / metadata paths that mirror the source layout."""
    rel = relative_to(source_path, root)
    rel_dir, name, stem = parent_dir(rel), file_name(source_path), file_stem(source_path)

    def below(*parts: Column) -> Column:
        return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "/")

    out = F.lit(output_root)
    return [
        below(category, rel_dir, stem).alias("id"),
        rel_dir.alias("rel_dir"),
        below(out, category, F.lit("images"), rel_dir, name).alias("saved_image_path"),
        below(out, category, F.lit("metadata"), rel_dir, F.concat(stem, F.lit(".json"))).alias("saved_metadata_path"),
    ]


def theme_from_id(sample_id: Column) -> Column:
    return F.regexp_replace(sample_id, "_[^_]*$", "")


def is_image_member(member: Column) -> Column:
    """Archive member names that are visible image files."""
    name = file_name(F.regexp_replace(member, r"^[./]+", ""))
    return (name != "") & ~name.startswith(".") & file_suffix(name).isin(*K.MEMBER_SUFFIXES)


# --------------------------------------------------------------------- prompts

def numbered_references(refs: Column) -> Column:
    """``1. [category] (LANDSCAPE/ENVIRONMENT) caption`` lines; refs = array<struct(category, caption)>."""
    tag = lambda i: F.when(i == 0, F.lit(K.LANDSCAPE_TAG)).otherwise("")
    lead = lambda r, i: fill_template(K.REFERENCE_LEAD, number=i + 1, category=r["category"], tag=tag(i))
    return F.array_join(F.transform(refs, lambda r, i: F.concat(lead(r, i), r["caption"])), "\n")


def fill_template(template: str, **values: Column) -> Column:
    """Replace ``{name}`` slots of a literal template by columns."""
    pieces, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            pieces.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        pieces.append(values[name].cast("string"))
    return F.concat(*pieces)


def multi_reference_prompt(caption: Column, ref_captions: Column, n_images: Column) -> Column:
    """Scene caption followed by the first ``n_images`` numbered reference captions."""
    shown = F.slice(F.coalesce(ref_captions, F.array().cast("array<string>")), 1, F.greatest(n_images, F.lit(0)))
    shown = F.transform(shown, lambda c: strip(F.coalesce(c, F.lit(""))))
    listed = F.transform(
        shown, lambda c, i: F.concat(F.lit("- Image "), (i + 1).cast("string"), F.lit(": "), c)
    )
    head = F.array(strip(F.coalesce(caption, F.lit(""))), F.lit(""))
    many = F.concat(head, F.array(F.lit(K.MANY_REFS_HEADER)), listed, F.array(F.lit(K.MANY_REFS_CLOSING)))
    first = F.coalesce(F.try_element_at(shown, F.lit(1)), F.lit(""))
    one = F.concat(head, F.array(F.concat(F.lit(K.ONE_REF_HEADER), first), F.lit(K.ONE_REF_CLOSING)))
    return F.array_join(F.when(n_images > 1, many).otherwise(one), "\n")


def structured_description(details: Column) -> Column:
    """One line per object from array<struct(object, surface_text, location_text, …)>."""

    def line(a):
        article = F.initcap(indefinite_article(a["color"]))
        return F.concat(
            F.lit("- "), article, F.lit(" "), a["color"], F.lit(" "), a["material"], F.lit(" "), a["object"],
            F.lit(", "), a["surface_text"], F.lit(", positioned "), a["location_text"],
            F.lit(", "), a["orientation_text"], F.lit("."),
        )

    return F.array_join(F.transform(details, line), "\n")


# ----------------------------------------------------------- seeds and content

SEED_MODULUS = 2**31 - 1


def seed_from_digits(sample_id: Column, base: int) -> Column:
    """(base + number formed by all digits of the id) mod (2^31 - 1).

    Any number of digits: blocks of nine are folded from the left under the modulus.
    """
    blocks = F.regexp_extract_all(F.regexp_replace(sample_id, "[^0-9]", ""), F.lit("([0-9]{1,9})"), 1)
    power = lambda b: F.rpad(F.lit("1"), F.length(b) + 1, "0").cast("long")
    number = F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: F.pmod(n * power(b) + b.cast("long"), F.lit(SEED_MODULUS)))
    return F.pmod(F.coalesce(number, F.lit(0)) + F.lit(base), F.lit(SEED_MODULUS)).cast("long")


def seed_from_codes(key: Column, base: int) -> Column:
    """(base + sum of character codes) mod (2^31 - 1)."""
    codes = F.transform(F.split(key, ""), lambda c: F.ascii(c).cast("long"))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda a, b: a + b)
    return F.pmod(total + F.lit(base), F.lit(SEED_MODULUS))


def seed_from_md5(key: Column, base: int) -> Column:
    """First 8 hex digits of the MD5, XOR the base seed."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long").bitwiseXOR(F.lit(base).cast("long"))


def extension_from_magic(content: Column) -> Column:
    """File extension from leading bytes; ``.bin`` when unknown."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), ".jpg")
        .when(head.startswith("89504E470D0A1A0A"), ".png")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), ".webp")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), ".gif")
        .otherwise(".bin")
    )


def data_url(path: Column, content: Column) -> Column:
    """``data:image/<ext>;base64,<body>`` with jpg spelled jpeg."""
    ext = F.regexp_replace(file_suffix(path), r"^\.", "")
    ext = F.when(ext == "jpg", F.lit("jpeg")).otherwise(ext)
    body = F.regexp_replace(F.base64(content), "\r?\n", "")
    return F.concat(F.lit("data:image/"), ext, F.lit(";base64,"), body)
