"""Operator 6: quality rules, a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import SPACES, documents

# Frequent function words, looked up in A-Z lower-cased words.
STOP_WORDS = (
    "the of and to in a is that it for on was with as be by this are at from or an not which you "
    "der die und das den von zu mit sich auf für ist im dem nicht ein eine "
    "le la les de des et en un une du que est pour qui dans par sur au pas "
    "el los las y del se por con no una su para al lo como"
).split()
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: metric, least and greatest allowed value (None: no bound). A document is kept if all rules hold.
RULES = (
    ("mean_word_chars", 2.0, 15.0),
    ("symbols_per_word", None, 0.2),
    ("duplicate_line_share", None, 0.5),
    ("stop_word_share", 0.01, None),
)
#: Metrics as SQL over the counted columns; Spark and DuckDB read them alike.
METRICS = {
    "mean_word_chars": "cast(word_chars as double) / n_words",
    "symbols_per_word": "cast(n_symbols as double) / n_words",
    "duplicate_line_share": "cast(n_dup_lines as double) / n_lines",
    "stop_word_share": "cast(n_stop_words as double) / n_words",
}


def compiled(rules=RULES) -> str:
    """The table as one SQL condition."""
    parts = []
    for metric, low, high in rules:
        parts += [f"{METRICS[metric]} >= {low}"] * (low is not None) + [f"{METRICS[metric]} <= {high}"] * (high is not None)
    return " and ".join(parts) or "true"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text.

    Windows are compared as text. Only texts with an equal pair are sorted: equal windows then stand side by side, and
    the covered words are counted from their positions in order.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.array_join(F.slice(words, i + 1, WINDOW), " "))

    def covered(sorted_windows: Column) -> Column:
        last = F.size(sorted_windows) - 1
        at = F.transform(F.sequence(F.lit(0), last), lambda j: F.when(
            ((j > 0) & (F.get(sorted_windows, j - 1)["w"] == F.get(sorted_windows, j)["w"]))
            | ((j < last) & (F.get(sorted_windows, j + 1)["w"] == F.get(sorted_windows, j)["w"])), F.get(sorted_windows, j)["i"]))
        return F.aggregate(
            F.sort_array(F.array_compact(at)), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n"), (i + WINDOW).alias("end")),
            lambda acc: acc["n"])

    def count(w: Column) -> Column:
        numbered = F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i")))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(F.sort_array(numbered), covered))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(windows, count))


def quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_stop_words.

    Null and empty texts have zero words and fail. Repeated rows and null ids keep their rows; an empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    blank = F.translate("text", SPACES, "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES, "") != "")
    split = own.select(
        "doc_id", F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "").alias("words"), lines.alias("lines"),
        F.length(blank).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    lower = F.transform("words", lambda w: F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    counted = split.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter(lower, lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    kept = F.when(failed, F.lit(False)).otherwise(F.expr(compiled(rules)))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          failed.alias("base_failed"), kept.alias("kept"), "n_lines", "n_stop_words")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


_STOP_LIST = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS gram
    FROM w, unnest(range(1, len(words) - 3)) AS r(i) WHERE len(words) >= 5),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS r(k) WHERE n > 1 GROUP BY rid),
c AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
    (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines,
    len(list_filter(words, lambda x: list_contains({_STOP_LIST}, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))))::BIGINT AS n_stop_words
    FROM w LEFT JOIN covered USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    CASE WHEN base_failed THEN false ELSE {compiled()} END AS kept, n_lines, n_stop_words FROM f
"""
