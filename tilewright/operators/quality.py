"""Reference quality: reply parsing, filters, outcome counts and distribution reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright import constants as K
from tilewright.functions import text as X
from tilewright.functions.truthy import truthy
from tilewright.operators.ranking import first_per_key
from tilewright.operators.selection import exact_percentiles


def parsed_replies(df: DataFrame, reply_col: str = "raw_response") -> DataFrame:
    """Add quality, reason and caption parsed from a model reply."""
    return df.select("*", *X.parse_reply(F.col(reply_col)))


def good_references(df: DataFrame) -> DataFrame:
    """No error, quality GOOD and a non-empty caption."""
    return df.where(
        ~truthy(F.col("error"), "string")
        & F.coalesce(F.col("quality") == "GOOD", F.lit(False))
        & truthy(F.col("caption"), "string")
    )


def require_category(df: DataFrame, category: str = K.LANDSCAPE_CATEGORY) -> DataFrame:
    """The same rows; fails when the category has none.

    The test is a scalar subquery evaluated with the query, not a driver action.
    """
    n = df.where(F.col("category") == category).limit(1).agg(F.count(F.lit(1))).scalar()
    checked = F.assert_true(n > 0, F.lit(f"no usable '{category}' reference"))
    return df.where(checked.isNull())


def outcome(error: Column, quality: Column) -> Column:
    """ERROR when an error is set, else GOOD or BAD; any other quality is uncounted (null)."""
    return F.when(truthy(error, "string"), "ERROR").when(quality == "GOOD", "GOOD").when(quality == "BAD", "BAD")


def outcome_counts(df: DataFrame) -> DataFrame:
    status = outcome(F.col("error"), F.col("quality"))
    return df.agg(*[F.count_if(status == s).alias(f"n_{s.lower()}") for s in ("GOOD", "BAD", "ERROR")])


def category_counts(df: DataFrame) -> DataFrame:
    """Good references per category with their share of all good references."""
    return df.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def landmark_status(df: DataFrame, paths_col: str = "reference_images", limit: int = 2) -> DataFrame:
    """Categories from the reference paths, number of landmarks, and the bad flag at ``limit``."""
    cats = F.transform(F.col(paths_col), lambda p: X.category_from_path(p))
    step = df.withColumn("categories", cats)
    n = F.size(F.filter("categories", lambda c: c == K.LANDSCAPE_CATEGORY))
    return step.withColumn("landmark_count", n).withColumn("is_bad", F.col("landmark_count") >= limit)


def category_combo(cats: Column, sep: str = " + ") -> Column:
    """Sorted categories with repeats, joined."""
    return F.array_join(F.sort_array(cats), sep)


def category_pairing(cats: Column, sep: str = "+") -> Column:
    """Sorted distinct categories joined; null when there is only one."""
    distinct = F.sort_array(F.array_distinct(cats))
    return F.when(F.size(distinct) > 1, F.array_join(distinct, sep))


def landmark_totals(status: DataFrame) -> DataFrame:
    total = status.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_bad").alias("bad"))
    pct = lambda c: F.when(F.col("total") > 0, F.lit(100.0) * c / F.col("total")).otherwise(0.0)
    good = F.col("total") - F.col("bad")
    return total.select("total", good.alias("good"), "bad", pct(good).alias("good_pct"), pct(F.col("bad")).alias("bad_pct"))


def landmark_histogram(status: DataFrame) -> DataFrame:
    return status.groupBy("landmark_count").agg(F.count(F.lit(1)).alias("n"))


def combo_counts(status: DataFrame) -> DataFrame:
    """All category combinations by falling count, ties by name."""
    return (
        status.groupBy(category_combo(F.col("categories")).alias("combo"))
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "combo")
    )


def bad_examples(status: DataFrame, order_col: str = "id", n: int = 10) -> DataFrame:
    return status.where("is_bad").orderBy(order_col).limit(n)


def top_pairings(df: DataFrame, cats_col: str = "reference_categories", k: int = 20) -> DataFrame:
    key = category_pairing(F.col(cats_col))
    return (
        df.select(key.alias("pairing")).where(F.col("pairing").isNotNull())
        .groupBy("pairing").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "pairing").limit(k)
    )


def counters(df: DataFrame, sections: dict[str, Column], slots: dict[str, Column] | None = None) -> DataFrame:
    """Many one-column counters in one pass: (section, key, n).

    Every row is unfolded into one (section, key) pair per counter, plus one per
    array element for ``slots``; partial counts are combined before the shuffle.
    """
    def pair(section: str):
        return lambda k: F.struct(F.lit(section).alias("section"), k.cast("string").alias("key"))

    pairs = [F.array(pair(s)(c)) for s, c in sections.items()]
    pairs += [F.transform(arr, pair(s)) for s, arr in (slots or {}).items()]
    flat = df.select(F.inline(F.concat(*pairs)))
    return flat.groupBy("section", "key").agg(F.count(F.lit(1)).alias("n"))


def with_percent(counts: DataFrame, total_section: str) -> DataFrame:
    """Share of samples, where one section counts every sample once."""
    total = counts.where(F.col("section") == total_section).agg(F.sum("n")).scalar()
    return counts.withColumn(
        "pct", F.when(total > 0, F.lit(100.0) * F.col("n") / total).otherwise(0.0)
    )


def composition_distribution(df: DataFrame, person: str = K.PERSON_CATEGORY) -> DataFrame:
    """Counters over composed samples with their percentage of samples."""
    cats = F.col("reference_categories")
    sections = {
        "num_references": F.size(cats),
        "scale": F.col("conditions.scale"),
        "rotation": F.col("conditions.rotation"),
        "lighting": F.col("conditions.lighting"),
        "interaction": F.when(truthy(F.col("conditions.interaction"), "string"), F.col("conditions.interaction")).otherwise("N/A"),
        "person_refs": F.size(F.filter(cats, lambda c: c == person)),
    }
    return with_percent(counters(df, sections, {"category": cats}), "num_references")


def theme_distribution(df: DataFrame) -> DataFrame:
    """Three sample-level and four object-level counters over theme prompts."""
    details = F.col("object_details")
    sections = {
        "theme": F.col("theme"),
        "shot_type": F.col("shot_type"),
        "character": F.when(F.col("has_character"), "with_character").otherwise("no_character"),
    }
    slots = {
        "location": F.transform(details, lambda d: d["location_key"]),
        "orientation": F.transform(details, lambda d: d["orientation_key"]),
        "color": F.transform(details, lambda d: d["color"]),
        "material": F.transform(details, lambda d: d["material"]),
    }
    return counters(df, sections, slots)


def report_lines(counts: DataFrame, sections: Sequence[str]) -> DataFrame:
    """Text lines of a counter report in section order, keys ordered as text."""
    rank = F.array_position(F.array(*[F.lit(s) for s in sections]), F.col("section"))
    body = counts.where(rank > 0)
    has_pct = "pct" in counts.columns
    text = (
        F.format_string("  %s: %d  (%.2f%%)", "key", "n", "pct") if has_pct
        else F.format_string("  %s: %d", "key", "n")
    )
    heads = body.select(rank.alias("s"), F.lit(0).alias("k"), F.lit("").alias("key"),
                        F.concat(F.lit("--- "), "section", F.lit(" ---")).alias("value")).distinct()
    lines = body.select(rank.alias("s"), F.lit(1).alias("k"), F.col("key"), text.alias("value"))
    return heads.unionByName(lines).orderBy("s", "k", "key").select("value")


def bounded_examples(df: DataFrame, side_col: str, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` examples of every problem side."""
    return first_per_key(df, [side_col], order, n, "example_no")


def run_counters(results: DataFrame) -> DataFrame:
    """done / skipped / failed per stage."""
    return results.groupBy("stage", "status").agg(F.count(F.lit(1)).alias("n"))


def depth_scaled(df: DataFrame, key: str, value: str, rule: str = "minmax") -> DataFrame:
    """Grouped depth normalisation to 0…65535.

    ``minmax`` truncates and gives 0 for a flat map; ``percentile`` clips between
    the 2nd and 98th percentile, falls back to min–max and rounds half to even.
    Bounds are aggregated per map and joined back, so a map may span tasks.
    """
    v = F.col(value).cast("double")
    if rule == "minmax":
        bounds = df.groupBy(key).agg(F.min(v).alias("depth_min"), F.max(v).alias("depth_max"))
        span = F.col("depth_max") - F.col("depth_min")
        scaled = F.when(span < 1e-8, F.lit(0)).otherwise(
            ((v - F.col("depth_min")) / span * F.lit(65535.0)).cast("int")
        )
        return df.join(bounds, key).withColumn("depth_u16", scaled)
    if rule != "percentile":
        raise ValueError(f"unknown rule {rule!r}")
    cuts = exact_percentiles(df, v, [0.02, 0.98], [key]).groupBy(key).agg(
        F.max(F.when(F.col("p") < 0.5, F.col("value"))).alias("q_lo"),
        F.max(F.when(F.col("p") > 0.5, F.col("value"))).alias("q_hi"),
    )
    bounds = df.groupBy(key).agg(F.min(v).alias("mn"), F.max(v).alias("mx")).join(cuts, key)
    lo, hi = F.col("q_lo"), F.col("q_hi")
    narrow = hi <= lo + 1e-6
    bounds = bounds.select(key, F.when(narrow, F.col("mn")).otherwise(lo).alias("depth_lo"),
                           F.when(narrow, F.col("mx")).otherwise(hi).alias("hi"))
    bounds = bounds.select(
        key, "depth_lo",
        F.when(F.col("hi") <= F.col("depth_lo") + 1e-6, F.col("depth_lo") + 1.0).otherwise(F.col("hi")).alias("depth_hi"),
    )
    x = (v - F.col("depth_lo")) / (F.col("depth_hi") - F.col("depth_lo"))
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return df.join(bounds, key).withColumn("depth_u16", F.bround(unit * F.lit(65535.0), 0).cast("int"))
