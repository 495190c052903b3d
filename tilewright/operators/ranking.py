"""Running numbers that stay distributed when one key holds most of the rows.

A plain ``row_number() over (partition by key order by …)`` sends a whole key to
one task. Here a key above ``hot_rows`` rows is cut into *bands*: values that
rise with the wanted order. Bands are numbered independently, and the size of
the earlier bands is added from a small table of counts. Keys that are not hot
keep one band and cost the usual single shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.draws import int_div

HOT_ROWS = 1_000_000
# At most this many keys are treated as hot. A key outside the list holds less
# than 1 / (MAX_HOT_KEYS + 1) of all rows, so it cannot dominate a stage.
MAX_HOT_KEYS = 2_000
# Largest rank limit that Spark applies in the map tasks
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1_000


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows; never more than MAX_HOT_KEYS of them.

    Counts are combined before the shuffle, so only (key, partial count) moves.
    """
    n = "__n"
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
        .where(F.col(n) > hot_rows)
        .orderBy(F.desc(n), *keys)
        .limit(MAX_HOT_KEYS)
        .select(*keys)
    )


def mark_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame, flag: str) -> DataFrame:
    """Add a boolean column; the hot list is bounded, so it is broadcast."""
    marked = hot.select(*[F.col(k).alias(f"__hot_{k}") for k in keys], F.lit(True).alias(flag))
    cond = None
    for k in keys:
        test = df[k].eqNullSafe(F.col(f"__hot_{k}"))
        cond = test if cond is None else cond & test
    out = df.join(F.broadcast(marked), cond, "left").drop(*[f"__hot_{k}" for k in keys])
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def falling_band(value: Column, scale: float = 1.0, limit: int = 2**50) -> Column:
    """Band of a value that is sorted downwards: NaN first and null last, just as the sort has them."""
    v = value.cast("double")
    held = F.greatest(F.lit(float(-limit)), F.least(F.lit(float(limit)), v * scale))
    return F.when(v.isNull(), F.lit(limit + 1)).when(F.isnan(v), F.lit(-limit - 1)).otherwise(-F.floor(held)).cast("long")


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    band: Column,
    name: str = "ordinal",
    start: int = 0,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Running number per key.

    ``order`` must be a total order. ``band`` must not fall along it: a row with
    a smaller band comes first (use e.g. ``-floor(score * 1000)`` for a
    descending score); a null band comes first. It only decides how a hot key is
    split.
    """
    keys = list(keys)
    flagged = mark_hot(df, keys, hot_keys(df, keys, hot_rows), "__is_hot")
    banded = flagged.withColumn("__band", F.when(F.col("__is_hot"), F.coalesce(band.cast("long"), F.lit(-(2**63))))).drop("__is_hot")

    return _band_numbers(df.columns, banded, keys, order, name, start)


def split_ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], band: Column, name: str = "ordinal", start: int = 0
) -> DataFrame:
    """:func:`ordinal` for a few large keys (categories, roots): every key is split, none is looked up first."""
    keys = list(keys)
    banded = df.withColumn("__band", F.coalesce(band.cast("long"), F.lit(-(2**63))))
    return _band_numbers(df.columns, banded, keys, order, name, start)


def _band_numbers(columns, banded: DataFrame, keys: list[str], order: Sequence[Column], name: str, start: int) -> DataFrame:
    """Row number inside the band plus the rows of the key's earlier bands.

    The keys go as one struct, which is never null: then the join compares by plain equality, and rows that the numbering
    has dealt by key and band stay where they are.
    """
    banded = banded.withColumn("__key", F.struct(*keys))
    tally = banded.where(F.col("__band").isNotNull()).groupBy("__key", "__band").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__key").orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tally.select(
        F.col("__key").alias("__of_key"),
        F.col("__band").alias("__k_band"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
    )
    numbered = banded.withColumn(
        "__rn", F.row_number().over(Window.partitionBy("__key", "__band").orderBy(*order))
    )
    joined = numbered.join(offsets, (F.col("__key") == F.col("__of_key")) & (F.col("__band") == F.col("__k_band")), "left")
    number = F.col("__rn") - 1 + F.coalesce(F.col("__before"), F.lit(0)) + F.lit(start)
    return joined.select(*columns, number.cast("long").alias(name))


def global_ordinal(
    df: DataFrame,
    order: Sequence[Column],
    bands: Sequence[Column],
    name: str = "ordinal",
) -> DataFrame:
    """Zero-based running number over the whole table, without a single-task sort.

    ``bands`` are compared left to right and must agree with ``order``. With
    two levels (say file, block in file) the counts of the inner level are added
    per outer band, so the only un-partitioned window runs over outer bands.
    """
    names = [f"__band{i}" for i in range(len(bands))]
    banded = df.select("*", *[b.alias(n) for b, n in zip(bands, names)])
    counts = banded.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))

    offsets = counts
    parts = []
    for level in range(len(names)):
        upto, outer, own = names[: level + 1], names[:level], names[level]
        if level < len(names) - 1:
            at = counts.groupBy(*upto).agg(F.sum("__n").alias("__n"))
        else:
            at = counts
        w = Window.partitionBy(*outer).orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
        part = f"__before{level}"
        before = at.select(*upto, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias(part))
        offsets = offsets.join(before, upto)
        parts.append(part)
    total = F.col(parts[0])
    for p in parts[1:]:
        total = total + F.col(p)
    offsets = offsets.select(*names, total.alias("__before"))

    numbered = banded.withColumn("__rn", F.row_number().over(Window.partitionBy(*names).orderBy(*order)))
    joined = numbered.join(offsets, names)
    return joined.select(*df.columns, (F.col("__rn") - 1 + F.col("__before")).cast("long").alias(name))


def digest_band(digest: Column, digits: int = 3) -> Column:
    """Band for rows ordered by a hex digest: its leading digits (4,096 bands by default)."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def split_points(df: DataFrame, column: str, parts: int = 256) -> list:
    """At most ``parts`` values that cut a numeric column into even bands.

    The list has a fixed bound and only steers partitioning; results do not
    depend on it.
    """
    probs = [i / parts for i in range(1, parts)]
    return sorted(set(df.approxQuantile(column, probs, 1.0 / (4 * parts))))


def band_of(column: Column, points: Sequence) -> Column:
    """Number of split points at or below the value (two-level scan of a short literal list)."""
    if not points:
        return F.lit(0).cast("long")
    width = max(1, int(len(points) ** 0.5))
    chunks = [points[i : i + width] for i in range(0, len(points), width)]
    result = F.lit(0)
    for i, chunk in enumerate(chunks):
        inside = F.size(F.filter(F.array(*[F.lit(p) for p in chunk]), lambda p: p <= column))
        start = F.lit(i * width)
        result = F.when(column >= F.lit(chunk[0]), start + inside).otherwise(result)
    return result.cast("long")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per key, one-based rank kept.

    The rank filter sits directly on the window, so Spark keeps only ``n`` rows
    per key in every map task before it shuffles (WindowGroupLimit).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def ordered_lists(
    df: DataFrame, keys: Sequence[str], ordinal_col: str, fields: Sequence[str | Column], name: str = "items",
) -> DataFrame:
    """One ordered list per key, of the same form at every size; nothing is dropped.

    The items begin with ``ordinal_col`` and sort by it, then by the other fields.
    Lists are gathered in the map tasks first; the finished list is one value of one row.
    """
    cols = [F.col(f) if isinstance(f, str) else f for f in fields]
    item = F.struct(F.col(ordinal_col), *cols)
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias(name))
