"""Exact values at given ranks by radix selection, without a sort and without a shuffle of the values."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bits that the second pass looks at; the first one takes those above.
DIGIT = 22
FRACTION = 30  # bits of log2 behind the point
ABOVE = 1 << (FRACTION + 11)  # log2 of a double lies between -1074 and 1024


def double_cell(v: Column) -> Column:
    """Long that never falls while the double rises (one logarithm, which Java keeps monotonic).

    Values of one cell agree in their leading 30 bits or so, hence a cell has less
    than 2^23 different values. Zero, the infinities and NaN (the largest) have
    cells of their own; null stays null.
    """
    a = F.abs(v)
    cell = (
        F.when(a > 0, F.floor(F.log2(F.least(a, F.lit(1.7976931348623157e308))) * float(1 << FRACTION)) + ABOVE)
        .otherwise(F.lit(0).cast("long"))
    )
    signed = F.signum(v).cast("long") * cell
    special = F.when(F.isnan(v), F.lit(2 * ABOVE + 1)).when(a == float("inf"), F.signum(v).cast("long") * (2 * ABOVE))
    return F.coalesce(special, signed)


def values_at_ranks(
    df: DataFrame, value: str, ranks: Callable[[Column], Column], keys: Sequence[str] = ()
) -> DataFrame:
    """Values at wanted ranks per key: (keys, tag, value), one row per wanted rank.

    ``value`` names a number column (integers or doubles); nulls are left out.
    ``ranks`` maps the number of values of a key to an array of
    ``struct<r: bigint, tag>`` with zero-based ascending ranks; ranks outside
    the key give no row. Without keys the cells that hold a wanted rank are
    broadcast: no more of them than wanted ranks, which the caller writes out.

    Three passes over the input. The first two count rows by leading bits of an
    order-preserving integer in the map tasks (2^20 counts a key at most, then 2^22
    inside a cell that holds a wanted rank), the third one counts the values of
    such a cell. Repeated values, any scale and any spread cost the same, and no
    task gets the values of a key.
    """
    keys = list(keys)
    v = F.col("__v")
    exact = dict(df.select(value).dtypes)[value] in ("tinyint", "smallint", "int", "bigint")
    rows = df.select(*keys, F.col(value).alias("__v")).where(v.isNotNull())
    cell, shift = (v.cast("long"), 2 * DIGIT) if exact else (double_cell(v.cast("double")), DIGIT)
    rows = rows.withColumn("__d1", cell)
    low = F.lit(2**DIGIT - 1).cast("long")
    rows = rows.select(
        *keys, "__v", F.shiftright("__d1", shift).alias("__d0"),
        F.shiftright("__d1", shift - DIGIT).bitwiseAND(low).alias("__d1"))
    few = not keys  # then at most one cell per wanted rank, hence broadcast
    same = lambda cols: reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__c_{c}")) for c in cols])
    cells, group = None, keys
    for own in ("__d0", "__d1", "__v"):
        # The wanted ranks depend on the cell alone; as grouping columns they come along without a second join.
        inside, carried = (rows, []) if cells is None else (rows.join(cells, same(group)), ["__ranks"])
        found = inside.groupBy(*group, own, *carried).agg(F.count(F.lit(1)).alias("__n"))
        by = Window.partitionBy(*group)
        before = F.sum("__n").over(by.orderBy(own).rowsBetween(Window.unboundedPreceding, -1))
        found = found.withColumn("__before", F.coalesce(before, F.lit(0)))
        if cells is None:
            found = found.withColumn("__ranks", ranks(F.sum("__n").over(by)))
        start, end = F.col("__before"), F.col("__before") + F.col("__n")
        holds = F.filter("__ranks", lambda x: (x["r"] >= start) & (x["r"] < end))
        # The rank inside the cell goes on; the tag tells the wanted ranks apart.
        hits = F.transform(holds, lambda x: F.struct((x["r"] - start).alias("r"), x["tag"].alias("tag")))
        kept = found.select(*group, own, hits.alias("__hits")).where(F.size("__hits") > 0)
        group = [*group, own]
        cells = kept.select(*[F.col(c).alias(f"__c_{c}") for c in group], F.col("__hits").alias("__ranks"))
        cells = F.broadcast(cells) if few else cells
    return kept.select(*keys, F.explode("__hits").alias("__hit"), "__v").select(
        *keys, F.col("__hit.tag").alias("tag"), F.col("__v").alias("value")
    )


def exact_percentiles(df: DataFrame, value: Column, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated percentiles, exact at any size and scale: (keys, p, value).

    The built-in ``percentile`` ends in one task per key that holds every
    distinct value; here the two neighbours of every rank are selected by
    :func:`values_at_ranks`. Nulls are left out; NaN counts as the largest value.
    A key without values gives no row.
    """
    keys = list(keys)
    v = df.select(*keys, value.cast("double").alias("v"))

    def neighbours(total: Column) -> Column:
        items = []
        for i, p in enumerate(probs):
            r = F.lit(float(p)) * (total - 1)
            share = (r - F.floor(r)).alias("share")
            items += [
                F.struct(at(r).cast("long").alias("r"),
                         F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), F.lit(upper).alias("upper"), share).alias("tag"))
                for upper, at in ((False, F.floor), (True, F.ceil))
            ]
        return F.array(*items)

    ends = values_at_ranks(v, "v", neighbours, keys).select(*keys, "tag.*", "value")
    pick = lambda side: F.max(F.when(F.col("upper") == side, F.col("value")))
    both = ends.groupBy(*keys, "i", "p").agg(
        pick(False).alias("a"), pick(True).alias("z"), F.max("share").alias("share")
    )
    a, z = F.col("a"), F.col("z")
    return both.select(*keys, "p", F.when(a == z, a).otherwise(a + (z - a) * F.col("share")).alias("value"))


def up_to_rank(df: DataFrame, keys: Sequence[str], value: str, n: int) -> DataFrame:
    """``__least`` and ``__nth`` per key: its smallest value and its n-th smallest (the largest, if it has fewer)."""
    last = lambda total: F.array(*[
        F.struct(r.cast("long").alias("r"), F.lit(i).alias("tag"))
        for i, r in enumerate((F.lit(0), F.least(total, F.lit(n)) - 1))
    ])
    at = values_at_ranks(df, value, last, keys)
    return at.groupBy(*keys).agg(
        F.max(F.when(F.col("tag") == 0, F.col("value"))).alias("__least"),
        F.max(F.when(F.col("tag") == 1, F.col("value"))).alias("__nth"),
    )
