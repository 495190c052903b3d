"""Connected components of a link table, by alternating large and small stars.

Every round replaces links by links to the smallest neighbour, so paths shorten as their logarithm.
A hub's links are aggregated (min) before they are shuffled and are never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import stored


def _star(links: DataFrame, both: bool) -> DataFrame:
    """One star step on (a > b) links; ``both`` takes all neighbours of a node, else the smaller ones."""
    arcs = links.select("a", "b")
    if both:
        arcs = arcs.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = arcs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    hung = arcs.join(least, "a")
    if both:  # larger neighbours hang below the smallest one
        moved = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # the node and its smaller neighbours hang below the smallest one
        moved = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(hung.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def _mark(links: DataFrame) -> tuple:
    """Count and hash sum of distinct links: equal for equal sets."""
    return tuple(links.agg(F.count("a"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b: long); root is the component's smallest node.

    Self-links, repeated links and nulls are left out; nodes without a link don't appear.
    """
    links = links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links, "links")
    mark = _mark(links)
    while True:
        links = stored(_star(_star(links, True), False), "links")
        before, mark = mark, _mark(links)
        if mark == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select(F.col("b"), F.col("b")).distinct())
