"""Operator 7: mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.common import WORD, documents, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_TOKENS = 64
SHARD_TOKENS = 262_144
SEED = 7


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text; null: 0)."""
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       size.cast("long").alias("size"))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, rank, source_size, n_docs, target.

    Sources by code point (null last) weigh ``weights`` in turn and share ``share`` of all sizes; a target stops at
    ``most`` times its source's size. In order of the level at which they stop, a source stops if the level of what
    is left by those before it reaches its own; the rest share what is left by weight. Windows run over one
    pre-aggregated row per source.
    """
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = each.withColumn("rank", rank).withColumn("w", weight).withColumn("stop", (most * F.col("source_size")).cast("double"))
    every = Window.partitionBy()
    by_level = Window.orderBy(F.col("stop") / F.col("w"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levelled = ranked.withColumn("level", level).withColumn("stops", F.col("stop") <= F.col("w") * F.col("level"))
    rest = F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(
        by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("stops"), F.col("stop")).otherwise(F.col("w") * F.col("rest"))
    return levelled.withColumn("rest", rest).select("source", "rank", "source_size", "n_docs", target.alias("target"))


def sainte_lague(df: DataFrame, keys: list[str], item: str, votes: str, seats: str, name: str) -> DataFrame:
    """Add ``name``: seats of each item when its key's ``seats`` go to the highest quotients votes / (2 k - 1).

    Quotients that surely win are counted in closed form: with n items, floor(votes * (seats -+ n/2) / total + 1/2)
    bound each item's seats from both sides. Only the few between the bounds (about n) are listed and ranked; ties go
    to the smaller ``item``.
    """
    key = Window.partitionBy(*keys)
    total, n = F.sum(votes).over(key), F.count(F.lit(1)).over(key)
    share = F.col(votes) / F.when(total > 0, total)
    low = F.greatest(F.lit(0), F.floor(share * (F.col(seats) - n / 2) + 0.5) - 1)
    high = F.floor(share * (F.col(seats) + n / 2) + 0.5) + 1
    bounded = df.select("*", F.coalesce(low, F.lit(0)).cast("long").alias("__low"), F.coalesce(high, F.lit(0)).cast("long").alias("__high"))
    bounded = bounded.withColumn("__rest", F.col(seats) - F.sum("__low").over(key))
    listed = bounded.select(*keys, item, "__rest", votes, F.explode(
        F.when(F.col("__high") > F.col("__low"), F.sequence(F.col("__low") + 1, F.col("__high")))).alias("__k"))
    quotient = F.col(votes) / (2 * F.col("__k") - 1)
    won = (listed.withColumn("__rank", F.row_number().over(key.orderBy(quotient.desc(), item, "__k")))
           .where(F.col("__rank") <= F.col("__rest")).groupBy(*keys, item).agg(F.count(F.lit(1)).alias("__won")))
    return bounded.join(won, [*keys, item], "left").withColumn(
        name, F.col("__low") + F.coalesce("__won", F.lit(0))).drop("__low", "__high", "__rest", "__won")


def _digest(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def chosen_before(block: Column, mark: str = "") -> Column:
    """Chosen blocks of the shard before ``block``: evenly spread picks from a seeded phase, quota in all."""
    return F.floor((block * F.col(mark + "quota") + F.col(mark + "phase")) / F.col(mark + "n_blocks")).cast("long")


def is_chosen(block: Column, mark: str = "") -> Column:
    return chosen_before(block + 1, mark) - chosen_before(block, mark)


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK_TOKENS,
             shard_tokens: int = SHARD_TOKENS, seed: int = SEED, keep=()) -> DataFrame:
    """Per document what the mix takes: doc_id, size, source_size, target, taken, and how: ``copies`` whole copies, then
    the words whose block is chosen (word i lies in block (start + i) div ``block`` of a line of ``n_blocks`` blocks).

    All sources share round(sum of targets / block) blocks by Sainte-Laguë quotients of their targets. A source's blocks
    are whole copies of it and a rest. Its documents lie in seeded order in shards of about ``shard_tokens`` words,
    which share the rest by quotients of their sizes; each shard then picks its quota of blocks from a seeded phase.
    ``keep`` names columns of ``docs`` to carry along (such as a row id).
    """
    sized = sizes(docs) if not keep else docs.select(*keep, *[c.alias(n) for c, n in zip(
        [F.col("doc_id").cast("long"), F.col("source").cast("string"),
         F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")], ["doc_id", "source", "size"])])
    sized = stored(sized, "sizes")
    # Small per-source table: stored, so that its joins see its real size.
    goal = targets(sized, weights, share, most)
    goal = goal.withColumn("all_blocks", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
    goal = sainte_lague(goal, [], "rank", "target", "all_blocks", "blocks")
    take = F.least(F.col("blocks") * block, most * F.col("source_size"))
    size1 = F.greatest(F.col("source_size"), F.lit(1))
    goal = goal.select(
        "source", "rank", "source_size", "target", F.floor(take / size1).cast("long").alias("copies"),
        F.round((take - F.floor(take / size1) * F.col("source_size")) / block).cast("long").alias("rest_blocks"),
        F.ceil((F.col("source_size") + F.col("n_docs")) / shard_tokens).cast("long").alias("n_shards"))
    goal = stored(goal, "sources")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    lines = sized.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select(
        *keep, "doc_id", "size", "rank", "source_size", "target", "copies", "rest_blocks",
        F.pmod(_number(_digest(seed, "shard", key)), F.col("n_shards")).alias("shard"), _digest(seed, "order", key).alias("place"))
    shards = lines.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"), F.first("rest_blocks").alias("rest_blocks"))
    shards = sainte_lague(shards, ["rank"], "shard", "shard_size", "rest_blocks", "won")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block)).cast("long")
    shards = shards.select(F.col("rank").alias("__rank"), F.col("shard").alias("__shard"), n_blocks.alias("n_blocks"), F.least("won", n_blocks).alias("quota"),
                           F.pmod(_number(_digest(seed, "phase", F.col("rank").cast("string"), F.col("shard").cast("string"))), n_blocks).alias("phase"))
    order = Window.partitionBy("rank", "shard").orderBy("place", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0)))
    placed = placed.join(shards, (F.col("rank") == F.col("__rank")) & (F.col("shard") == F.col("__shard")))
    end = F.col("start") + F.col("size")
    first, last = F.floor(F.col("start") / block).cast("long"), F.floor((end - 1) / block).cast("long")
    part = F.when(F.col("size") == 0, F.lit(0)).when(first == last, is_chosen(first) * F.col("size")).otherwise(
        is_chosen(first) * ((first + 1) * block - F.col("start")) + is_chosen(last) * (end - last * block)
        + block * (chosen_before(last) - chosen_before(first + 1)))
    return placed.select(*keep, "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + part).cast("long").alias("taken"),
                         "copies", "start", "n_blocks", "quota", "phase")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document.

    Null sources are one source, the last. Empty texts have size 0 and nothing is taken from them; if all are empty,
    targets are 0. Null ids count as empty text in the seeded order; equal rows are interchangeable, so reruns agree.
    An empty table gives no rows; other columns are ignored.
    """
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """The mix itself, in the columns of ``docs``: whole copies as repeated rows, a part as the chosen words in a row.

    Needs doc_id, text, source; n_chars follows a part where present. Rows without taken words are not in the mix, so null
    and empty texts are not. Null sources are one source; null ids count as empty text in the seeded order; repeated rows
    are taken each on their own; an empty table gives no rows; other columns go along, whatever their names.
    """
    names = docs.columns
    marked = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc")), "numbered")
    plan = mix_plan(marked.select("row", "doc.doc_id", "doc.text", "doc.source"), keep=("row",)).where("taken > 0")
    plan = plan.select(*[F.col(c).alias("__p" + c) for c in ("row", "size", "taken", "copies", "start", "n_blocks", "quota", "phase")])
    words = F.array_remove(F.split("doc.text", "[\\x20\\x09-\\x0D]+"), "")
    joined = marked.join(plan, F.col("row") == F.col("__prow"))
    partial = F.col("__ptaken") > F.col("__pcopies") * F.col("__psize")
    rows = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__pcopies") + partial.cast("int"))))
    cut = F.array_join(F.filter(words, lambda w, i: is_chosen(F.floor((F.col("__pstart") + i) / block).cast("long"), "__p") == 1), " ")
    text = F.when(F.col("__copy") > F.col("__pcopies"), cut).otherwise(F.col("doc.text"))
    rows = rows.withColumn("__text", text)
    out = {"text": F.col("__text")}
    if "n_chars" in names:
        out["n_chars"] = F.when(F.col("__copy") > F.col("__pcopies"), F.length("__text")).otherwise(F.col("doc.n_chars"))
    return rows.select(*[out.get(n, F.col(f"doc.`{n}`")).cast(docs.schema[n].dataType).alias(n) for n in names])


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
