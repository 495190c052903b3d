"""Theme prompt generators: balanced cycles and systematic walks over permutations."""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright import constants as K
from tilewright.functions import text as X
from tilewright.functions.draws import base_order, draw_below, draw_u32, draw_unit, int_div, py_u32, small_cycle_positions
from tilewright.operators.sampling import balanced_inclusion, distinct_block, even_slot, inclusion_block

N = K.OBJECTS_PER_THEME
THEMES = list(K.THEME_OBJECTS)
SHOTS = list(K.SHOT_LABELS)
_LOCATION_TEXT = dict(K.LOCATIONS)


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def theme_catalog(spark: SparkSession) -> DataFrame:
    """Ten rows: theme, setting, objects, surfaces, characters and surfaces of furniture-sized objects."""
    rows = [
        (i, t, K.THEME_SETTINGS[t], K.THEME_OBJECTS[t], K.THEME_SURFACES[t], K.THEME_CHARACTERS[t],
         {o: K.SURFACE_OVERRIDES[o] for o in K.THEME_OBJECTS[t] if o in K.SURFACE_OVERRIDES})
        for i, t in enumerate(THEMES)
    ]
    return spark.createDataFrame(
        rows, "theme_no int, theme string, setting string, theme_objects array<string>, "
        "surfaces array<string>, characters array<string>, overrides map<string,array<string>>",
    )


def shot_catalog(spark: SparkSession, shots: Sequence[str] = tuple(SHOTS)) -> DataFrame:
    """One row per shot type: label, camera text and usable locations."""
    rows = [
        (i, s, K.SHOT_LABELS[s], K.SHOT_CAMERAS[s], K.SHOT_LOCATIONS[s], place_weights(len(K.SHOT_LOCATIONS[s]), N))
        for i, s in enumerate(shots)
    ]
    return spark.createDataFrame(
        rows, "shot_no int, shot_type string, shot_label string, camera_text string, "
        "location_keys array<string>, location_weights array<bigint>",
    )


def product_digit(index: Column, n: int, j: int) -> Column:
    """Digit j (low first) of the index-th element of a product of n-sized pools."""
    return F.pmod(int_div(index, n**j), F.lit(n)).cast("int")


def unranked(rank: Column, pool: Column, weights: Column | Sequence[int], take: int) -> Column:
    """The rank-th arrangement of ``take`` distinct entries of array ``pool``.

    Arrangements are numbered in lexicographic order of pool positions.
    ``weights[j]`` is the number of arrangements of the places after j. Digits
    come from the rank by arithmetic, so no list of arrangements exists anywhere.
    """
    if not isinstance(weights, Column):
        weights = F.array(*[F.lit(w).cast("long") for w in weights])
    digits = F.array(*[
        F.pmod(int_div(rank, F.element_at(weights, j + 1)), F.size(pool) - j).cast("int") for j in range(take)
    ])
    start = F.struct(pool.alias("rest"), F.slice(pool, 1, 0).alias("out"))

    def place(acc, digit):
        pick = F.element_at(acc["rest"], digit + 1)
        return F.struct(F.array_remove(acc["rest"], pick).alias("rest"), F.array_append(acc["out"], pick).alias("out"))

    return F.aggregate(digits, start, place, lambda acc: acc["out"])


def place_weights(m: int, take: int) -> list[int]:
    """Arrangements of the remaining places after each of ``take`` picks from ``m`` entries."""
    return [_arrangements(m - j - 1, take - j - 1) for j in range(take)]


def _arrangements(m: int, take: int) -> int:
    return factorial(m) // factorial(m - take)


def _shot_constants(shots: Sequence[str], seed: int) -> dict[str, Column]:
    """Per shot: number of location arrangements and the affine map that shuffles them."""
    totals, steps, shifts = [], [], []
    for s in shots:
        total = _arrangements(len(K.SHOT_LOCATIONS[s]), N)
        step = py_u32(seed, "loc_step", s) % total
        while step == 0 or not _coprime(step, total):
            step = (step + 1) % total
        totals.append(total)
        steps.append(step)
        shifts.append(py_u32(seed, "loc_shift", s) % total)
    longs = lambda v: F.array(*[F.lit(x).cast("long") for x in v])
    return {"total": longs(totals), "step": longs(steps), "shift": longs(shifts)}


def _coprime(a: int, b: int) -> bool:
    while b:
        a, b = b, a % b
    return a == 1


def _details(objects: Column, surface, loc_keys: Column, loc_texts: dict[str, str], orientation, color, material) -> Column:
    texts = F.create_map(*[F.lit(x) for kv in loc_texts.items() for x in kv])
    okeys, otexts = _strings([k for k, _ in K.ORIENTATIONS]), _strings([t for _, t in K.ORIENTATIONS])
    items = []
    for j in range(N):
        o = orientation(j) + 1
        loc = F.element_at(loc_keys, j + 1)
        items.append(F.struct(
            F.element_at(objects, j + 1).alias("object"), surface(j).alias("surface_text"),
            loc.alias("location_key"), F.element_at(texts, loc).alias("location_text"),
            F.element_at(okeys, o).alias("orientation_key"), F.element_at(otexts, o).alias("orientation_text"),
            color(j).alias("color"), material(j).alias("material"),
        ))
    return F.array(*items)


def _finished(df: DataFrame) -> DataFrame:
    """Ids, flags and the structured prompt shared by both generators."""
    return df.select(
        F.concat(F.col("theme"), F.lit("_"), F.format_string("%06d", "sample_no")).alias("id"),
        "sample_no", "theme", "shot_type", F.col("character_text").isNotNull().alias("has_character"), "character_text",
        F.size("object_details").alias("num_objects"),
        F.transform("object_details", lambda d: d["object"]).alias("objects"), "object_details",
        theme_prompt().alias("structured_prompt"),
    )


def theme_prompt() -> Column:
    """Prompt text from setting, camera, optional character and object lines."""
    has = F.col("character_text").isNotNull()
    block = X.fill_template(K.CHARACTER_BLOCK, n=F.lit(N), character=F.coalesce("character_text", F.lit("")))
    return X.fill_template(
        K.THEME_TEMPLATE, theme=F.translate("theme", "_", " "), shot_label=F.col("shot_label"),
        setting=F.col("setting"), camera_text=F.col("camera_text"),
        character_block=F.when(has, block).otherwise(""), n=F.lit(N),
        structured_block=X.structured_description(F.col("object_details")),
        character_instruction=F.when(has, K.CHARACTER_PRESENT).otherwise(K.CHARACTER_ABSENT),
        character_object_note=F.when(has, K.CHARACTER_NOTE).otherwise(""),
    )


def _with_theme(samples: DataFrame, index_col: str, total) -> DataFrame:
    """Theme number and position inside the theme, then the ten-row catalogue by broadcast."""
    group, inside = even_slot(F.col(index_col), total, len(THEMES))
    spark = samples.sparkSession
    return samples.select(
        F.col(index_col).cast("long").alias("sample_no"), group.alias("theme_no"), inside.alias("in_theme")
    ).join(F.broadcast(theme_catalog(spark)), "theme_no")


def max_permutations(
    samples: DataFrame, total, seed: int, shots: Sequence[str] = tuple(SHOTS), people_fraction: float = 0.5,
    index_col: str = "sample_no",
) -> DataFrame:
    """Systematic walk: every axis advances with the sample number, so samples repeat as late as possible.

    ``samples`` holds dense indexes 0…total-1. Location arrangements are
    unranked from a shuffled number; the longest axis (665,280 arrangements) is
    never listed.
    """
    spark = samples.sparkSession
    step = _with_theme(samples, index_col, total)
    g = F.col("global_no")
    step = step.withColumn("global_no", F.col("theme_no").cast("long") * K.THEME_STRIDE + F.col("in_theme"))
    step = step.withColumn("shot_no", F.pmod(g, F.lit(len(shots))).cast("int"))
    step = step.join(F.broadcast(shot_catalog(spark, shots)), "shot_no")
    const = _shot_constants(shots, seed)
    at = lambda name: F.element_at(const[name], F.col("shot_no") + 1)
    step = step.withColumn("loc_rank", F.pmod(F.pmod(g, at("total")) * at("step") + at("shift"), at("total")))
    obj_rank = F.pmod(draw_u32(seed, "objects", g), F.lit(factorial(N)))
    step = step.select(
        "*", unranked(F.col("loc_rank"), F.col("location_keys"), F.col("location_weights"), N).alias("loc_arrangement"),
        unranked(obj_rank, F.col("theme_objects"), place_weights(N, N), N).alias("ordered_objects"),
    )
    theme = F.col("theme_no")
    who = F.element_at("characters", (draw_below(F.size("characters"), seed, "who", g) + 1).cast("int"))
    step = step.withColumn("character_text", F.when(draw_unit(seed, "people", g) < people_fraction, who))

    def surface(j: int) -> Column:
        own = F.try_element_at("overrides", F.element_at("ordered_objects", j + 1))
        drawn = F.try_element_at(own, (draw_below(2, seed, f"override{j}", g) + 1).cast("int"))  # two texts each
        plain = F.element_at("surfaces", product_digit(g * 19 + theme, N, j) + 1)  # six surfaces per theme
        return F.coalesce(drawn, plain)

    details = _details(
        F.col("ordered_objects"), surface, F.col("loc_arrangement"), _LOCATION_TEXT,
        lambda j: product_digit(g, len(K.ORIENTATIONS), j),
        lambda j: F.element_at(_strings(K.COLORS), product_digit(g * 7 + theme, len(K.COLORS), j) + 1),
        lambda j: F.element_at(_strings(K.MATERIALS), product_digit(g * 13 + theme, len(K.MATERIALS), j) + 1),
    )
    return _finished(step.withColumn("object_details", details))


def _shot_picks(keys: Sequence[str], slots: Column, turn: Column, seed: int, salt: str) -> Column:
    """Distinct locations of one shot type for all object slots (:func:`distinct_positions` of them at once)."""
    n = len(keys)
    block = distinct_block(N, n)
    numbers = F.transform(slots, lambda j: int_div(turn, block) * n + F.pmod(F.pmod(turn, F.lit(block)) * N + j, F.lit(n)))
    return _entries([keys[p] for p in base_order(n, seed, salt)], small_cycle_positions(numbers, n, seed, salt))


def _entries(pool: Sequence[str], positions: Column) -> Column:
    ordered = _strings(pool)
    return F.transform(positions, lambda p: F.element_at(ordered, p + 1))


def balanced_themes(
    samples: DataFrame, total, seed: int, shots: Sequence[str] = tuple(SHOTS), people_fraction: float = 0.5,
    index_col: str = "sample_no",
) -> DataFrame:
    """Exact total, balanced over themes; every axis is drawn in balanced cycles.

    The cycles of a theme's characters and surfaces advance only when they are drawn from: by samples with a
    character, and by objects without surfaces of their own.
    """
    spark = samples.sparkSession
    step = _with_theme(samples, index_col, total)
    i = F.col("sample_no")
    one = lambda number, n, salt: small_cycle_positions(F.array(number), n, seed, salt)[0]
    shot_no = one(i, len(shots), "shot")
    step = step.withColumn("shot_no", shot_no).join(F.broadcast(shot_catalog(spark, shots)), "shot_no")

    # A shot type comes up once per cycle of shots, so the cycle number counts its samples.
    turn = int_div(i, len(shots))
    slots = F.sequence(F.lit(0), F.lit(N - 1))
    arranged = F.lit(None).cast("array<string>")
    for no, s in enumerate(shots):
        picks = _shot_picks(K.SHOT_LOCATIONS[s], slots, turn, seed, f"loc_{s}")
        arranged = F.when(F.col("shot_no") == no, picks).otherwise(arranged)

    # One array per axis: all of them are drawn together, batch by batch.
    draws = F.transform(slots, lambda j: i * N + j)

    def axis(pool: Sequence[str], salt: str) -> Column:
        return _entries([pool[p] for p in base_order(len(pool), seed, salt)], small_cycle_positions(draws, len(pool), seed, salt))

    turned = small_cycle_positions(draws, len(K.ORIENTATIONS), seed, "orientation")
    # Objects of a theme without own surfaces; the k-th of them takes the k-th surface draw of the sample.
    bare = F.filter("theme_objects", lambda o: F.try_element_at("overrides", o).isNull())
    step = step.withColumn("bare", bare)
    n_s = len(next(iter(K.THEME_SURFACES.values())))

    surface_draws = F.transform("theme_objects", lambda o: F.when(
        F.array_position("bare", o) > 0, F.col("in_theme") * F.size("bare") + F.array_position("bare", o) - 1))
    plain = F.transform(small_cycle_positions(surface_draws, n_s, seed, "surface"), lambda p: F.element_at("surfaces", p + 1))
    n_chars = len(next(iter(K.THEME_CHARACTERS.values())))
    block = inclusion_block(people_fraction, n_chars)
    shown, turn_no = balanced_inclusion(F.col("in_theme"), people_fraction, n_chars, seed, "people", one(F.col("in_theme"), block, "people"))
    step = step.select(
        "*", arranged.alias("loc_arrangement"), axis(K.COLORS, "color").alias("colors"),
        axis(K.MATERIALS, "material").alias("materials"), turned.alias("turned"), plain.alias("plain_surfaces"),
        *[one(F.col("in_theme"), 2, f"override{j}").alias(f"pair{j}") for j in range(N)], shown.alias("shown"), turn_no.alias("turn_no"),
    )

    def surface(j: int) -> Column:
        own = F.try_element_at("overrides", F.element_at("theme_objects", j + 1))
        return F.coalesce(F.try_element_at(own, F.col(f"pair{j}") + 1), F.element_at("plain_surfaces", j + 1))

    at = lambda name: (lambda j: F.element_at(name, j + 1))
    details = _details(
        F.col("theme_objects"), surface, F.col("loc_arrangement"), _LOCATION_TEXT, at("turned"), at("colors"), at("materials")
    )
    who = one(F.col("turn_no"), n_chars, "who")
    step = step.withColumn("character_text", F.when(F.col("shown"), F.element_at("characters", who + 1)))
    return _finished(step.withColumn("object_details", details))


def balanced_per_theme(spark: SparkSession, per_theme: int, seed: int, **options) -> DataFrame:
    """The same with a fixed number of samples for every theme."""
    total = per_theme * len(THEMES)
    return balanced_themes(spark.range(total).withColumnRenamed("id", "sample_no"), total, seed, **options)
