"""Reproducible pseudo-random draws.

Every draw is a function of (seed, salt, key) only, through MD5, so it neither
depends on partitioning nor on retries, and any SQL engine with ``md5`` can
recompute it.
"""

from __future__ import annotations

import hashlib
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Swap rounds of the theme generator's short axes, and their longest pool (a round's bits come from one 32-bit number).
SWAP_ROUNDS = 4
LITERAL_POOL = 24
#: Rounds of a cycle's permutation, the prime that its arithmetic is done under (products of two numbers below it fit
#: a long), and one multiplier for each round and for the two steps of a cycle's key.
ROUNDS = 6
PRIME = 2**31 - 1
MULTIPLIERS = (48271, 69621, 742938285, 950706376, 630360016, 397204094, 62089911, 1226874159)


def _text(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def draw_digest(seed: int, salt: str, *key) -> Column:
    """32 hex digits for (seed, salt, key); sorting by it is a seeded shuffle."""
    return F.md5(_text(seed, salt, *key))


def draw_u32(seed: int, salt: str, *key) -> Column:
    """Integer in [0, 2^32)."""
    return F.conv(F.substring(draw_digest(seed, salt, *key), 1, 8), 16, 10).cast("long")


def draw_u60(seed: int, salt: str, *key) -> Column:
    """Integer in [0, 2^60), for pools that may have more than 2^32 rows."""
    return F.conv(F.substring(draw_digest(seed, salt, *key), 1, 15), 16, 10).cast("long")


def int_div(a, b) -> Column:
    """Exact integer quotient of non-negative longs."""
    as_long = lambda x: (x if isinstance(x, Column) else F.lit(int(x))).cast("long")
    return F.call_function("div", as_long(a), as_long(b))


def draw_unit(seed: int, salt: str, *key) -> Column:
    """Double in [0, 1)."""
    return draw_u32(seed, salt, *key) / F.lit(4294967296.0)


def draw_below(n, seed: int, salt: str, *key) -> Column:
    """Integer in [0, n)."""
    n = n if isinstance(n, Column) else F.lit(int(n))
    return F.pmod(draw_u32(seed, salt, *key), n.cast("long"))


def draw_between(lo: float, hi: float, seed: int, salt: str, *key) -> Column:
    """Double in [lo, hi)."""
    return F.lit(float(lo)) + draw_unit(seed, salt, *key) * F.lit(float(hi) - float(lo))


def draw_int_between(lo: int, hi: int, seed: int, salt: str, *key) -> Column:
    """Integer in [lo, hi], both ends included."""
    return F.lit(int(lo)) + draw_below(int(hi) - int(lo) + 1, seed, salt, *key)


def py_u32(seed: int, salt: str, *key) -> int:
    """Driver-side twin of :func:`draw_u32`, for pools that are Python lists."""
    text = "|".join([str(seed), salt, *[str(k) for k in key]])
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def base_order(n: int, seed: int, salt: str) -> list[int]:
    """Seeded base permutation of a small literal pool."""
    return sorted(range(n), key=lambda i: (py_u32(seed, salt, "base", i), i))


def _mirrored(x: Column, key: Column, n, swapped) -> Column:
    """One round: a position and its mirror image at ``key`` change places if their common draw says so."""
    return let(F.pmod(key - x, n), lambda y: F.when(swapped(F.greatest(x, y)), y).otherwise(x))


def small_cycle_position(slot: Column, cycle: Column, n: int, seed: int, salt: str) -> Column:
    """Position in ``base_order`` that a cycle puts at ``slot`` (pool is a literal list).

    Each cycle is a permutation of its own (so it uses every item exactly once) and costs one MD5: the swap-or-not
    shuffle, whose rounds swap pairs of positions by drawn bits. A slot's position needs no other slot's.
    """
    if n > LITERAL_POOL:
        raise ValueError(f"a literal pool has at most {LITERAL_POOL} entries")
    size = F.lit(n).cast("long")

    def turn(digest: Column) -> Column:
        def step(x: Column, at: Column) -> Column:
            drawn = F.conv(F.substring(digest, at, F.lit(8)), 16, 10).cast("long")
            return let(drawn, lambda u: _mirrored(
                x, F.pmod(u, size), size,
                lambda top: F.call_function("shiftright", int_div(u, n), top.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1))

        return F.aggregate(F.array(*[F.lit(8 * r + 1) for r in range(SWAP_ROUNDS)]), slot.cast("long"), step)

    return let(draw_digest(seed, salt, "cycle", cycle), turn).cast("int")


def small_cycle_positions(numbers: Column, n: int, seed: int, salt: str) -> Column:
    """:func:`small_cycle_position` for an array of draw numbers cycle * n + slot at once (null stays null).

    The swaps run on whole batches, and a cycle's MD5 is taken once a batch: many draws a row cost little.
    """
    if n > LITERAL_POOL:
        raise ValueError(f"a literal pool has at most {LITERAL_POOL} entries")

    @F.arrow_udf("array<int>")
    def positions(lists: pa.Array) -> pa.Array:
        drawn = lists.flatten()
        cycle, x = np.divmod(pc.fill_null(drawn, 0).to_numpy(zero_copy_only=False), n)
        cycles, of = np.unique(cycle, return_inverse=True)
        digests = b"".join(hashlib.md5(f"{seed}|{salt}|cycle|{c}".encode()).digest() for c in cycles.tolist())
        words = np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)
        for r in range(SWAP_ROUNDS):
            u = words[of, r]
            y = (u % n - x) % n
            x = np.where((u // n) >> np.maximum(x, y) & 1 == 1, y, x)
        values = pa.array(x.astype(np.int32), mask=drawn.is_null().to_numpy(zero_copy_only=False))
        offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)

    return positions(numbers)


# ------------------------------------------------------------------ permutations
#
# Position x of a pool of n entries is written as two digits, x = right * a + left with left < a and right < b, where
# a * b is the smallest product at or above n that the rule below finds. Every round adds a keyed function of one digit
# to the other (a Feistel network), which permutes the a * b numbers; a number that leaves the pool is mapped on until
# it is inside again (at most a * b - n times). All steps are long arithmetic in chained projections.

class Cycle(NamedTuple):
    """Place ``slot`` of the ``cycle``-th permutation of ``n`` entries.

    ``base`` names the family of permutations (below PRIME); ``digits`` are (a, b), ``spare`` is a * b - n or a bound of it.
    """

    slot: Column
    cycle: Column
    n: int | Column
    base: int | Column
    digits: tuple
    spare: int | None


def digits_of(n: int) -> tuple[int, int]:
    """(a, b) with the smallest product at or above ``n``; a lies between a third of its root (1,000 below it at most) and its root."""
    root = isqrt(n)
    least = max(2 if n > 2 else 1, root // 3, root - 1000)
    return min(((a, -(-n // a)) for a in range(least, max(least, root) + 1)), key=lambda d: (d[0] * d[1], -d[0]))


def cycle_base(seed: int, salt: str) -> int:
    return py_u32(seed, salt, "cycle") % PRIME


def cycle_draw(draw_no: Column, n: int | Column, seed: int, salt: str, *key) -> Cycle:
    """The k-th draw of a cyclic sampler: every entry once per cycle, each cycle in an order of its own.

    A literal ``n`` has literal digits; a column may hold up to 2^60. ``key`` columns give each group its own orders.
    """
    size = n if isinstance(n, Column) else F.lit(int(n))
    return cycle_slot(F.pmod(draw_no.cast("long"), size.cast("long")), int_div(draw_no, size), n, seed, salt, *key)


def cycle_slot(slot: Column, cycle: Column, n: int | Column, seed: int, salt: str, *key) -> Cycle:
    base = F.pmod(draw_u32(seed, salt, "cycle", *key), F.lit(PRIME)) if key else cycle_base(seed, salt)
    if isinstance(n, Column):
        n = n.cast("long")
        a = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double")))).cast("long")
        return Cycle(slot, cycle, n, base, (a, int_div(n + a - 1, a)), None)
    a, b = digits_of(n)
    return Cycle(slot, cycle, n, base, (a, b), a * b - n)


def _squared(x: str, multiplier: int, add: str) -> str:
    w = f"(({x} * {multiplier}L + {add}) % {PRIME}L)"
    return f"({w} * {w} % {PRIME}L)"


def with_positions(df: DataFrame, draws: dict[str, Cycle]) -> DataFrame:
    """``df`` and, per entry of ``draws``, a long column: the pool position that the draw's permutation has at its slot.

    Null where slot, cycle or ``n`` is null. All draws advance together, one projection a round, so many draws cost no
    more passes than one.
    """
    own = [f"`{c}`" for c in df.columns]
    held: list[str] = []  # what stays a column through the rounds
    text: dict[str, dict[str, str]] = {}  # per draw: its parts as SQL, literals where they are literal
    start = []
    for i, (name, d) in enumerate(draws.items()):
        q = text[name] = {p: f"__draw{i}{p}" for p in "xkhlr"}
        start += [d.slot.cast("long").alias(q["x"]), F.pmod(d.cycle.cast("long"), F.lit(PRIME)).alias(q["k"]), int_div(d.cycle, PRIME).alias(q["h"])]
        for p, value in (("n", d.n), ("s", d.base), ("a", d.digits[0]), ("b", d.digits[1])):
            q[p] = f"__draw{i}{p}" if isinstance(value, Column) else f"{value}L"
            if isinstance(value, Column):
                start.append(value.cast("long").alias(q[p]))
                held += [q[p]] if p != "s" else []
    q = text
    step = df.select(*[F.col(c) for c in own], *start)
    step = step.selectExpr(*own, *held, *[e for n in draws for e in (
        q[n]["x"], f"{_squared(q[n]['k'], MULTIPLIERS[6], q[n]['s'])} as {q[n]['k']}", f"{q[n]['h']} % {PRIME}L as {q[n]['h']}")])
    step = step.selectExpr(*own, *held, *[e for n in draws for e in (
        q[n]["x"], f"{_squared(q[n]['k'], MULTIPLIERS[7], q[n]['h'])} as {q[n]['k']}")])

    def mapped(step: DataFrame, moving: list[str], also: list[str]) -> DataFrame:
        """One application of the network to the numbers of ``moving``."""
        rest = [*own, *held, *also, *[c for n in draws for c in (q[n]["k"], *([] if n in moving else [q[n]["x"]]))]]
        step = step.selectExpr(*rest, *[e for n in moving for e in (
            f"{q[n]['x']} % {q[n]['a']} as {q[n]['l']}", f"{q[n]['x']} div {q[n]['a']} as {q[n]['r']}")])
        for r in range(ROUNDS):
            to, by, digit = ("l", "r", "a") if r % 2 == 0 else ("r", "l", "b")
            add = lambda n: f"({q[n]['k']} * {MULTIPLIERS[(r + 1) % ROUNDS]}L % {PRIME}L + {r})"  # noqa: E731, B023
            step = step.selectExpr(*rest, *[e for n in moving for e in (
                f"({q[n][to]} + {_squared(q[n][by], MULTIPLIERS[r], add(n))}) % {q[n][digit]} as {q[n][to]}", q[n][by])])
        return step.selectExpr(*rest, *[f"{q[n]['l']} * {q[n]['b']} + {q[n]['r']} as {q[n]['x']}" for n in moving])

    step = mapped(step, list(draws), [])
    if once := [n for n, d in draws.items() if d.spare]:  # literal pools: one more application in projections
        kept = {n: q[n]["x"] + "0" for n in once}
        aside = step.selectExpr("*", *[f"if({q[n]['x']} < {q[n]['n']}, {q[n]['x']}, null) as {c}" for n, c in kept.items()])
        step = mapped(aside, once, list(kept.values()))
        step = step.selectExpr(*own, *held, *[e for n in draws for e in (
            q[n]["k"], f"coalesce({kept[n]}, {q[n]['x']}) as {q[n]['x']}" if n in kept else q[n]["x"])])
    last = []
    for name, d in draws.items():
        x = F.col(q[name]["x"])
        if d.spare is None or d.spare > 1:
            n, a, b = (F.expr(q[name][p]) for p in "nab")
            x = _walked(x, n, F.col(q[name]["k"]), (a, b))
        # Always true, but not foldable: filters on the position stay above the projections. Pushed down, they would
        # be rewritten in terms of the slot, and the rewritten condition doubles with every round.
        last.append(F.when(F.spark_partition_id() >= 0, x).alias(name))
    return step.select(*[F.col(c) for c in own], *last)


def _walked(x: Column, n: Column, key: Column, digits: tuple[Column, Column]) -> Column:
    """``x`` if it is inside the pool, else the first number inside that further applications reach."""
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), digits[0] * digits[1] - n))
    inside = F.aggregate(steps, x, lambda at, _: F.when(at < n, at).otherwise(_applied(at, key, digits)))
    return F.when(x < n, x).otherwise(inside)


def _applied(x: Column, key: Column, digits: tuple[Column, Column]) -> Column:
    """The network on one number in a single expression, for the few rows that are still outside."""
    factors = F.array(*[F.lit(m).cast("long") for m in MULTIPLIERS[:ROUNDS]])

    def turn(at: Column, r: Column) -> Column:
        even, left, right = r % 2 == 0, at["l"], at["r"]
        add = key * F.element_at(factors, (r + 1) % ROUNDS + 1) % PRIME + r
        w = (F.when(even, right).otherwise(left) * F.element_at(factors, r + 1) + add) % PRIME
        return F.struct(F.when(even, (left + w * w % PRIME) % digits[0]).otherwise(left).alias("l"),
                        F.when(even, right).otherwise((right + w * w % PRIME) % digits[1]).alias("r"))

    start = F.struct((x % digits[0]).alias("l"), int_div(x, digits[0]).alias("r"))
    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), start, turn, lambda at: at["l"] * digits[1] + at["r"])
