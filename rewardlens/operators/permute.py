"""Seeded permutations of dense ordinals by arithmetic.

A Feistel network over pairs (l, r) with ``l < a``, ``r < b``: in turn ``l`` takes on a
digest of ``r`` modulo ``a``, and ``r`` one of ``l`` modulo ``b``. Each step can be undone, so
the numbers ``l + a r`` below ``a b`` are permuted. ``a`` and ``b`` are near the square root of
``n`` with ``a b`` just over it; a number that lands on ``n`` or above walks on along its cycle
until it is below, at most ``a b - n`` further times, since a cycle has no more
such places. So a row's place in the shuffled order follows from its ordinal, the
count and the seed alone: nothing is sorted, exchanged or written.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardlens.functions.common import as_col
from rewardlens.operators.sample import draw, emit_repeats
from rewardlens.plans.ordinal import running

#: Pairs of steps. Four make the order of neighbours unrelated.
ROUNDS = 4
#: Values tried for ``a``, from the square root of ``n`` on.
TRIED = 1 << 20


class Domain(NamedTuple):
    """``n`` numbers inside an ``a`` x ``b`` rectangle."""

    n: int
    a: int
    b: int

    @property
    def excess(self) -> int:
        return self.a * self.b - self.n


def domain(n: int) -> Domain:
    """The rectangle of least excess whose side ``a`` is from ``sqrt(n)`` to twice that (of ``TRIED`` values at most)."""
    if n < 0:
        raise ValueError("a count is not negative")
    side = math.isqrt(max(n - 1, 0)) + 1
    a = np.arange(side, min(side + TRIED, 2 * side) + 1, dtype=np.int64)
    best = int(a[np.argmin(-n % a)])
    return Domain(n, best, -(-n // best) if n else 1)


def _div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by).cast("long"))


def _network(x: Column, d: Domain, seed: int, back: bool) -> Column:
    """One pass of the network over ``x`` below ``a b``, or of its inverse."""
    a, b = F.lit(d.a).cast("long"), F.lit(d.b).cast("long")
    steps = F.sequence(*map(F.lit, (2 * ROUNDS, 1, -1) if back else (1, 2 * ROUNDS, 1)))

    def mixed(to: Column, j: Column, by: Column, size: Column) -> Column:
        r = draw(F.concat(j.cast("string"), F.lit(":"), by.cast("string")), seed) % size
        return (to - r + size) % size if back else (to + r) % size

    def step(s: Column, j: Column) -> Column:
        odd = j % 2 == 1
        return F.struct(F.when(odd, mixed(s["l"], j, s["r"], a)).otherwise(s["l"]).alias("l"),
                        F.when(odd, s["r"]).otherwise(mixed(s["r"], j, s["l"], b)).alias("r"))

    start = F.struct((x % a).alias("l"), _div(x, d.a).alias("r"))
    return F.aggregate(steps, start, step, lambda s: s["l"] + s["r"] * a)


def permuted(ordinal, d: Domain, seed: int = 0, back: bool = False) -> Column:
    """The place (0 .. n - 1) of an ordinal in the seeded order; with ``back`` the ordinal at a place.

    An ordinal outside 0 .. n - 1 is an error, a null one stays null.
    """
    x = as_col(ordinal).cast("long")
    n = F.lit(d.n).cast("long")
    walk = F.sequence(F.lit(0), F.lit(d.excess))
    inside = F.when((x < 0) | (x >= n), F.raise_error(F.lit(f"an ordinal is outside 0 .. {d.n - 1}")).cast("long")).otherwise(x)
    return F.aggregate(walk, inside, lambda y, k: F.when((k > 0) & (y < n), y).otherwise(_network(y, d, seed, back)))


def shuffle_rows(df: DataFrame, key: str, seed: int = 0, out: str = "ordinal") -> DataFrame:
    """Dense place of every row in a seeded order: the rank of its (unique) key, permuted."""
    n = df.count()
    ranked = running(df, [key], out=out, rows=n)
    return ranked.withColumn(out, permuted(out, domain(n), seed))


def repeat_sampler(df: DataFrame, key: str, mini_repeat_count: int, batch_size: int = 1, repeat_count: int = 1, seed: int = 0) -> DataFrame:
    """``(position, key)`` of the repeat sampler over the permuted rows; see :func:`rewardlens.operators.sample.repeat_sampler`."""
    n = df.count()
    ranked = running(df.select(key), [key], out="_ord", rows=n).withColumn("_ord", permuted("_ord", domain(n), seed))
    return emit_repeats(ranked.withColumn("_n", F.lit(n).cast("long")), key, mini_repeat_count, batch_size, repeat_count)


def sampler_index(spark: SparkSession, n: int, mini_repeat_count: int, batch_size: int = 1, repeat_count: int = 1, seed: int = 0) -> DataFrame:
    """``(position, index)``: the sampler's output itself, for ``n`` rows that need not be there.

    Each place of the shuffled order finds its index by the inverse permutation once
    and is then repeated at all its positions, in one narrow pass.
    """
    place, block = F.col("id"), mini_repeat_count * batch_size
    repeats = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(mini_repeat_count * repeat_count - 1).cast("long")))
    found = spark.range(n // batch_size * batch_size).select(place, permuted(place, domain(n), seed, back=True).alias("index"))
    first = _div(place, batch_size) * (block * repeat_count) + place % batch_size * mini_repeat_count
    again = _div(F.col("_k"), mini_repeat_count) * block + F.col("_k") % mini_repeat_count
    if mini_repeat_count * repeat_count < 1:
        return found.filter(F.lit(False)).select(place.alias("position"), "index")
    return found.select(place, "index", repeats.alias("_k")).select((first + again).alias("position"), "index")


def expand_generations(df: DataFrame, prompt: str, num_generations: int, seed: int = 0) -> DataFrame:
    """Distinct prompts in a seeded order, each with ``num_generations`` slots: ``(prompt_rank, prompt, generation)``."""
    distinct = df.select(prompt).distinct()
    ranked = running(distinct, [prompt], out="prompt_rank")
    ranked = ranked.withColumn("prompt_rank", permuted("prompt_rank", domain(distinct.count()), seed))
    return ranked.select("prompt_rank", prompt, F.explode(F.sequence(F.lit(0), F.lit(num_generations - 1))).alias("generation"))
