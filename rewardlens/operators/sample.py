"""Repeatable sampling, shuffling and generation expansion.

Randomness is a digest of seed and key, computed per row: the first 60 bits of
``md5(seed:key)``. Rows are ordered by it, then by the key, so any key type and
size gives a total order, another seed gives an unrelated one, and retries and
re-partitioning give the same (``rand()`` does not). Plain SQL can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardlens.functions.common import as_col
from rewardlens.plans.ordinal import running

DIGEST_BITS = 60


def draw(key, seed: int = 0) -> Column:
    """60 random bits of (seed, key) as a non-negative long."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(as_col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def random_score(key, seed: int = 0) -> Column:
    """Uniform [0, 1) placeholder reward from (seed, key)."""
    return draw(key, seed).cast("double") / F.lit(float(1 << DIGEST_BITS))


def shuffle_rows(df: DataFrame, key: str, seed: int = 0, out: str = "ordinal") -> DataFrame:
    """Dense 0-based position of every row in the seeded order; equal digests go by the key."""
    s = df.withColumn("_draw", draw(key, seed))
    return running(s, ["_draw", key], out=out).drop("_draw")


def repeat_sampler(df: DataFrame, key: str, mini_repeat_count: int, batch_size: int = 1, repeat_count: int = 1, seed: int = 0) -> DataFrame:
    """Emitted ``(position, key)`` of the repeat sampler.

    Permute, cut into chunks of ``batch_size`` distinct rows, drop the
    incomplete chunk, emit each chunk ``repeat_count`` times with every row
    repeated ``mini_repeat_count`` times. The output position is computed,
    so no ordering of the exploded rows is needed.
    """
    o = shuffle_rows(df.select(key), key, seed, "_ord")
    n = o.agg(F.count(F.lit(1)).alias("_n"))  # one row
    return emit_repeats(o.crossJoin(F.broadcast(n)), key, mini_repeat_count, batch_size, repeat_count)


def emit_repeats(o: DataFrame, key: str, mini_repeat_count: int, batch_size: int, repeat_count: int) -> DataFrame:
    """``(position, key)`` of every emission of rows that have their place ``_ord`` in the order and its length ``_n``."""
    B, m, r = batch_size, mini_repeat_count, repeat_count
    chunk = (F.col("_ord") / B).cast("long")
    o = o.filter(chunk < (F.col("_n") / B).cast("long"))
    o = o.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(r - 1))))
    o = o.withColumn("_mini", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    pos = chunk * (r * B * m) + F.col("_rep") * (B * m) + (F.col("_ord") % B) * m + F.col("_mini")
    return o.select(pos.cast("long").alias("position"), key)


def sampler_train(df: DataFrame, key: str, per_device_batch_size: int, num_processes: int, grad_accum: int, num_generations: int, num_iterations: int = 1, seed: int = 0) -> DataFrame:
    effective = per_device_batch_size * num_processes * grad_accum
    return repeat_sampler(df, key, num_generations, effective // num_generations, num_iterations, seed)


def sampler_eval(df: DataFrame, key: str, num_generations: int, seed: int = 0) -> DataFrame:
    return repeat_sampler(df, key, num_generations, 1, 1, seed)


def expand_generations(df: DataFrame, prompt: str, order: list[str], num_generations: int) -> DataFrame:
    """Distinct prompts in first-seen order, each with ``num_generations`` slots.

    First-seen order is a ``min`` per prompt (partial aggregation); the rank
    of prompts is a bucketed running count over the distinct table.
    """
    first = df.groupBy(prompt).agg(F.min(F.struct(*[F.col(o) for o in order])).alias("_f"))
    first = first.select(prompt, *[F.col(f"_f.{o}").alias(o) for o in order])
    ranked = running(first, order, out="prompt_rank")
    return ranked.select("prompt_rank", prompt, F.explode(F.sequence(F.lit(0), F.lit(num_generations - 1))).alias("generation"))


def reuse_source_step(step, num_iterations: int, grad_accum: int) -> Column:
    """Micro-step whose generations step ``step`` reuses (itself on generation steps)."""
    t = as_col(step).cast("long")
    g = (t / grad_accum).cast("long")
    return (g - g % num_iterations) * grad_accum + t % grad_accum


def reuse_schedule(steps: DataFrame, generated: DataFrame, step: str, num_iterations: int, grad_accum: int) -> DataFrame:
    """Join every micro-step to the buffered generations it uses (equi-join on the source step)."""
    s = steps.withColumn("source_step", reuse_source_step(step, num_iterations, grad_accum))
    return s.join(generated, s["source_step"] == generated[step], "inner").drop(generated[step])
