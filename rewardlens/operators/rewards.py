"""Reward analytics: weighted rewards, group statistics, advantages, loss terms.

Inputs are long tables with explicit keys (the reference aligns tensors by
position; Spark has no row order):

* rollouts: ``group_id, <sample keys>, reward_<func> ...``
* token log-probs: ``sample_id, pos, logp, old_logp, ref_logp, mask, advantage``
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardlens.functions.chat import name_tail
from rewardlens.plans.spread import spread

# Fixed values from the reference's defaults.
ADVANTAGE_EPS = 1e-4
DEFAULT_BETA = 0.04
DEFAULT_EPSILON = 0.2
DEFAULT_NUM_GENERATIONS = 4


def weights_check(reward_cols: Sequence[str], weights: Sequence[float] | None) -> list[float]:
    """Weights must match the reward functions one to one; default all 1.0."""
    if weights is None:
        return [1.0] * len(reward_cols)
    if len(weights) != len(reward_cols):
        raise ValueError(f"{len(weights)} weights for {len(reward_cols)} reward columns")
    return [float(w) for w in weights]


def uneven_batches(df: DataFrame, batch_col: str, num_generations: int = DEFAULT_NUM_GENERATIONS) -> DataFrame:
    """``(batch, rows, left_over)``: batches that do not hold whole groups of ``num_generations`` rows."""
    if num_generations < 2:
        raise ValueError("num_generations must be at least 2")
    rows = df.groupBy(batch_col).agg(F.count(F.lit(1)).alias("rows"))
    return rows.withColumn("left_over", F.col("rows") % num_generations).filter("left_over > 0")


def weighted_reward(df: DataFrame, reward_cols: Sequence[str], weights: Sequence[float] | None = None, out: str = "reward") -> DataFrame:
    """``out = sum_i w_i * reward_i`` per sample (one projection, no shuffle)."""
    w = weights_check(reward_cols, weights)
    expr = None
    for c, wi in zip(reward_cols, w):
        term = F.col(c).cast("double") * F.lit(wi)
        expr = term if expr is None else expr + term
    return df.withColumn(out, expr)


def weighted_reward_long(df: DataFrame, sample_cols: Sequence[str], weights: dict[str, float], func_col: str = "func", reward_col: str = "reward", out: str = "reward") -> DataFrame:
    """Long form ``(sample, func, reward)`` -> ``(sample, out)``; weights are a literal map."""
    wmap = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    return df.groupBy(*sample_cols).agg(F.sum(F.col(reward_col).cast("double") * F.element_at(wmap, F.col(func_col))).alias(out))


def group_reward_stats(df: DataFrame, group_col: str = "group_id", reward_col: str = "reward") -> DataFrame:
    """Per group: size, mean and unbiased std of the reward."""
    return df.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("group_size"),
        F.avg(reward_col).alias("mean_reward"),
        F.stddev_samp(reward_col).alias("std_reward"),
    )


def group_advantage(df: DataFrame, group_col: str = "group_id", reward_col: str = "reward", eps: float = ADVANTAGE_EPS, out: str = "advantage", keep_stats: bool = False) -> DataFrame:
    """``(r - mean_g) / (std_g + eps)`` per sample; std is unbiased (NULL for one-row groups)."""
    res = spread(df, [group_col], [F.avg(reward_col).alias("_mean"), F.stddev_samp(reward_col).alias("_std")])
    res = res.withColumn(out, (F.col(reward_col) - F.col("_mean")) / (F.col("_std") + F.lit(eps)))
    if keep_stats:
        return res.withColumnRenamed("_mean", "mean_reward").withColumnRenamed("_std", "std_reward")
    return res.drop("_mean", "_std")


def group_size_check(df: DataFrame, group_col: str = "group_id", num_generations: int = DEFAULT_NUM_GENERATIONS, strict: bool = False) -> DataFrame:
    """Groups whose size differs from ``num_generations``.

    ``strict=True`` turns any such group into a task failure (``raise_error``)
    instead of returning it.
    """
    if num_generations < 2:
        raise ValueError("num_generations must be at least 2")
    sizes = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("group_size"))
    bad = sizes.filter(F.col("group_size") != F.lit(num_generations))
    if strict:
        bad = bad.withColumn(
            "group_size",
            F.raise_error(F.concat(F.lit("group size != num_generations for group "), F.col(group_col).cast("string"))),
        )
    return bad


def reward_func_means(df: DataFrame, reward_cols: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """``rewards/<name>`` -> mean reward of each function (one pass, then unpivot)."""
    names = list(names or reward_cols)
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(reward_cols)])
    stacked = row.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(f"m{i}").alias("value")) for i, n in enumerate(names)
    ])).alias("s"))
    return stacked.select(F.concat(F.lit("rewards/"), name_tail(F.col("s.name"))).alias("key"), F.col("s.value").alias("value"))


def rollout_metrics(df_with_adv: DataFrame, reward_col: str = "reward", std_col: str = "std_reward", length_col: str | None = "completion_length") -> DataFrame:
    """Mean completion length, mean reward, and mean of the per-sample group std."""
    aggs = [F.avg(reward_col).alias("reward"), F.avg(std_col).alias("reward_std")]
    if length_col:
        aggs.insert(0, F.avg(F.col(length_col).cast("double")).alias("completion_length"))
    return df_with_adv.agg(*aggs)


def _token_terms(df: DataFrame, beta: float, epsilon: float, use_old: bool = True) -> DataFrame:
    lp, ref = F.col("logp"), F.col("ref_logp")
    old = F.col("old_logp") if use_old else lp
    coef1 = F.exp(lp - old)
    coef2 = F.least(F.greatest(coef1, F.lit(1 - epsilon)), F.lit(1 + epsilon))
    adv = F.col("advantage")
    l1, l2 = coef1 * adv, coef2 * adv
    out = df.withColumn("_l1", l1).withColumn("_l2", l2)
    loss = -F.least(F.col("_l1"), F.col("_l2"))
    if beta != 0.0:
        kl = F.exp(ref - lp) - (ref - lp) - F.lit(1.0)
        out = out.withColumn("_kl", kl)
        loss = loss + F.lit(beta) * F.col("_kl")
    return out.withColumn("_loss", loss)


def policy_loss(tokens: DataFrame, beta: float = DEFAULT_BETA, epsilon: float = DEFAULT_EPSILON, num_iterations: int = 2) -> DataFrame:
    """Clipped surrogate loss (+ beta * KL) averaged over all masked tokens; one row.

    With ``num_iterations == 1`` the old log-probs equal the current ones and
    ``old_logp`` is not read (the branch is pruned from the plan).
    """
    t = _token_terms(tokens, beta, epsilon, use_old=num_iterations > 1)
    m = F.col("mask").cast("double")
    return t.agg(F.try_divide(F.sum(F.col("_loss") * m), F.sum(m)).alias("loss"))


def kl_estimate(tokens: DataFrame, sample_col: str = "sample_id") -> DataFrame:
    """Mean over sequences of the masked mean per-token KL (k3 estimator); one row."""
    lp, ref = F.col("logp"), F.col("ref_logp")
    kl = F.exp(ref - lp) - (ref - lp) - F.lit(1.0)
    m = F.col("mask").cast("double")
    per_seq = tokens.groupBy(sample_col).agg(F.try_divide(F.sum(kl * m), F.sum(m)).alias("kl"))
    return per_seq.agg(F.avg("kl").alias("kl"))


def clip_ratio(tokens: DataFrame, epsilon: float = DEFAULT_EPSILON, num_iterations: int = 2) -> DataFrame:
    """Share of masked tokens where the unclipped term is below the clipped one; one row."""
    t = _token_terms(tokens, 0.0, epsilon, use_old=num_iterations > 1)
    m = F.col("mask").cast("double")
    return t.agg(F.try_divide(F.sum((F.col("_l1") < F.col("_l2")).cast("double") * m), F.sum(m)).alias("clip_ratio"))


def join_logps(policy: DataFrame, old: DataFrame | None, ref: DataFrame | None, keys: Sequence[str] = ("sample_id", "pos")) -> DataFrame:
    """Line up policy / old / reference per-token log-probs on (sample, pos)."""
    keys = list(keys)
    out = policy
    if old is not None:
        out = out.join(old, on=keys, how="inner")
    if ref is not None:
        out = out.join(ref, on=keys, how="inner")
    return out


def join_group_stats(samples: DataFrame, stats: DataFrame, group_col: str = "group_id") -> DataFrame:
    """Spread a per-group table back to its member samples."""
    return samples.join(stats, on=group_col, how="left")


def join_prompt_completion(prompts: DataFrame, completions: DataFrame, key: str = "sample_id", strict: bool = False) -> DataFrame:
    """Pair prompts with completions on an explicit key; strict fails on unmatched rows."""
    if not strict:
        return prompts.join(completions, on=key, how="inner")
    p = prompts.withColumn("_p", F.lit(True))
    c = completions.withColumn("_c", F.lit(True))
    j = p.join(c, on=key, how="full_outer")
    # the guard is part of the key column, so column pruning cannot remove it
    guarded = F.when(F.col("_p").isNull() | F.col("_c").isNull(),
                     F.raise_error(F.lit("prompts and completions differ in length"))).otherwise(F.col(key))
    return j.withColumn(key, guarded).drop("_p", "_c")


def join_rewards_long(df: DataFrame, sample_cols: Sequence[str], funcs: Sequence[str], func_col: str = "func", reward_col: str = "reward") -> DataFrame:
    """Long ``(sample, func, reward)`` -> one column per function.

    A pivot with fixed values would first group by sample *and* function, which moves
    every long row; here a task makes one wide row of a sample's rows before anything
    moves. Of several rewards of a function the first one counts, null or not.
    """
    aggs = []
    for i, f in enumerate(funcs):
        own, reward = F.col(func_col) == F.lit(f), F.col(reward_col)
        aggs += [F.first(F.when(own, reward.isNull()), ignorenulls=True).alias(f"_none{i}"), F.first(F.when(own, reward), ignorenulls=True).alias(f"_some{i}")]
    wide = df.groupBy(*sample_cols).agg(*aggs)
    return wide.select(*sample_cols, *[F.when(~F.col(f"_none{i}"), F.col(f"_some{i}")).alias(f) for i, f in enumerate(funcs)])


def filter_logging_steps(df: DataFrame, logging_steps: int, step_col: str = "step") -> DataFrame:
    return df.filter(F.col(step_col) % F.lit(logging_steps) == 0)


def milestone_steps(total_steps: int) -> list[int]:
    """Steps at which the reference saves: fractions of the run, plus step 1."""
    # The reference's milestone fractions, in its order.
    fractions = [0.25, 0.4, 0.10, 0.5, 0.75, 1.0]
    return sorted({int(total_steps * f) for f in fractions} | {1})


def filter_milestones(df: DataFrame, total_steps: int, step_col: str = "step") -> DataFrame:
    return df.filter(F.col(step_col).isin(milestone_steps(total_steps)))


def metric_average(log: DataFrame, mode_col: str = "mode", key_col: str = "key", value_col: str = "value", step: str | None = None) -> DataFrame:
    """Mean per (mode, key), and per ``step`` when one is named; keys get an ``eval_`` prefix in eval mode."""
    steps = [step] if step else []
    agg = log.groupBy(mode_col, *steps, key_col).agg(F.avg(F.col(value_col).cast("double")).alias("value"))
    return agg.select(F.col(mode_col).alias("mode"), *steps, metric_key(mode_col, key_col).alias("key"), "value")


def metric_key(mode_col: str, key_col: str) -> Column:
    """The logged name of a metric: with ``eval_`` before it in eval mode."""
    return F.when(F.col(mode_col) == "eval", F.concat(F.lit("eval_"), F.col(key_col))).otherwise(F.col(key_col))


def reward_passthrough_cols(df: DataFrame) -> list[str]:
    """Columns forwarded to reward functions: all but prompt and completion."""
    return [c for c in df.columns if c not in ("prompt", "completion")]
