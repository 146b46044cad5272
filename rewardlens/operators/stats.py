"""Score reporting and running statistics.

Aggregates are one-pass mergeable (``avg``, ``var_pop``, ``stddev_samp``:
partial on the map side, final after the shuffle). Running state over
ordered batches is computed on the reduced per-batch table, never over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardlens.functions.common import as_col
from rewardlens.plans.ordinal import running
from rewardlens.plans.topk import top_k_per_key

# Fixed values from the reference.
HIST_BINS = 50
TRACKER_EPS = 1e-6
MOMENTS_INIT_COUNT = 1e-24
MOMENTS_INIT_VAR = 1.0


def score_averages(df: DataFrame, chosen: str = "chosen_score", rejected: str = "rejected_score", generated: str = "generated_scores") -> DataFrame:
    """Mean chosen, rejected and generated score; generated is a per-row mean first."""
    g = F.aggregate(as_col(generated), F.lit(0.0), lambda a, x: a + x) / F.size(as_col(generated))
    return df.agg(
        F.avg(chosen).alias("average_chosen_score"),
        F.avg(rejected).alias("average_rejected_score"),
        F.avg(g).alias("average_generated_score"),
    )


def reward_gap(df: DataFrame, chosen: str = "chosen_reward", rejected: str = "rejected_reward") -> DataFrame:
    return df.agg(
        F.avg(chosen).alias("avg_chosen_reward"),
        F.avg(rejected).alias("avg_rejected_reward"),
        F.avg(F.col(chosen) - F.col(rejected)).alias("avg_reward_gap"),
    )


def union_scores(df: DataFrame, id_cols: Sequence[str], series: dict[str, Column | str]) -> DataFrame:
    """Wide score columns -> long ``(id..., series, score)`` (one scan, no shuffle)."""
    arr = F.array(*[F.struct(F.lit(k).alias("series"), as_col(v).cast("double").alias("score")) for k, v in series.items()])
    return df.select(*id_cols, F.explode(arr).alias("_s")).select(*id_cols, "_s.series", "_s.score")


def score_range(long: DataFrame, score: str = "score") -> DataFrame:
    return long.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))


def score_histogram(long: DataFrame, series: str = "series", score: str = "score", bins: int = HIST_BINS) -> DataFrame:
    """Counts in ``bins`` equal bins over the min-max shared by all series.

    Bin edges and the edge corrections follow ``numpy.histogram``: the last
    bin is closed, and a value is moved one bin down / up when floating error
    put it on the wrong side of ``linspace`` edges. The range is a one-row
    aggregate joined to every row (a one-row broadcast).
    """
    rng = score_range(long, score).select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("_lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("_hi"),
    )
    x = F.col(score)
    lo, hi = F.col("_lo"), F.col("_hi")
    step = (hi - lo) / F.lit(float(bins))

    def edge(i: Column) -> Column:
        return F.when(i == bins, hi).otherwise(F.lit(0.0) + i.cast("double") * step + lo)

    j = long.join(F.broadcast(rng), how="cross")
    i0 = F.floor((x - lo) * (F.lit(float(bins)) / (hi - lo))).cast("int")
    j = j.withColumn("_i", F.when(i0 >= bins, bins - 1).otherwise(i0))
    j = j.withColumn("_i", F.when(x < edge(F.col("_i")), F.col("_i") - 1).otherwise(F.col("_i")))
    j = j.withColumn("_i", F.when((x >= edge(F.col("_i") + 1)) & (F.col("_i") != bins - 1), F.col("_i") + 1).otherwise(F.col("_i")))
    return j.groupBy(series, F.col("_i").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def pairwise_accuracy(df: DataFrame, s0: str = "score_0", s1: str = "score_1", label: str = "label") -> DataFrame:
    """Share of non-tied pairs whose argmax equals the label; ties are counted, then dropped."""
    tie = F.col(s0) == F.col(s1)
    pred = F.when(F.col(s1) > F.col(s0), 1).otherwise(0)
    return df.agg(
        F.avg(F.when(~tie, (pred == F.col(label)).cast("double"))).alias("accuracy"),
        F.count_if(tie).alias("n_ties"),
    )


def token_accuracy(df: DataFrame, logits: str, labels: str, ignore_index: int = -100) -> DataFrame:
    """Argmax per token against labels, ignoring ``ignore_index``, over all tokens.

    ``logits`` is ``ARRAY<ARRAY<num>>`` (positions x classes), ``labels`` ``ARRAY<INT>``.
    """
    pairs = F.arrays_zip(
        F.transform(logits, lambda v: F.array_position(v, F.array_max(v)) - 1).alias("p"),
        as_col(labels).alias("l"),
    )
    ex = df.select(F.explode(pairs).alias("t")).filter(F.col("t.l") != ignore_index)
    return ex.agg(F.avg((F.col("t.p") == F.col("t.l")).cast("double")).alias("accuracy"))


def batch_moments(df: DataFrame, value: str, batch: str | None = None, mask: str | None = None, compat: bool = False) -> DataFrame:
    """Count, mean and population variance (per batch when ``batch`` is given).

    With ``mask`` the sums use masked values; ``compat=True`` reproduces the
    reference's unmasked sum divided by the mask count.
    """
    keys = [batch] if batch else []
    x = F.col(value).cast("double")
    if mask is None:
        return df.groupBy(*keys).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"))
    m = F.col(mask).cast("double")
    s = df.groupBy(*keys).agg(F.sum(m).alias("count"), F.sum(x if compat else x * m).alias("_sx"))
    s = s.withColumn("mean", F.try_divide("_sx", "count"))
    means = s.select(*[F.col(k).alias(f"_{k}") for k in keys], "mean")
    dev = df.join(means, F.col(keys[0]).eqNullSafe(F.col(f"_{keys[0]}"))) if keys else df.crossJoin(F.broadcast(means))
    d = dev.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum(F.pow(x - F.col("mean"), 2) * m).alias("_ss"))
    out = s.join(d, F.col(keys[0]).eqNullSafe(F.col(f"_{keys[0]}"))) if keys else s.crossJoin(d)
    return out.select(*keys, "count", "mean", F.try_divide("_ss", "count").alias("var"))


def running_moments(df: DataFrame, value: str, batch: str) -> DataFrame:
    """Running mean / variance / unbiased std after each batch, plus each batch's own mean and std.

    Count, mean and variance after a batch are those of all rows so far, plus
    a start state of count 1e-24, mean 0 and variance 1. They come from running
    sums of deviations from one anchor, the mean over all rows, so values that
    are large next to their spread lose no digits. Per-batch aggregates are
    distributed; the running sums run over the reduced batch table.
    """
    per = batch_table(df, value, batch)
    anchor = per.agg(F.coalesce(F.sum(F.col("n") * F.col("bmean")) / F.sum("n"), F.lit(0.0)).alias("anchor"))
    per = per.crossJoin(F.broadcast(anchor))  # one row
    acc = running(per, [batch], value=deviation_sums(), inclusive=True)
    start = F.lit(MOMENTS_INIT_COUNT)
    return acc.select(batch, *merged_moments(
        start, start * (0 - F.col("anchor")), start * (F.lit(MOMENTS_INIT_VAR) + F.col("anchor") * F.col("anchor"))))


def batch_table(df: DataFrame, value: str, batch: str) -> DataFrame:
    """``(batch, n, bmean, bvar)``; batches without a value have n = 0 and null moments."""
    x = F.col(value).cast("double")
    return df.groupBy(batch).agg(F.count(x).cast("double").alias("n"), F.avg(x).alias("bmean"), F.var_pop(x).alias("bvar"))


def deviation_sums() -> dict[str, Column]:
    """Per batch: count, sum and sum of squares of the deviations from ``anchor``."""
    d = F.col("bmean") - F.col("anchor")
    zero = F.lit(0.0)
    return {"cn": F.col("n"), "csd": F.coalesce(F.col("n") * d, zero), "csq": F.coalesce(F.col("n") * (F.col("bvar") + d * d), zero)}


def merged_moments(n0: Column, sd0: Column, sq0: Column) -> list[Column]:
    """Output columns from running ``cn, csd, csq`` around ``anchor`` and what went before (``n0, sd0, sq0``)."""
    cnt = n0 + F.col("cn")
    shift = (sd0 + F.col("csd")) / cnt
    var = (sq0 + F.col("csq")) / cnt - shift * shift
    return [
        F.col("bmean").alias("batch_mean"),
        F.sqrt(F.try_divide(F.col("bvar") * F.col("n"), F.col("n") - 1)).alias("batch_std"),
        (F.col("anchor") + shift).alias("mean"), var.alias("var"),
        F.sqrt(F.try_divide(var * cnt, cnt - 1)).alias("std"),
        cnt.alias("count"),
    ]


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` in which a null key meets the null key; the left side's keys stay."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(r, cond).drop(*[f"_r_{k}" for k in keys])


def _tracker_buffers(df: DataFrame, prompt: str, reward: str, batch: str, order: Sequence[str], k: int, state: DataFrame | None) -> DataFrame:
    """One row per (prompt, batch): the buffer at the end of the batch and the running count.

    ``state`` -- ``(prompt, last ARRAY<DOUBLE>, count)`` carried from earlier
    batches (the streaming form) -- enters as a pseudo batch before all others.
    """
    last = top_k_per_key(df.select(prompt, batch, *order, reward), [prompt, batch], list(order), k, last=True)
    pb = last.groupBy(prompt, batch).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order], F.col(reward).cast("double").alias("_r")))), lambda s: s["_r"]).alias("_last")
    )
    cnt = df.groupBy(prompt, batch).agg(F.count(F.lit(1)).alias("_n"))
    pb = null_safe_join(pb, cnt, [prompt, batch]).withColumn("_bo", F.lit(1))
    if state is not None:
        seed = state.select(prompt, F.lit(None).cast(dict(df.dtypes)[batch]).alias(batch),
                            F.col("last").cast("array<double>").alias("_last"), F.col("count").cast("long").alias("_n"), F.lit(0).alias("_bo"))
        pb = pb.unionByName(seed)
    w = Window.partitionBy(prompt).orderBy("_bo", batch)
    pb = pb.withColumn("_buf", F.flatten(F.collect_list("_last").over(w.rowsBetween(-(k - 1), 0))))
    pb = pb.withColumn("_buf", F.slice("_buf", F.greatest(F.lit(1), F.size("_buf") - k + 1), k))
    pb = pb.withColumn("_cum", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return pb.withColumn("_len", F.least(F.lit(k), F.col("_cum")))


def prompt_tracker(df: DataFrame, prompt: str, reward: str, batch: str, order: Sequence[str], buffer_size: int = 8, min_count: int = 3,
                   eps: float = TRACKER_EPS, state: DataFrame | None = None) -> DataFrame:
    """Per-prompt advantages with a buffer of the last ``buffer_size`` rewards.

    For each (prompt, batch) the buffer is the prompt's last ``buffer_size``
    rewards up to the end of that batch. With fewer than ``min_count`` of them,
    the whole batch's mean / population std are used instead. Work is done on
    a reduced table of one row per (prompt, batch) holding at most
    ``buffer_size`` rewards, so a hot prompt costs its number of batches, not
    its number of rows.
    """
    pb = _tracker_buffers(df, prompt, reward, batch, order, buffer_size, state).filter(F.col("_bo") == 1)
    n = F.size("_buf").cast("double")
    pb = pb.withColumn("_pm", F.aggregate("_buf", F.lit(0.0), lambda a, x: a + x) / n)
    pb = pb.withColumn("_ps", F.sqrt(F.aggregate("_buf", F.lit(0.0), lambda a, x: a + (x - F.col("_pm")) * (x - F.col("_pm"))) / n))
    bstats = df.groupBy(batch).agg(F.avg(F.col(reward).cast("double")).alias("_bm"), F.stddev_pop(F.col(reward).cast("double")).alias("_bs"))
    j = null_safe_join(null_safe_join(df, pb.select(prompt, batch, "_len", "_pm", "_ps"), [prompt, batch]), bstats, [batch])
    return with_advantage(j, reward, min_count, eps)


def with_advantage(j: DataFrame, reward: str, min_count: int, eps: float) -> DataFrame:
    """``advantage`` and ``cold`` from the buffer's ``_len, _pm, _ps`` and the batch's ``_bm, _bs``, which are dropped."""
    cold = F.col("_len") < min_count
    mean = F.when(cold, F.col("_bm")).otherwise(F.col("_pm"))
    std = F.when(cold, F.col("_bs")).otherwise(F.col("_ps")) + F.lit(eps)
    return j.withColumn("advantage", (F.col(reward).cast("double") - mean) / std).withColumn("cold", cold).drop("_len", "_pm", "_ps", "_bm", "_bs")


def tracker_state(df: DataFrame, prompt: str, reward: str, batch: str, order: Sequence[str], buffer_size: int = 8, state: DataFrame | None = None) -> DataFrame:
    """``(prompt, last, count)`` after all batches of ``df`` (and an earlier ``state``)."""
    pb = _tracker_buffers(df, prompt, reward, batch, order, buffer_size, state)
    key = F.struct("_bo", batch)
    return pb.groupBy(prompt).agg(F.max_by("_buf", key).alias("last"), F.max_by("_cum", key).alias("count"))


def prompt_stats(df: DataFrame, prompt: str, reward: str, order: Sequence[str], buffer_size: int = 8) -> DataFrame:
    """Mean, population std and count of each prompt's last ``buffer_size`` rewards."""
    last = top_k_per_key(df, [prompt], list(order), buffer_size, last=True)
    r = F.col(reward).cast("double")
    return last.groupBy(prompt).agg(F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), F.count(r).alias("count"))


def ordered_distinct(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Distinct ``key`` with the order columns of its first occurrence."""
    first = F.min(F.struct(*[F.col(o) for o in order])).alias("_f")
    return df.groupBy(key).agg(first).select(key, *[F.col(f"_f.{o}").alias(o) for o in order])


def distinct_values(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def batch_width(df: DataFrame, arr: str, batch: str) -> DataFrame:
    return df.groupBy(batch).agg(F.max(F.size(arr)).alias("width"))


def join_state(rows: DataFrame, state: DataFrame, key: str = "prompt") -> DataFrame:
    """Look up each row's keyed state (``self.stats[prompt]``): an equi-join to the state table, in which a null key is a key."""
    keyed = state.withColumnRenamed(key, "_state_key")
    return rows.join(keyed, F.col(key).eqNullSafe(F.col("_state_key")), "left").drop("_state_key")
