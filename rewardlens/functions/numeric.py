"""Numeric array expressions over logits (``ARRAY<FLOAT|DOUBLE>``)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardlens.functions.common import as_col, lit_or_col

# floor(log(dtype max) * 1e4) / 1e4 for float32 and float64.
EXP_CAP_FLOAT = 88.7228
EXP_CAP_DOUBLE = 709.7827


def exp_cap(dtype: str = "float", decimal: int = 4) -> float:
    """Largest safe exponent for ``dtype``, floored to ``decimal`` places."""
    mx = 3.4028234663852886e38 if dtype == "float" else 1.7976931348623157e308
    v = math.log(mx)
    return math.floor(v * 10**decimal) / 10**decimal if decimal > 0 else v


def cap_exp(x, cap: float = -1, dtype: str = "float") -> Column:
    """``exp(min(x, cap))``; the cap defaults to the dtype's safe exponent."""
    c = exp_cap(dtype) if cap < 0 else cap
    return F.exp(F.least(as_col(x).cast("double"), F.lit(c)))


def logsumexp(arr) -> Column:
    """Log-sum-exp of a numeric array in one pass (running max + rescaled sum).

    Each element is visited once; no outer expression is re-evaluated inside
    the lambda (Spark does not hoist those out of a lambda body).
    """
    init = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s"))

    def step(st, x):
        v = x.cast("double")
        up = v > st["m"]
        return F.struct(
            F.when(up, v).otherwise(st["m"]).alias("m"),
            F.when(up, st["s"] * F.exp(st["m"] - v) + F.lit(1.0))
            .when(v == F.lit(float("-inf")), st["s"])  # adds nothing; the difference would be NaN
            .otherwise(st["s"] + F.exp(v - st["m"])).alias("s"),
        )

    return F.aggregate(as_col(arr), init, step, lambda st: F.when(st["s"] > 0, st["m"] + F.log(st["s"])).otherwise(st["m"]))


def selective_log_softmax(logits, index) -> Column:
    """``log_softmax(logits)[index]`` without materialising the softmax (0-based index)."""
    a = as_col(logits)
    return F.get(a, lit_or_col(index)).cast("double") - logsumexp(a)


def mixture(model_logits, ref_logits, mixture_coef: float = 0.5) -> Column:
    """``c * ref + (1 - c) * model`` element-wise, as doubles."""
    return F.zip_with(
        as_col(model_logits), as_col(ref_logits),
        lambda m, r: F.lit(mixture_coef) * r.cast("double") + F.lit(1.0 - mixture_coef) * m.cast("double"),
    )


def log_softmax(df: DataFrame, col: str, out: str) -> DataFrame:
    """``out = log_softmax(col)``; the normaliser is its own column, computed once per row."""
    return (df.withColumn("_lse", logsumexp(col))
              .withColumn(out, F.transform(col, lambda x: x.cast("double") - F.col("_lse")))
              .drop("_lse"))


def logit_mixture(df: DataFrame, model_col: str, ref_col: str, out: str = "logps", mixture_coef: float = 0.5) -> DataFrame:
    """``out = log_softmax(c * ref + (1 - c) * model)`` (staged: mix, normaliser, subtract)."""
    staged = df.withColumn("_mix", mixture(model_col, ref_col, mixture_coef))
    return log_softmax(staged, "_mix", out).drop("_mix")


def argmax(arr) -> Column:
    """0-based index of the largest element, first on ties."""
    a = as_col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")
