"""Plug-in scorers and row functions (the reference's reward-function slots).

A reward function is either a Column expression (stays JVM-side, preferred)
or a pandas UDF over Arrow batches. Model-backed scorers use the iterator
form, so the model is loaded once per Python worker, not once per batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardlens.functions.batches import cuts
from rewardlens.operators.rewards import weighted_reward, weights_check
from rewardlens.session import ship_package

WS = re.compile(r"[ \t\n\x0b\f\r]+")
#: Texts are split a slice of so many characters at a time; the words of a whole batch would take many times its size.
SLICE_CHARS = 1 << 20

RewardFn = Column | Callable[..., Column]


def apply_rewards(df: DataFrame, funcs: dict[str, RewardFn], weights: Sequence[float] | None = None, prompt: str = "prompt",
                  completion: str = "completion", out: str = "reward") -> DataFrame:
    """Add ``reward_<name>`` per function and their weighted sum.

    Callables are called as ``fn(prompt, completion, **columns)`` with Columns:
    every other column comes under its own name, so a function names the ones it
    reads and takes the rest as ``**_``.
    """
    weights_check(list(funcs), weights)
    extra = {c: F.col(c) for c in df.columns if c not in (prompt, completion)}
    cols = {}
    for name, fn in funcs.items():
        cols[f"reward_{name}"] = fn if isinstance(fn, Column) else fn(F.col(prompt), F.col(completion), **extra)
    res = df.withColumns(cols)
    return weighted_reward(res, list(cols), weights, out)


@F.pandas_udf(T.DoubleType())
def length_reward(completions: pd.Series) -> pd.Series:
    """Example reward function: completion length in hundreds of characters."""
    return completions.str.len().astype("float64") / 100.0


class LexicalDiversityScorer:
    """Stand-in for a model: share of distinct whitespace tokens. Loaded once per worker."""

    def __init__(self):
        self.split = WS.split

    def score(self, texts: pd.Series) -> pd.Series:
        if not len(texts):
            return self._shares(texts)
        at = cuts(texts.fillna("").str.len().to_numpy().cumsum(), SLICE_CHARS)
        return pd.concat([self._shares(texts.iloc[a:b]) for a, b in zip(at, at[1:])])

    def _shares(self, texts: pd.Series) -> pd.Series:
        tokens = texts.fillna("").str.strip(" \t\n\x0b\f\r").str.split(WS, regex=True).explode()
        tokens = tokens[tokens.notna() & (tokens != "")]
        by = tokens.groupby(level=0)
        return (by.nunique() / by.size()).reindex(texts.index).astype("float64")


def model_scorer(factory: Callable[[], object] = LexicalDiversityScorer):
    """Iterator pandas UDF: ``factory()`` runs once per Python worker, then scores every batch."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for b in batches:
            yield model.score(b)

    return score


def formatting_udf(template: str, fields: Sequence[str]):
    """Per-row formatting function as a pandas UDF (``template.format(**row)``)."""

    @F.pandas_udf(T.StringType())
    def fmt(*cols: pd.Series) -> pd.Series:
        return pd.Series([template.format(**dict(zip(fields, row))) for row in zip(*cols)], index=cols[0].index)

    return fmt


def map_batched(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """``Dataset.map(fn, batched=True)``: ``fn`` over pandas batches of each partition."""

    ship_package(df.sparkSession)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def unpair_batch(pdf: pd.DataFrame) -> pd.DataFrame:
    """Batched unpairing: all chosen rows of the batch, then all rejected."""
    keep = [c for c in pdf.columns if c not in ("chosen", "rejected")]
    a = pdf[keep].assign(completion=pdf["chosen"], label=True)
    b = pdf[keep].assign(completion=pdf["rejected"], label=False)
    return pd.concat([a, b], ignore_index=True)
