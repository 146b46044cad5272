"""A reward model learned from preference pairs, and its scorer.

The model is linear in the shares of hashed words of a text. It is fitted as a
Bradley-Terry model: the chosen text of a pair should score above the rejected one, so the
log-odds of a pair is the difference of its scores. Every step of the fit is one pass over the
pairs in Spark; tasks add up their gradients, and ``size`` numbers a task come back, whatever
the number of pairs. The scorer is an iterator UDF: the weights are loaded once for each Python
worker, and texts are scored in groups of about one length, so that little of a group's
rectangle is padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardlens.functions.common import as_col
from rewardlens.operators.tokens import word_array
from rewardlens.plans.ordinal import written
from rewardlens.session import ship_package

SIZE = 1 << 12
#: Texts that are scored as one rectangle.
GROUP = 64


class RewardModel(NamedTuple):
    weights: np.ndarray
    #: mean loss of the pairs before each step
    losses: list[float]


def buckets(text, size: int = SIZE) -> Column:
    """The hashed words of a text, as numbers below ``size``."""
    return F.transform(word_array(text), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))


def _sparse(rows: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, share) of each row's buckets."""
    offsets = rows.offsets.to_numpy()
    n = np.diff(offsets)
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(n)), n), flat, 1.0 / np.repeat(np.maximum(n, 1), n)


def fit_reward_model(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", size: int = SIZE, steps: int = 30,
                     rate: float = 4.0, decay: float = 1e-3) -> RewardModel:
    """Weights that order the pairs, by ``steps`` full gradient steps with momentum.

    Pairs with a null text teach nothing; without pairs all weights are 0. The words are
    hashed once into a written table.
    """
    spark = pairs.sparkSession
    ship_package(spark)
    rows = written(pairs.filter(F.col(chosen).isNotNull() & F.col(rejected).isNotNull()).select(buckets(chosen, size).alias("c"), buckets(rejected, size).alias("r")), "reward-pairs")
    w, velocity, losses = np.zeros(size), np.zeros(size), []

    def gradients(weights):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = weights.value
            total, loss, n = np.zeros(size), 0.0, 0
            for b in batches:
                parts = [(sign, *_sparse(b.column(c), size)) for c, sign in (("c", 1.0), ("r", -1.0))]
                margin = sum(sign * np.bincount(row, share * w[at], b.num_rows) for sign, row, at, share in parts)
                pull = 1.0 / (1.0 + np.exp(np.clip(margin, -500, 500)))  # how much a pair still asks for
                for sign, row, at, share in parts:
                    total += sign * np.bincount(at, share * pull[row], size)
                loss += float(np.logaddexp(0.0, -margin).sum())
                n += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([loss]), pa.array([n])], ["gradient", "loss", "n"])

        return task

    for _ in range(steps):
        sent = spark.sparkContext.broadcast(w)
        found = rows.mapInArrow(gradients(sent), "gradient array<double>, loss double, n long").toArrow()  # one row a task
        n = sum(found.column("n").to_pylist())
        if not n:
            break
        losses.append(sum(found.column("loss").to_pylist()) / n)
        gradient = np.sum([np.asarray(g) for g in found.column("gradient").to_pylist()], axis=0) / n - decay * w
        velocity = 0.9 * velocity + rate * gradient
        w = w + velocity
        sent.destroy()
    return RewardModel(w, losses)


def _grouped_scores(rows: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Mean weight of each row's buckets, in rectangles of rows of about one length; 0 for an empty row."""
    size = np.array([len(r) for r in rows])
    out = np.zeros(len(rows))
    padded = np.r_[weights, 0.0]
    order = np.argsort(size, kind="stable")
    for at in (order[i:i + GROUP] for i in range(0, len(order), GROUP)):
        width = int(size[at[-1]])
        if not width:
            continue
        grid = np.full((len(at), width), len(weights))
        for k, i in enumerate(at):
            grid[k, :size[i]] = rows[i]
        out[at] = padded[grid].sum(1) / np.maximum(size[at], 1)
    return out


def reward_scorer(spark: SparkSession, model: RewardModel):
    """``score(text) -> Column``: the model's score of a text; null for a null text, 0 for one without words."""
    ship_package(spark)
    shared, size = spark.sparkContext.broadcast(model.weights), len(model.weights)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = shared.value  # once for all batches of the task
        for rows in batches:
            there = rows.notna()
            values = _grouped_scores([np.asarray(r, np.int64) for r in rows[there]], weights)
            yield pd.Series(values, index=rows.index[there]).reindex(rows.index)

    def of(text) -> Column:
        return score(F.when(as_col(text).isNotNull(), buckets(text, size)))

    return of
