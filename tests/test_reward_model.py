"""The reward model against a plain dense fit; its order on pairs it has not seen; grouped scoring."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rewardlens.operators import reward_model as RM

GOOD, BAD, ANY = ["clear", "right", "kind"], ["rude", "wrong", "spam"], [f"w{i}" for i in range(30)]


def texts(rng, words, n):
    return " ".join(rng.choice(words if rng.random() < 0.3 else ANY) for _ in range(n))


def pairs(n, seed):
    rng = random.Random(seed)
    return [(i, texts(rng, GOOD, rng.randint(4, 40)), texts(rng, BAD, rng.randint(4, 40))) for i in range(n)]


def test_the_fit_is_a_plain_gradient_fit(spark):
    size = 64
    data = pairs(60, 1) + [(60, None, "x"), (61, "", "rude")]
    df = spark.createDataFrame(data, "idx long, chosen string, rejected string").repartition(5)
    model = RM.fit_reward_model(df, size=size, steps=12)
    hashed = df.filter("chosen is not null").select(RM.buckets("chosen", size).alias("c"), RM.buckets("rejected", size).alias("r")).collect()

    def dense(row):
        out = np.zeros(size)
        for b in row:
            out[b] += 1 / len(row)
        return out

    x = np.array([dense(r.c) - dense(r.r) for r in hashed])
    w, v, losses = np.zeros(size), np.zeros(size), []
    for _ in range(12):
        m = x @ w
        losses.append(np.logaddexp(0, -m).mean())
        v = 0.9 * v + 4.0 * ((x * (1 / (1 + np.exp(m)))[:, None]).mean(0) - 1e-3 * w)
        w = w + v
    assert np.allclose(model.weights, w, atol=1e-9) and np.allclose(model.losses, losses) and losses[-1] < losses[0] / 2


def test_unseen_pairs_are_ordered(spark):
    train = spark.createDataFrame(pairs(150, 2), "idx long, chosen string, rejected string")
    test = spark.createDataFrame(pairs(100, 3), "idx long, chosen string, rejected string")
    score = RM.reward_scorer(spark, RM.fit_reward_model(train))
    right = test.filter(score("chosen") > score("rejected")).count()
    assert right >= 95


def test_scores_do_not_depend_on_grouping(spark, monkeypatch):
    rng = random.Random(4)
    model = RM.RewardModel(np.array([rng.random() for _ in range(32)]), [])
    data = [(i, None if i == 3 else "" if i == 4 else texts(rng, GOOD, rng.randint(1, 300))) for i in range(200)]
    df = spark.createDataFrame(data, "k long, text string").repartition(3)
    got = {r.k: r.s for r in df.select("k", RM.reward_scorer(spark, model)("text").alias("s")).collect()}
    hashed = {r.k: r.b for r in df.select("k", RM.buckets("text", 32).alias("b")).collect()}
    assert got[3] is None and got[4] == 0
    for k, b in hashed.items():
        if k not in (3, 4):
            assert got[k] == pytest.approx(np.mean([model.weights[i] for i in b]))
    rows = [np.asarray(b, np.int64) for b in hashed.values()]
    for group in (1, 7, 1000):
        monkeypatch.setattr(RM, "GROUP", group)
        assert np.allclose(RM._grouped_scores(rows, model.weights), [np.mean(model.weights[r]) if len(r) else 0 for r in rows])


def test_without_pairs_all_is_zero(spark):
    model = RM.fit_reward_model(spark.createDataFrame([], "chosen string, rejected string"), size=16)
    assert not model.weights.any() and model.losses == []
    assert spark.range(1).select(RM.reward_scorer(spark, model)(F.lit("a b"))).first()[0] == 0
