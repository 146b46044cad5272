"""Registry queries against their DuckDB SQL on the small tables."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from rewardlens.sources.tables import TABLES
from tests.conftest import SF_SMALL

FAST = ["group_advantage", "rollout_metrics", "policy_loss", "apply_chat_template", "extract_prompt", "score_histogram",
        "prompt_tracker", "pack_constant_length", "pack_buffered", "repeat_sampler", "label_completion_multi", "flush_left"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    s = Counter(tuple(_norm(r[c]) for c in cols) for r in sdf.collect())
    rel = con.sql(E.oracle_sql()[name])
    idx = {c: i for i, c in enumerate(rel.columns)}
    assert sorted(rel.columns) == cols
    d = Counter(tuple(_norm(r[idx[c]]) for c in cols) for r in rel.fetchall())
    assert s == d


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "max_advantage" in df.columns


def test_every_query_has_oracle():
    from rewardlens.plans.catalog import ORACLE, QUERIES

    # SQL can neither merge byte pairs nor fit a model: these are tested against the public tokenizer
    # (tests/test_subword.py) and a plain fit (tests/test_reward_model.py)
    assert set(QUERIES) - set(ORACLE) == {"encode_subword", "subword_counts", "label_chatml_subword", "reward_model_score"} and set(ORACLE) <= set(QUERIES)
