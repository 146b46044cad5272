"""Registry of the queries behind ``__spark_entry__``.

Each entry is one operator of SURVEY §2 run over whole driver tables (or
views Spark derives from them), with the equivalent DuckDB SQL beside it.
Float outputs are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from rewardlens.plans import (  # noqa: F401
        q_conversation,
        q_io,
        q_logits,
        q_rewards,
        q_sampling,
        q_stats,
        q_streaming,
        q_subword,
        q_tokens,
        q_udf,
    )
