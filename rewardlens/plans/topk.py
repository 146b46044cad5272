"""Last / first K rows per key.

``row_number() <= k`` is planned with a group limit before the shuffle
(``WindowGroupLimit``, Spark 3.5+): every task keeps at most K rows of a key, so
a key with a third of all rows sends K rows from each task, not its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardlens.functions.common import as_col


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, last: bool = True, rank_col: str | None = None) -> DataFrame:
    """Rows of ``df`` that are among the last (or first) ``k`` per ``keys`` by ``order``.

    ``order`` must be a total order inside a key. ``rank_col`` (0 = last/first)
    is added when given.
    """
    ocols = [as_col(c) for c in order]
    w = Window.partitionBy(*keys).orderBy(*[c.desc() if last else c.asc() for c in ocols])
    s = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)
    if rank_col:
        s = s.withColumn(rank_col, F.col("_rank") - 1)
    return s.drop("_rank")
