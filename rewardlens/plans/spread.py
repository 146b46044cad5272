"""Spread per-group aggregates back to the member rows.

A window partitioned by the group key puts a whole group into one task, so a
group holding a third of all rows becomes one straggler. Instead we
aggregate (partial + final, so a hot group is pre-combined on the map side)
and join the one-row-per-group result back on the key. The join is an
ordinary equi-join: AQE turns it into a broadcast only when the *runtime*
size of the aggregate is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``,
and otherwise splits skewed partitions of the row side (skew join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def spread(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """``df`` with the per-``keys`` aggregates ``aggs`` added to every row.

    Rows whose key is NULL keep NULL aggregates (left join; NULL keys never
    match, exactly like a window over a NULL partition would not mix them
    with other rows -- they form their own group there, here they are left
    unmatched, which is what every caller in this library wants).
    """
    keys = list(keys)
    stats = df.groupBy(*keys).agg(*aggs)
    return df.join(stats, on=keys, how="left")
