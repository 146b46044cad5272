"""Tables written in hash buckets, for joins and groups that exchange nothing.

Rows go to as many files as there are buckets, by the same hash that a shuffle
would use, and stay there: every later join or group on the bucket keys reads its
side where it is. The one shuffle is paid when the table is written, so this is
for tables that are joined more than once, such as per-token scores kept over an epoch.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardlens.session import scratch_path

#: Spark's default bound on buckets (``spark.sql.sources.bucketing.maxBuckets``).
MOST_BUCKETS = 100_000
#: Rows that one task of a join or group over buckets holds and sorts.
ROWS_A_BUCKET = 500_000


def buckets_for(rows: int, least: int = 8) -> int:
    """Buckets for a table of (about) ``rows`` rows, so that a bucket's rows do not grow with the table."""
    return min(MOST_BUCKETS, max(least, -(-rows // ROWS_A_BUCKET)))


def write_bucketed(df: DataFrame, keys: Sequence[str], name: str, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """``df`` as a table in ``buckets`` sorted buckets of ``keys``, one file each.

    The table has a name of its own in the session's catalog and its files in
    ``path`` (a fresh shared folder if not given). Tables that are to be joined need
    the same keys in the same order, of the same types, and the same number of buckets
    (the session's shuffle partitions if not given). Choose it by size: a bucket is
    one task of a join.
    """
    spark = df.sparkSession
    if not keys:
        raise ValueError("name the bucket keys")
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) if buckets is None else buckets
    if not 1 <= n <= MOST_BUCKETS:
        raise ValueError(f"the number of buckets must be from 1 to {MOST_BUCKETS}")
    table = f"{name}_{uuid.uuid4().hex}"
    (df.repartition(n, *[F.col(k) for k in keys]).write.bucketBy(n, *keys).sortBy(*keys)
     .option("path", path or scratch_path(spark, name)).format("parquet").saveAsTable(table))
    return spark.table(table)


def co_joined(left: DataFrame, *others: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Merge joins of tables bucketed on ``on``; a broadcast would move a side that is in place already."""
    out = left
    for other in others:
        out = out.join(other.hint("merge"), on=list(on), how=how)
    return out
