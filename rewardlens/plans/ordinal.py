"""Global ordinals and prefix sums without a global window.

A window with an ``ORDER BY`` and no ``PARTITION BY`` moves every row into a
single task. Here the rows are range-partitioned by the *whole* order tuple, so
rows that tie in its first column are dealt to several buckets too, and written
with their bucket number to the shared scratch folder. Then:

1. per-bucket totals -- one row for each bucket;
2. an exclusive running total of these on that small table;
3. a window *partitioned by bucket* for the running value inside each bucket;
4. an ordinary join of the offsets (Spark broadcasts them when they are small).

The number of buckets grows with the square root of the row count, and so do the
rows of a bucket and the table of offsets. What is written is fixed: a retried
task reads the same buckets again. Callers pass keys and values only and join
the result to their payload.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardlens.functions.common import as_col
from rewardlens.session import scratch_path


#: Spark removes the shuffle files of a job when it ends, where this is set.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder: later jobs read files instead of the lineage.

    Nothing reads the shuffle files of the write again, so Spark removes them when it ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bucket_count(rows: int) -> int:
    """Buckets for ``rows`` rows: 16 at a hundred thousand, 1600 at a thousand million."""
    return max(1, math.ceil(math.sqrt(rows) / 20))


def range_buckets(df: DataFrame, order: Sequence[Column], name: str = "bucket", rows: int | None = None) -> DataFrame:
    """``df`` as a written table with a bucket number that never decreases along ``order``.

    ``rows`` says how many rows there are (about) where the caller knows: then they
    are written once. Otherwise they are written first and counted in the files.
    """
    if rows is None:
        df = written(df, "unordered")
        rows = df.count()  # from the files' row counts
    return written(df.repartitionByRange(bucket_count(rows), *order).withColumn(name, F.spark_partition_id()), "ordered")


def running(
    df: DataFrame,
    order_cols: Sequence[str | Column],
    value: Column | dict[str, Column] | None = None,
    out: str = "ordinal",
    inclusive: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Add running totals over the total order ``order_cols``.

    ``value=None`` counts rows into ``out``, giving a dense 0-based ordinal
    (``inclusive`` False) -- the order must be total (unique) for a
    deterministic result. ``value`` may be a dict ``{out_name: Column}`` to
    compute several running totals in one pass. ``rows`` as in :func:`range_buckets`.
    """
    order = [as_col(c) for c in order_cols]
    if value is None:
        values = {out: F.lit(1).cast("long")}
    elif isinstance(value, Column):
        values = {out: value}
    else:
        values = dict(value)
    vcols = {o: f"_v{i}" for i, o in enumerate(values)}
    b = range_buckets(df.withColumns({vcols[o]: c for o, c in values.items()}), order, "_bucket", rows)

    totals = b.groupBy("_bucket").agg(*[F.sum(v).alias(f"_t{v}") for v in vcols.values()])
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", *[F.coalesce(F.sum(f"_t{v}").over(before), F.lit(0)).alias(f"_o{v}") for v in vcols.values()])

    w_in = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    res = b.withColumns({f"_w{v}": F.sum(v).over(w_in) for v in vcols.values()}).join(offsets, "_bucket")
    for o, v in vcols.items():
        res = res.withColumn(o, F.col(f"_o{v}") + F.col(f"_w{v}") - (F.lit(0) if inclusive else F.col(v)))
    return res.drop("_bucket", *[p + v for v in vcols.values() for p in ("", "_o", "_w")])
