"""Table sources.

Parquet is read lazily with the columns the caller names, so Catalyst prunes
the scan (``ReadSchema``) and pushes filters into it (``PushedFilters``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# Schema of a preference dataset as the reference loads it (image kept as a path).
PREFERENCE_SCHEMA = T.StructType([
    T.StructField("idx", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("chosen", T.StringType()),
    T.StructField("rejected", T.StringType()),
    T.StructField("image_path", T.StringType()),
])


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read a table, pruned to ``columns``; how it is split is left to Spark's file settings."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a small table in few files, dealt to all cores; any other table as it is.

    A file with one row group is one task however it is split, and work on whole
    texts costs more than moving them once. A table with as many files as the
    session has cores, or of more than a few scan tasks a core, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 4 * cores or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def read_preference(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A preference dataset with the declared schema (no inference)."""
    return spark.read.schema(PREFERENCE_SCHEMA).format(fmt).load(path)


def split_head(df: DataFrame, key: str, percent: float) -> DataFrame:
    """The first ``percent`` of the rows by an integer ``key`` (``split="train[:5%]"``).

    The key at that rank is found by counting rows in ranges that shrink
    a thousandfold each round; then it is a filter. Only counts leave the tasks.
    """
    n, low, high = df.agg(F.count(F.lit(1)), F.min(key), F.max(key)).first()
    k = round(n * percent / 100.0)  # halves go to the even number, as in the split syntax
    if not k:
        return df.limit(0)
    below = 0
    while low < high:
        width = max(1, (high - low + 1) // 1000)
        cell = F.floor((F.col(key) - low) / width)
        counts = df.filter(F.col(key).between(low, high)).groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
        for c, m in sorted((r["c"], r["n"]) for r in counts):
            if below + m >= k:
                low, high = low + c * width, min(high, low + (c + 1) * width - 1)
                break
            below += m
    return df.filter(F.col(key) <= low)


def image_path(idx, directory: str = "saved_images"):
    """``<dir>/<idx>.jpg`` per row; the image itself is never decoded."""
    return F.concat(F.lit(directory.rstrip("/") + "/"), idx.cast("string"), F.lit(".jpg"))
