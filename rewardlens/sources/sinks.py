"""Sinks: append-only logs, JSON reports, and the running-moments state file.

The reference rewrites its whole JSON log after every row (quadratic I/O);
here every sink is an append of a distributed write. Paths should live in
shared storage (e.g. under ``spark.checkpoint.dir``), never a machine-local
folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardlens.functions.chat import chat_pair

SCORE_LOG_SCHEMA = T.StructType([
    T.StructField("idx", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("rejected", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))),
    T.StructField("chosen", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))),
    T.StructField("rejected_score", T.DoubleType()),
    T.StructField("generated_score", T.ArrayType(T.DoubleType())),
    T.StructField("chosen_score", T.DoubleType()),
    T.StructField("image_path", T.StringType()),
])

MOMENTS_SCHEMA = T.StructType([
    T.StructField("count", T.DoubleType()), T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()), T.StructField("var", T.DoubleType()),
])


def score_log_records(scored: DataFrame, image_dir: str = "saved_images") -> DataFrame:
    """One record per scored row, the fields of the reference's score log."""
    return scored.select(
        F.col("idx").cast("long").alias("idx"), "question",
        chat_pair("question", "rejected").alias("rejected"),
        chat_pair("question", "chosen").alias("chosen"),
        F.col("rejected_score").cast("double").alias("rejected_score"),
        F.col("generated_scores").alias("generated_score"),
        F.col("chosen_score").cast("double").alias("chosen_score"),
        F.concat(F.lit(image_dir.rstrip("/") + "/"), F.col("idx").cast("string"), F.lit(".jpg")).alias("image_path"),
    )


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_state(state: DataFrame, path: str) -> None:
    """One-row state as JSON with sorted keys (``to_json`` of a key-sorted struct)."""
    cols = sorted(state.columns)
    state.select(F.to_json(F.struct(*cols)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_state(spark: SparkSession, path: str, schema: T.StructType = MOMENTS_SCHEMA) -> DataFrame:
    t = spark.read.text(path)
    return t.select(F.from_json("value", schema).alias("s")).select("s.*")
