"""Small helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardlens.session import scratch_path

#: The white space of the word rules, as characters and as a Java / DuckDB character class.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts lineage: later stages read the written files, which outlive any
    executor, and rows keep the values they had when written.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def strip_space(c: Column) -> Column:
    """Delete every white-space character; null counts as empty."""
    return F.translate(F.coalesce(c, F.lit("")), SPACE_CHARS, "")


def most_frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the largest counts, at most ``most`` of them, without sorting.

    Counts fall into bins of 1/32 octave, some 2000 at any size; rows from the
    lowest bin on at which no more than ``most`` rows remain are kept, so all
    rows of one count stay or go together.
    """
    bin_ = F.floor(F.log2(F.col(count).cast("double")) * 32)
    left = most
    low = None
    for b, n in sorted(((r[0], r[1]) for r in df.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        if n > left:
            break
        left, low = left - n, b
    return df.limit(0) if low is None else df.filter(bin_ >= low)


def numbered_rows(df: DataFrame, name: str, as_read: bool, table: str) -> DataFrame:
    """``df`` with a row number ``name`` that every later plan sees alike.

    The numbers of a table ``as_read`` come from its scan, which is the same in
    every plan. Any other frame is written with its numbers.
    """
    rows = df.withColumn(name, F.monotonically_increasing_id())
    return rows if as_read else materialize(rows, table)


def without(df: DataFrame, gone: DataFrame, name: str, table: str) -> DataFrame:
    """The rows of ``df`` whose number ``name`` is not in ``gone``.

    The dropped numbers are written first, so their size is known: few of them go to
    the rows, and only many make Spark move rows to meet them.
    """
    return df.join(materialize(gone, table), name, "left_anti")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
