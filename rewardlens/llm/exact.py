"""Exact deduplication on an extendible-hash index in shared files.

1. *Entry log*: each row's hash, digest, size and row number, without its text, in the shared folder.
2. *Classes*: rows are grouped by hash and normalised text, so bytes are what decides
   (copies meet in map-side partial aggregates first, so a text with a third of all rows is one row a task, and each text moves once).
3. *Index*: one entry for each class, placed in
   the bucket of its hash prefix. An overfull bucket doubles its part of the
   directory, that is, it splits on a further bit (``sharding.directory``).
   Owner tasks take runs of buckets, which are ranges of the hash, and write
   them sorted to shared files. Classes with one hash are chained. An entry's
   digest is that of its class's text; two classes of one digest would stop the job.
4. *Rows* find the entry of their class in the chain of their hash; AQE splits the partition of a hot text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rewardlens.llm.common import columns, fresh, materialize, numbered_rows, strip_space, without
from rewardlens.llm.sharding import BITS, directory
from rewardlens.session import scratch_path

#: Entries of one index bucket before it splits.
BUCKET_ENTRIES = 4096


def _log(docs: DataFrame, id_col: str, text_col: str, rid_col: str | None) -> DataFrame:
    norm = strip_space(F.col(text_col))
    rid = F.col(rid_col) if rid_col else F.monotonically_increasing_id()
    return docs.select(
        rid.alias("rid"), F.col(id_col).alias("id"),
        F.xxhash64(norm).alias("h"), F.sha2(norm, 256).alias("sha"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_chars"))


def byte_classes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(h, sha, group_size)``: one row for each different normalised text, told apart by its bytes."""
    norm = strip_space(F.col(text_col))
    whole = docs.select(F.xxhash64(norm).alias("h"), norm.alias("norm")).groupBy("h", "norm").agg(F.count(F.lit(1)).alias("group_size"))
    return whole.select("h", F.sha2("norm", 256).alias("sha"), "group_size")


def build_index(log: DataFrame, classes: DataFrame, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """The index files of an entry log and its byte classes: ``(bucket, depth, h, chain, sha, group_size, keep_rid, keep_id)``."""
    first = F.min(F.struct((-F.col("n_chars")).alias("short"), F.col("id").isNull().alias("no_id"), "id", "rid"))
    best = log.groupBy("h", "sha").agg(F.count(F.lit(1)).alias("logged"), first.alias("best"))
    # a class whose rows the log counts otherwise shares its digest with another one
    size = F.when(F.col("logged") == F.col("group_size"), F.col("group_size")).otherwise(F.raise_error(F.lit("texts of one digest differ in their bytes")).cast("long"))
    entries = materialize(
        classes.join(best, ["h", "sha"])
        .select("h", "sha", size.alias("group_size"), F.col("best.rid").alias("keep_rid"), F.col("best.id").alias("keep_id"),
                F.shiftrightunsigned("h", 64 - BITS).alias("hash")),
        "dedup-entries")
    buckets = directory(entries.select("hash", F.lit(1).cast("long").alias("bytes")), capacity)
    depths = [r[0] for r in buckets.select("depth").distinct().collect()]  # at most 61 values
    spot = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("hash", BITS - d).alias("prefix")) for d in depths or [0]]))
    owned = (entries.withColumn("at", spot).select("*", "at.depth", "at.prefix").drop("at")
             .join(buckets.select("depth", "prefix"), ["depth", "prefix"])
             .withColumn("bucket", F.expr(f"shiftleft(prefix, {BITS} - depth)")))
    chain = F.row_number().over(Window.partitionBy("bucket", "h").orderBy("sha")) - 1
    path = scratch_path(log.sparkSession, "dedup-index")
    (owned.repartitionByRange("bucket").withColumn("chain", chain).sortWithinPartitions("bucket", "h", "chain")
     .select("bucket", "depth", "h", "chain", "sha", "group_size", "keep_rid", "keep_id").write.parquet(path))
    return log.sparkSession.read.parquet(path)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ENTRIES,
                rid_col: str | None = None) -> DataFrame:
    """Classes of rows whose texts are equal without white space.

    One row for each row of ``docs``: ``(rid, id_col, keep_id, group_size, kept, text_sha256, bucket, chain)``.
    Of equal texts the row with the most code points stays, then the smallest
    id (a null id comes last), then, of wholly repeated rows, the first written
    (or first by ``rid_col``, a column that numbers the rows). A null text counts as empty; an empty table gives no rows. Columns other
    than the two named are not read.
    """
    log = materialize(_log(docs, id_col, text_col, rid_col), "dedup-log")
    index = build_index(log, byte_classes(docs, text_col), capacity)
    rows = log.join(index, ["h", "sha"]).select(
        "rid", "id", "h", "sha", "keep_id", "keep_rid", "group_size", "bucket", "chain")
    return rows.select("rid", F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
                       (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"), "bucket",
                       F.col("chain").cast("long").alias("chain"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ENTRIES, as_read: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of wholly repeated rows one.

    They are numbered in a written copy, or in place if ``docs`` is a table ``as_read``.
    """
    row = fresh(docs, "row")
    numbered = numbered_rows(docs, row, as_read, "dedup-numbered")
    gone = exact_dedup(numbered, id_col, text_col, capacity, row).filter("not kept").select(F.col("rid").alias(row))
    return without(numbered, gone, row, "dedup-gone").select(*columns(docs))
