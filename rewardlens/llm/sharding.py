"""Sharding by extendible hashing (native DataFrame operations only).

Every row has a 60-bit hash. A bucket is a hash prefix; it splits on the next
bit only while it holds more bytes than a shard may, so crowded parts of the
hash space get long prefixes and the rest short ones. The directory is the set
of buckets that fit. It is found on a table of prefix sums, about ``2**slack``
rows a shard, never on the rows themselves; only buckets that are still too
large at that depth go on to further bits.

Rows that share one hash (the same key repeated) cannot be told apart by any
bit. Such a bucket is chained: its rows are numbered and dealt to as many
overflow shards as the limit asks for. The number comes from counts per slot, a
scan partition's number that is written with the row, so one key with a third of
all rows is still dealt by many tasks, and every later plan sees the same slots.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardlens.llm.common import materialize

BITS = 60


def hash60(key: Column) -> Column:
    """The first 60 bits of the key's MD5 as a non-negative long; a null key hashes as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _trie(fine: DataFrame, top: int, depth: int) -> DataFrame:
    """Sums of every prefix from ``top`` to ``depth`` bits above the prefixes of ``fine``."""
    t = fine.withColumn("d", F.explode(F.sequence(F.lit(top), F.lit(depth))))
    return (t.groupBy("d", F.expr(f"shiftright(prefix, {depth} - d)").alias("p"))
            .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.max("largest").alias("largest")))


def directory(weights: DataFrame, limit: int, slack: int = 5, step: int = 10) -> DataFrame:
    """Buckets of an extendible-hash directory over ``weights(hash, bytes)``.

    Returns ``(prefix, depth, bytes, n, largest)``: each bucket holds at most
    ``limit`` bytes, or a single row, or (at 60 bits) rows of one hash. An empty
    table has no bucket.
    """
    total = weights.agg(F.sum("bytes")).first()[0] or 0
    need = math.ceil(math.log2(total / limit)) if total > limit else 0
    depth, top = min(BITS, need + slack), 0
    leaves, open_ = None, None
    while True:
        rows = weights
        if open_ is not None:
            rows = rows.join(open_.select(F.col("p").alias("_p")), F.shiftright("hash", BITS - top + 1) == F.col("_p"), "left_semi")
        fine = rows.groupBy(F.shiftright("hash", BITS - depth).alias("prefix")).agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("largest"))
        trie = materialize(_trie(fine, top, depth).withColumn("fits", (F.col("bytes") <= limit) | (F.col("n") == 1) | (F.col("d") == BITS)), "shard-trie")
        above = trie.filter(~F.col("fits")).select((F.col("d") + 1).alias("d"), F.col("p").alias("up"))
        fit = trie.filter("fits")
        inner = fit.filter(F.col("d") > top).withColumn("up", F.shiftright("p", 1)).join(above, ["d", "up"], "left_semi").drop("up")
        found = fit.filter(F.col("d") == top).unionByName(inner)
        found = found.select(F.col("p").alias("prefix"), F.col("d").alias("depth"), "bytes", "n", "largest")
        leaves = found if leaves is None else leaves.unionByName(found)
        open_ = trie.filter(~F.col("fits") & (F.col("d") == depth))
        if depth == BITS or open_.isEmpty():
            return leaves
        top, depth = depth + 1, min(BITS, depth + step)


def extendible_shards(df: DataFrame, key: str, size: Column, limit: int, slack: int = 5) -> DataFrame:
    """The shard of every row of ``df``: ``(key, hash, bytes, depth, prefix, part, shard, oversize)``.

    ``size`` is a row's bytes (null: 0). ``shard`` is ``depth:prefix``, with
    ``+part`` for the later parts of a chained bucket. A row larger than
    ``limit`` has a shard of its own and ``oversize`` true. Only the key and the
    size move; other columns of ``df``, whatever their names, are not read.
    """
    w = materialize(
        df.select(F.col(key).alias("key"), hash60(F.col(key)).alias("hash"), F.coalesce(size, F.lit(0)).cast("long").alias("bytes"),
                  F.spark_partition_id().alias("slot")),
        "shard-weights")
    leaves = materialize(directory(w, limit, slack), "shard-directory")
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    # the directory: a bucket of d bits owns every entry of the deepest level under its prefix,
    # so a row finds its bucket by walking the depths that occur
    depths = [r[0] for r in leaves.select("depth").distinct().orderBy("depth").collect()]  # at most 61 values
    spot = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("hash", BITS - d).alias("prefix")) for d in depths or [deepest]]))
    placed = (w.withColumn("at", spot).select("key", "hash", "bytes", "slot", "at.depth", "at.prefix")
              .join(leaves.select("depth", "prefix", F.col("bytes").alias("leaf_bytes"), "n", "largest"), ["depth", "prefix"]))
    whole = placed.filter((F.col("leaf_bytes") <= limit) | (F.col("n") == 1)).withColumn("part", F.lit(0).cast("long"))
    chained = _chain(placed.filter((F.col("leaf_bytes") > limit) & (F.col("n") > 1)), limit)
    cols = ["key", "hash", "bytes", "depth", "prefix", "part"]
    out = whole.select(*cols).unionByName(chained.select(*cols))
    name = F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("prefix").cast("string"))
    return out.select(
        F.col("key").alias(key), "hash", "bytes", F.col("depth").cast("long").alias("depth"), "prefix", "part",
        F.when(F.col("part") > 0, F.concat(name, F.lit("+"), F.col("part").cast("string"))).otherwise(name).alias("shard"),
        (F.col("bytes") > limit).alias("oversize"))


def _chain(rows: DataFrame, limit: int) -> DataFrame:
    """Deal the rows of each one-hash bucket to parts of ``floor(limit / largest row)`` rows, at least one."""
    counts = rows.groupBy("hash", "slot").agg(F.count(F.lit(1)).alias("here"))
    before = Window.partitionBy("hash").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("start", F.coalesce(F.sum("here").over(before), F.lit(0)))
    local = Window.partitionBy("hash", "slot").orderBy("bytes")
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("largest"), F.lit(1))))
    return (rows.withColumn("local", F.row_number().over(local)).join(counts.select("hash", "slot", "start"), ["hash", "slot"])
            .withColumn("part", F.floor((F.col("start") + F.col("local") - 1) / each).cast("long")))
