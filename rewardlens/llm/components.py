"""Connected components by alternating large-star and small-star steps.

Edges stay in Spark; each round writes them to the shared scratch folder and
reads them back, so lineage does not grow and a lost executor costs one round.
A large-star or small-star step joins every node with one minimum, so a node
with very many links never meets all pairs of its neighbours, and the minimum is
a map-side partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardlens.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over ``edges(a, b)`` with a > b: neighbours move to their node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    lowest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    near = both.join(lowest, "a")
    if large:
        moved = near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``: root is the smallest node it reaches.

    Nulls and loops are left out; a table without links gives no rows.
    """
    edges = materialize(
        links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        edges = materialize(_star(_star(edges, True), False), "links")
        now = edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
