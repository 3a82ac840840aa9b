"""Connected components of an undirected edge table, by alternating large and small stars.

All state is tables of node pairs; each round is written to the shared folder.
A node's edges are spread over parts by a hash of their other ends: minima are
taken by part, then by node, and go back to the parts that the node has, so that
a hub's edges never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _with_least(edges: DataFrame, parts: int) -> DataFrame:
    """(u, v, m): each edge with the least ``v`` of its ``u``."""
    held = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts)).cast("int"))
    own = held.groupBy("u", "part").agg(F.min("v").alias("m"))
    least = own.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("part").alias("have"))  # ``parts`` rows a node at most
    return held.join(least.select("u", "m", F.explode("have").alias("part")), ["u", "part"]).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of longs. Returns (node, component) for nodes whose component has a smaller node; the smallest itself isn't listed."""
    parts = max(8, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    stars = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, parts).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        held = _with_least(large, parts)
        # the least end is kept as the node's own link
        small = held.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        stars = materialise(small.distinct())
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
