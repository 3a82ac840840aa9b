"""Totals of all subtrees by parallel tree contraction, in join rounds.

A round compresses and rakes. Compress: chains of nodes with one child are taken out
at once; their nodes find the chain's end by pointer doubling, and the edge above it
keeps what they add. Rake: leaves add to their parents and go. Either halves paths
or takes a level of leaves, so a tree of n nodes needs O(log n) rounds, however deep
it is. In the end, the rounds' chains are expanded in reverse: a node's total is what
lies on the way to its chain's end and the end's total.

All sums and counts by parent are combined before the exchange and all other joins are
between unique ids, so a node with a third of all nodes as children is no hot key.
Each round is written to the shared folder: lost executors cost a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _plus(a: str, b: str):
    """Sum of two arrays of longs."""
    return F.zip_with(a, b, lambda x, y: x + y)


def _ends(chains: DataFrame) -> DataFrame:
    """Chains (id, next, add, top, hops) followed to their ends: pointer doubling until no pointer leads into a chain."""
    while True:
        ahead = chains.select(F.col("id").alias("_id"), F.col("next").alias("_next"), F.col("add").alias("_add"), F.col("hops").alias("_hops"))
        joined = chains.join(ahead, chains["next"] == ahead["_id"], "left")
        some = F.col("_id").isNotNull()
        chains = materialise(joined.select(
            "id", F.coalesce("_next", "next").alias("next"), F.when(some, _plus("add", "_add")).otherwise(F.col("add")).alias("add"), "top", (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), some.alias("moved"),
        ))
        if not chains.where("moved").limit(1).count():
            return chains.drop("moved")
        chains = chains.drop("moved")


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """(id, total): sums of ``value`` over the subtree of each node.

    ``nodes`` has unique ``id`` of any type that can be ordered, ``parent`` (null for roots) and ``value``, an array of
    longs of one length. Several roots are several trees; every parent must be a node. No nodes give no rows."""
    alive = nodes.select("id", "parent", "value", F.transform("value", lambda _: F.lit(0).cast("long")).alias("edge"))
    gone, chains_of = [], []
    while True:
        below = alive.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("_of")).agg(F.count(F.lit(1)).alias("children"), F.max(F.struct("id", "edge")).alias("only"))
        held = materialise(alive.join(below, alive["id"] == below["_of"], "left").drop("_of").withColumn("children", F.coalesce("children", F.lit(0))))
        unary = (F.col("children") == 1) & F.col("parent").isNotNull()
        chains = held.where(unary).select("id", F.col("only.id").alias("next"), _plus("value", "only.edge").alias("add"), F.struct("parent", "edge").alias("top"), F.lit(1).cast("long").alias("hops"))
        rest = held.where(~unary).drop("only")
        spliced = chains.limit(1).count() > 0
        if spliced:
            chains = _ends(chains)
            # the longest way to an end starts at the chain's top, whose edge the end takes over
            ends = chains.groupBy(F.col("next").alias("_end")).agg(F.max_by(F.struct("top", "add"), "hops").alias("_up"))
            joined = rest.join(ends, rest["id"] == ends["_end"], "left")
            over = F.col("_end").isNotNull()
            rest = joined.select("id", F.when(over, F.col("_up.top.parent")).otherwise(F.col("parent")).alias("parent"), "value", F.when(over, _plus("_up.add", "_up.top.edge")).otherwise(F.col("edge")).alias("edge"), "children")
            rest = materialise(rest)
        chains_of.append(chains.select("id", "next", "add") if spliced else None)
        leaf = F.col("children") == 0
        done = rest.where(leaf).select("id", F.col("value").alias("total"))
        gone.append(done)
        inner = rest.where(~leaf).drop("children")
        if not inner.limit(1).count():
            break
        raked = rest.where(leaf & F.col("parent").isNotNull()).select("parent", F.posexplode(_plus("value", "edge")).alias("k", "x"))
        sums = raked.groupBy("parent", "k").agg(F.sum("x").alias("x")).groupBy(F.col("parent").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("k", "x")))["x"].alias("more"))
        alive = inner.join(sums, inner["id"] == sums["_of"], "left").select("id", "parent", F.when(F.col("more").isNull(), F.col("value")).otherwise(_plus("value", "more")).alias("value"), "edge")
    known = None
    for done, chains in zip(reversed(gone), reversed(chains_of), strict=True):
        known = done if known is None else known.unionByName(done)
        if chains is not None:
            ends = known.select(F.col("id").alias("_end"), F.col("total").alias("_total"))
            known = known.unionByName(materialise(chains.join(ends, chains["next"] == ends["_end"]).select("id", _plus("add", "_total").alias("total"))))
    return known
