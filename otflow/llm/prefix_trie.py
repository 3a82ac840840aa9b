"""Prefix trie of conversations: who shares which first turns, and what sharing them saves.

A conversation is its turns in order of ``turn``, null first; equal turns go by the
md5 of role and text. Null roles and texts are empty; rows with a null conv_id belong
to no conversation and take no part. Repeated rows are turns of their own. Other
columns are ignored. No conversations give no nodes.

Texts aren't moved: a turn travels as 120 bits of its md5 and its length. A prefix is
known by two exclusive-or sums of hashes of (place, turn), so that running sums name
the nodes, in blocks of places whose sums are carried over: a conversation with a
third of all turns is spread. Totals of subtrees come from tree contraction, so depth
costs rounds by its logarithm only.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import SLICE_ROWS, sliced
from .common import materialise
from .tree_contraction import subtree_totals

#: Places of a conversation whose prefixes one task names.
BLOCK = 1 << 16
#: Conversations by whose ids' quotients the ends of a node are collected: bounds a row to so many ids.
IDS = 1 << 12
_NODE = ["depth", "h1", "h2"]


def turns_of(conversations: DataFrame, rows: int = SLICE_ROWS) -> DataFrame:
    """(conv_id, place, t1, t2, size): all turns in order, counted from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    held = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("size"))
    # equal turns of one conversation are one row with their number, until they have places
    once = held.groupBy("conv_id", "turn", "digest", "size").agg(F.count(F.lit(1)).alias("times"))
    timed = once.withColumn("_t", F.coalesce(F.col("turn").cast("double"), F.lit(float("-inf"))))
    cut = sliced(timed, ["conv_id"], "_t", rows=rows)
    last = cut.carried(cut.df, {"_before": F.sum("times")}).withColumn("_last", F.sum("times").over(cut.window(F.asc_nulls_first("turn"), "digest")) + F.col("_before"))
    number = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {BLOCK}")))
    first = F.col("_last") - F.col("times") + F.col("_b") * BLOCK
    spread = last.select("conv_id", number(1).alias("t1"), number(16).alias("t2"), "size", "times", "_last", blocks.alias("_b"))
    return spread.select("conv_id", "t1", "t2", "size", F.explode(F.sequence(first + 1, F.least(first + BLOCK, F.col("_last")))).alias("place"))


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations that start with the first turns of their group's first one, and (conv_id, length) of all.

    The first h = crc32(conv_id) % ``most`` turns are those of conversation conv_id - conv_id % ``group``."""
    base, h = F.col("conv_id") - F.col("conv_id") % group, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    bases = sizes.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = sizes.withColumns({"base": base, "h": h}).join(bases, "base", "left").withColumn("led", F.least("h", F.coalesce("base_own", F.lit(0))))
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "base")
    led = convs.where("led > 0").select("conv_id", "base", "led").join(heads, "base").where(F.col("place") <= F.col("led")).select("conv_id", "place", "t1", "t2", "size")
    own = turns.where(F.col("place") > h).join(convs.select("conv_id", "h", "led"), "conv_id").select("conv_id", (F.col("place") - F.col("h") + F.col("led")).alias("place"), "t1", "t2", "size")
    return led.unionByName(own), convs.select("conv_id", (F.col("led") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``turns`` with depth, the prefix's hashes (h1, h2) and those of the prefix before (p1, p2)."""
    mark = lambda t, seed: F.xxhash64(F.lit(seed), "place", t)
    held = turns.withColumns({"m1": mark("t1", 1), "m2": mark("t2", 2), "_block": F.expr(f"(place - 1) div {block}")})
    along = Window.partitionBy("conv_id", "_block").orderBy("place")
    run = held.withColumns({"h1": F.bit_xor("m1").over(along), "h2": F.bit_xor("m2").over(along)})
    if (turns.agg(F.max("place")).first()[0] or 0) > block:
        whole = held.groupBy("conv_id", "_block").agg(F.bit_xor("m1").alias("c1"), F.bit_xor("m2").alias("c2"))
        before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        carry = whole.select("conv_id", "_block", F.bit_xor("c1").over(before).alias("c1"), F.bit_xor("c2").over(before).alias("c2")).where("_block > 0")
        joined = run.join(carry, ["conv_id", "_block"], "left")
        run = joined.withColumns({h: F.col(h).bitwiseXOR(F.coalesce(c, F.lit(0))) for h, c in (("h1", "c1"), ("h2", "c2"))})
    return run.select("conv_id", F.col("place").alias("depth"), "size", "h1", "h2", F.col("h1").bitwiseXOR(F.col("m1")).alias("p1"), F.col("h2").bitwiseXOR(F.col("m2")).alias("p2"))


def _sha(batches):
    """(depth, h1, h2, ends_sha256) of rows that come node by node, ids in order: a node's ids are hashed as they come."""
    key, digest = None, None
    for batch in batches:
        out = []
        for *own, ids in zip(*(batch.column(c).to_pylist() for c in [*_NODE, "ids"]), strict=True):
            if own != key:
                if digest:
                    out.append((*key, digest.hexdigest()))
                key, digest = own, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield from _nodes(out)
    if digest:
        yield from _nodes([(*key, digest.hexdigest())])


def _nodes(rows):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[*_NODE, "ends_sha256"])


def _equal(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, y: x & y, [a[m] == b[n] for m, n in pairs])


def trie(conversations: DataFrame, group: int = 100, most: int = 6, block: int = BLOCK, rows: int = SLICE_ROWS) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = materialise(turns_of(conversations, rows))
    lines, lengths = rebuilt(turns, group, most)
    lengths = materialise(lengths)
    places = materialise(prefixes(materialise(lines), block))
    whole = lengths.agg(F.min("conv_id").alias("root"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    deep = places.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("size").alias("size"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    deep = materialise(deep)
    upper = deep.select(F.col("depth").alias("_d"), F.col("h1").alias("_1"), F.col("h2").alias("_2"), F.col("conv_id").alias("parent_conv_id"))
    below = deep.where("depth > 1").withColumn("_up", F.col("depth") - 1)
    below = below.join(upper, _equal(below, upper, [("_up", "_d"), ("p1", "_1"), ("p2", "_2")])).drop("_up", "_d", "_1", "_2")
    top = deep.where("depth = 1").join(F.broadcast(whole.select(F.col("root").alias("parent_conv_id"))))  # one row
    columns = ["depth", "h1", "h2", "conv_id", "parent_conv_id", "n_convs", "size"]
    zero = F.lit(0).cast("long")
    root = whole.select(zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), F.col("root").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", zero.alias("size"))
    nodes = root.unionByName(top.select(*columns)).unionByName(below.select(*columns))
    node, parent = F.struct("conv_id", "depth"), F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    nodes = nodes.withColumns({"id": node, "parent": F.when(F.col("parent_conv_id").isNotNull(), parent)})
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    saved = (F.col("n_convs") - 1) * F.col("size")
    totals = subtree_totals(nodes.select("id", "parent", F.array(F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), saved).alias("value")))
    ends = lengths.join(places.select("conv_id", F.col("depth").alias("length"), "h1", "h2"), ["conv_id", "length"], "left")
    ends = ends.select("conv_id", F.col("length").alias("depth"), *[F.coalesce(h, F.lit(0)).alias(h) for h in ("h1", "h2")], F.expr(f"shiftright(conv_id, {IDS.bit_length() - 1})").alias("part"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = ends.groupBy(*_NODE, "part").agg(ids.alias("ids"))  # at most IDS a row
    hashed = parts.repartition(*_NODE).sortWithinPartitions(*_NODE, "part").select(*_NODE, "ids").mapInArrow(_sha, "depth long, h1 long, h2 long, ends_sha256 string")
    out = nodes.join(totals, "id").join(hashed, _NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("total")[0].alias("n_leaves"), F.col("total")[1].alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
