"""Exact top-k inner-product search with KD-trees per shard.

Rows are dealt to shards, and each shard is cut by median splits on the
dimension of largest spread into leaves, every node with the tight box of its
points. A shard's tree is built once and written as one row. A query visits nodes
best first, by the largest inner product that a node's box allows, and stops where
that falls below its kth score so far. A query's first shard starts from nothing;
the kth score found there is propagated to all other shards as a floor, so that
most of their boxes are never opened, and shards whose whole box lies below it
aren't visited at all.

A task reads a shard's tree and then streams that shard's queries past it, so it
holds one tree (``SHARD`` components in expectation) and a batch of queries,
whatever the size of either side; rows are never copied. Components become
integers floor(scale * x); scores are exact integers, held within a long's range.

Nulls and oddities: rows with a null id, a null vector, or null or non-finite
components (also where scale * x is beyond a double) take no part; only vectors of
one length are compared; repeated ids are separate rows, but never the query's own
id; rows that share a query id are one query, with the smallest of their vectors;
ties go to the smaller id (and copies of one row are ranked one after the other).
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

#: Points of a leaf, and components of a shard.
LEAF, SHARD = 64, 1 << 21
TOP = (1 << 63) - 1
#: Bytes of the trees' boxes up to which they are broadcast.
BOXES = 64 << 20
FOUND = "query_id long, vec_id long, score long"


class KDTree:
    """Nodes in arrays: box, range of points, children. Points are reordered so that a node's are together."""

    ARRAYS = ("points", "ids", "low", "high", "span", "child")

    @staticmethod
    def read(raw: bytes) -> KDTree:
        tree = object.__new__(KDTree)
        with np.load(io.BytesIO(raw)) as held:
            for k in KDTree.ARRAYS:
                setattr(tree, k, held[k])
        tree.most, tree.whole = float(max(np.abs(tree.low[0]).max(), np.abs(tree.high[0]).max())), None
        return tree

    def write(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self.ARRAYS})
        return out.getvalue()

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.order = np.arange(len(points))
        self.low, self.high, self.span, self.child = [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            a, b, parent = todo.pop()
            own = points[self.order[a:b]]
            at = len(self.low)
            self.low.append(own.min(axis=0))
            self.high.append(own.max(axis=0))
            self.span.append((a, b))
            self.child.append([])
            if parent >= 0:
                self.child[parent].append(at)
            wide = self.high[at] - self.low[at]
            if b - a > LEAF and wide.max() > 0:
                half = (b - a) // 2
                part = np.argpartition(own[:, int(wide.argmax())], half)
                self.order[a:b] = self.order[a:b][part]
                todo += [(a, a + half, at), (a + half, b, at)]
        self.points, self.ids = points[self.order], ids[self.order]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.span, self.child = np.array(self.span).reshape(-1, 2), np.array([c or (-1, -1) for c in self.child]).reshape(-1, 2)

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple]:
        """The k best (score, -id) at or above ``floor``, without rows of id ``own``. Scores are clamped to a long's range."""
        points, low, high = self.points, self.low, self.high
        most = max(self.most, float(np.abs(query).max()))
        if most >= 2.0**26 or len(query) * most * most >= 2.0**53:  # beyond what doubles hold exactly
            self.whole = self.whole or [_integers(x) for x in (points, low, high)]
            (points, low, high), query = self.whole, _integers(query)
        bounds = high @ np.maximum(query, 0) + low @ np.minimum(query, 0)  # largest inner product that each box allows
        best: list[tuple] = []
        queue = [(-bounds[0], 0)]
        while queue:
            bound, at = heapq.heappop(queue)
            least = best[0][0] if len(best) == k else floor
            if least is not None and -bound < least:
                break
            if self.child[at][0] >= 0:
                for c in self.child[at].tolist():
                    heapq.heappush(queue, (-bounds[c], c))
                continue
            a, b = self.span[at].tolist()
            scores = points[a:b] @ query
            able = self.ids[a:b] != own
            if least is not None:
                able &= (scores >= least).astype(bool)
            for i in np.flatnonzero(able):
                item = (min(max(int(scores[i]), -TOP - 1), TOP), -int(self.ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return best


def _integers(x: np.ndarray) -> np.ndarray:
    """Integers of any size."""
    return np.array([int(c) for c in x.ravel().tolist()], object).reshape(x.shape)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    tree = KDTree(np.stack(rows["v"].to_list()), rows["vec_id"].to_numpy())
    return pd.DataFrame({"dim": rows["dim"].iloc[:1], "shard": rows["shard"].iloc[:1], "tree": [tree.write()], "low": [tree.low[0]], "high": [tree.high[0]]})


def _search_all(k: int):
    """Of a partition sorted by shard, a tree before its queries: the trees one after the other, the queries past them."""

    def run(batches):
        tree, place = None, None
        for batch in batches:
            out = []
            for dim, shard, packed, query_id, v, floor in zip(*(batch[c] for c in ("dim", "shard", "tree", "vec_id", "v", "floor")), strict=True):
                if packed is not None:
                    tree, place = KDTree.read(packed), (dim, shard)
                elif place == (dim, shard):
                    out += [(query_id, -i, s) for s, i in tree.search(np.asarray(v), query_id, k, None if pd.isna(floor) else int(floor))]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def whole_vectors(table: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): vectors of whole doubles floor(scale * x); those that take no part are left out."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = table.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: _floor(x * scale)).alias("v"))
    return whole.where(F.forall("v", lambda x: F.abs(x) < float("inf")))


def _floor(x: Column) -> Column:
    # floor() goes through long; doubles of 2**52 and more are whole as they are
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def search(rows: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query. Both are (vec_id, v) as of :func:`whole_vectors`."""
    rows = materialise(rows.withColumn("dim", F.size("v")).where("dim > 0"))
    asked = materialise(queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")).where("dim > 0"))
    components = rows.agg(F.sum("dim")).first()[0] or 0
    shards = max(1, -(-components // SHARD) if shard_rows is None else -(-rows.count() // shard_rows))
    # rows of one id may be many: the vector deals them as well
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
    trees = materialise(dealt.groupBy("dim", "shard").applyInPandas(_build, "dim int, shard int, tree binary, low array<double>, high array<double>"))
    # few trees meet in a partition, and so in a batch
    spark_partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tree_rows = trees.select("dim", "shard", "tree", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("v"), F.lit(None).cast("double").alias("floor"))

    def visit(sides: DataFrame) -> DataFrame:
        both = tree_rows.unionByName(sides.select("dim", "shard", F.lit(None).cast("binary").alias("tree"), "vec_id", "v", "floor"))
        sorted_ = both.repartition(max(shards, spark_partitions), "dim", "shard").sortWithinPartitions("dim", "shard", F.col("tree").isNull())
        return sorted_.mapInPandas(_search_all(k), FOUND)

    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    first = materialise(visit(asked.withColumns({"shard": home, "floor": F.lit(None).cast("double")})))
    if shards == 1:
        found = first
    else:
        floors = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").cast("double").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).drop("n")
        boxes = trees.select("dim", "shard", "low", "high")
        bound = F.aggregate(F.zip_with("v", F.arrays_zip("low", "high"), lambda x, b: F.greatest(x * b["low"], x * b["high"])), F.lit(0.0), lambda a, x: a + x)
        # doubles may round a sum of large products: a box is passed over only well below the floor
        worth = (F.col("shard") != home) & (F.col("floor").isNull() | (bound >= F.col("floor") - F.abs("floor") * 1e-6 - 1))
        floored = asked.join(floors, "vec_id", "left")
        if trees.agg(F.sum(F.size("low") * 16)).first()[0] <= BOXES:
            # boxes are looked at where the query is: only pairs that are worth a visit leave the task
            others = floored.join(F.broadcast(boxes), "dim").where(worth)
        else:
            others = floored.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(boxes, ["dim", "shard"]).where(worth)
        others = others.drop("low", "high")
        found = first.unionByName(visit(others))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(table: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    rows = whole_vectors(table)
    return search(rows, rows.where(F.col("vec_id") % every == 0), k)
