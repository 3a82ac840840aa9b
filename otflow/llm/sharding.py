"""Sharding: a uniform shuffle with exact shard sizes.

The rows of each input partition are dealt to shards by a communication matrix
whose rows are drawn from the multivariate hypergeometric law, the law that a
uniform permutation of all rows induces on the counts. Each partition permutes
its rows locally and cuts the permutation by its matrix row; the exchange moves
whole rows; a second random order inside each shard gives the slots. Shard
counts differ by at most one row (law ``rows``).

The matrix has partitions x shards integers and is the only thing the driver
holds. A shard is ordered in blocks of about ``block_rows`` rows, so no task
ever holds a whole shard.

Nulls and oddities: a null text has 0 bytes and CRC 0; a null doc_id is a row
like any other; repeated rows are dealt one by one. An empty table gives an
empty result. Columns named like the operator's own are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

_ROW_BITS = 33  # of monotonically_increasing_id


def communication_matrix(counts: dict[int, int], shards: int, seed: int) -> dict[int, np.ndarray]:
    """Rows of each partition for each shard: exact row and column sums, hypergeometric law."""
    total = sum(counts.values())
    left = np.full(shards, total // shards, np.int64)
    left[: total % shards] += 1
    rng, out = np.random.default_rng(seed), {}
    for part in sorted(counts):
        out[part] = _draw(rng, left, counts[part])
        left -= out[part]
    return out


def _draw(rng, left: np.ndarray, n: int) -> np.ndarray:
    """Multivariate hypergeometric by conditional univariate draws."""
    got, rest, todo = np.zeros_like(left), int(left.sum()), n
    for s, have in enumerate(left.tolist()):
        rest -= have
        take = have if rest == 0 and todo >= have else _one(rng, have, rest, todo)
        got[s], todo = take, todo - take
    return got


def _one(rng, good: int, bad: int, n: int) -> int:
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    return large_draw(rng.random(), good, bad, n)


def large_draw(u: float, good: int, bad: int, n: int) -> int:
    """The hypergeometric draw of a uniform ``u``, for totals beyond numpy's range: the law's weights are built outward from its
    mode by their exact ratios, over all counts within 40 deviations (beyond lies less than a double can tell)."""
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    spread = int(40 * np.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1)))) + 40
    up = np.arange(mode, min(high, mode + spread), dtype=float)
    down = np.arange(mode, max(low, mode - spread), -1, dtype=float)
    above = np.cumprod((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)))
    below = np.cumprod(down * (bad - n + down) / ((good - down + 1) * (n - down + 1)))
    weights = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    return mode - len(below) + int(np.searchsorted(weights, u * weights[-1], side="right"))


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 7, block_rows: int = 2_000) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, 2, ... within the shard).

    A DataFrame that isn't a plain scan should be written first, since its rows
    are visited twice and must lie in the same partitions both times; if they
    don't, the query fails instead of giving wrong sizes. So that they do for a
    scan, ``spark.sql.files.minPartitionNum`` is set where the session has none."""
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.files.minPartitionNum", None) is None:
        # else the cut of files into partitions follows the executors alive, which may change between the two passes
        conf.set("spark.sql.files.minPartitionNum", docs.sparkSession.sparkContext.defaultParallelism)
    clash = [c for c in docs.columns if c.lower() in ("shard", "slot", "_at", "_key", "_block", "_first")]
    tagged = docs.drop(*clash).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", _ROW_BITS)
    counts = {r[0]: r[1] for r in tagged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    matrix = docs.sparkSession.sparkContext.broadcast({p: row.astype(np.int64) for p, row in communication_matrix(counts, shards, seed).items()})

    @F.pandas_udf("int")
    def deal(at: pd.Series) -> pd.Series:
        parts, index = at.to_numpy() >> _ROW_BITS, at.to_numpy() & ((1 << _ROW_BITS) - 1)
        out = np.empty(len(at), np.int32)
        for p in np.unique(parts):
            if p not in dealt:
                dealt.clear()
                row = matrix.value[int(p)]
                dealt[p] = np.random.default_rng([seed, int(p)]).permutation(np.repeat(np.arange(len(row), dtype=np.int32), row))
            here = parts == p
            if index[here].max() >= len(dealt[p]):
                raise RuntimeError("the partitions of the input changed between two passes; write it first")
            out[here] = dealt[p][index[here]]
        return pd.Series(out)

    dealt: dict = {}
    total = sum(counts.values())
    blocks = max(1, -(-total // (shards * block_rows)))
    key = F.xxhash64(F.lit(seed), "_at")
    block = F.pmod(F.shiftright(key, 8), F.lit(blocks)).cast("int")
    placed = tagged.withColumns({"shard": deal("_at"), "_key": key, "_block": block})
    sizes = tagged.select("_at").select(deal("_at").alias("shard"), block.alias("_block")).groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("n"))
    firsts = materialise(sizes.select("shard", "_block", (F.sum("n").over(Window.partitionBy("shard").orderBy("_block")) - F.col("n")).alias("_first")))
    inside = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_key", "_at"))
    return placed.withColumn("slot", inside).join(firsts, ["shard", "_block"]).withColumn("slot", F.col("_first") + F.col("slot") - 1).drop("_at", "_key", "_block", "_first")


def shard_digest(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document, from :func:`shard_rows`."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    dealt = shard_rows(docs.select("doc_id", "text"), shards, seed)
    return dealt.select("doc_id", (F.length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
