"""Mixing sources to target weights by temperature.

Source token shares are raised to an exponent and normalised. The exponent is
found by bisection: the largest (closest to the natural shares) at which the
mixture reaches a target entropy (given as it is, or as how far it lies on the way
from the natural shares' to the largest one), or the smallest (flattest) at which
no source is passed over more than a repetition limit. The weights are then realised
under a token budget: each source is a sequence of random permutations of its
documents (blocks), taken whole as often as the budget allows and cut in the
last one where the budget ends. :func:`block_permutations` gives the sequence
itself, one row for each time that a document is taken, with its block and its
position there; :func:`mix` gives the documents with how often they are taken.

Tokens are counted once and written. Only per-source totals (one row a source, at
most ``MAX_SOURCES``) reach the driver. A block is ordered in random buckets of
about ``bucket_rows`` rows, so a source with a third of all rows never lies in one
task; the buckets' sums, a thousandth of the rows, give where each starts.

Nulls and oddities: a null source is a source of its own; null or empty texts
have no tokens, pass with their source's whole blocks and cost no budget; all
sources without tokens: every row once. Repeated rows are separate documents.
An empty table gives an empty result. Columns named like the operator's own are
replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

MAX_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def shares(tokens: dict, alpha: float) -> dict:
    """Normalised tokens ** alpha; sources without tokens have no weight."""
    top = max(tokens.values(), default=0)
    raised = {s: (n / top) ** alpha if n else 0.0 for s, n in tokens.items()}
    total = sum(raised.values())
    return {s: x / total if total else 0.0 for s, x in raised.items()}


def entropy(weights: dict) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def passes(tokens: dict, weights: dict, budget: float | None) -> dict:
    """Times that each source is passed over. Without a budget, the smallest one at which each source is passed once."""
    used = {s: n for s, n in tokens.items() if n}
    if budget is None:
        budget = max((n / weights[s] for s, n in used.items() if weights[s] > 0), default=0.0)
    return {s: weights[s] * budget / n for s, n in used.items()}


def bisect_exponent(tokens: dict, target_entropy: float | None = None, repetition_limit: float | None = None, budget: float | None = None, rounds: int = 60) -> float:
    """The exponent in [0, 1]. 1 keeps the natural shares, 0 gives equal ones."""
    if (target_entropy is None) == (repetition_limit is None):
        raise ValueError("give either a target entropy or a repetition limit")
    if target_entropy is not None:
        fits = lambda a: entropy(shares(tokens, a)) >= target_entropy
        low, high = 0.0, 1.0
        if fits(high):
            return high
        for _ in range(rounds):  # low fits (or nothing does), high doesn't
            mid = (low + high) / 2
            low, high = (mid, high) if fits(mid) else (low, mid)
        return low
    fits = lambda a: max(passes(tokens, shares(tokens, a), budget).values(), default=0.0) <= repetition_limit * (1 + 1e-12)
    low, high = 0.0, 1.0
    if fits(low):
        return low
    for _ in range(rounds):  # high fits (or nothing does), low doesn't
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def entropy_on_the_way(tokens: dict, share: float) -> float:
    """The entropy that lies at ``share`` between that of the natural shares (0) and that of equal ones (1)."""
    used = [n for n in tokens.values() if n]
    natural = entropy(shares(tokens, 1.0))
    return natural + share * (math.log(len(used)) - natural) if used else 0.0


class Plan:
    """What the totals decide: ``held`` (doc_id, source, n_tokens, draw of every row, written) and ``sources``, one broadcast row each."""

    def __init__(self, docs: DataFrame, target_entropy: float | None, repetition_limit: float | None, budget: float | None, budget_share: float | None, seed: int, bucket_rows: int, entropy_share: float | None = None):
        self.held = materialise(docs.select("doc_id", "source", counted(F.col("text")).alias("n_tokens"), _draw(seed).alias("draw")))
        totals = self.held.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).limit(MAX_SOURCES + 1).collect()
        if len(totals) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        tokens = {r["source"]: r["tokens"] for r in totals}
        if budget_share is not None:
            budget = budget_share * sum(tokens.values())
        if entropy_share is not None:
            target_entropy = entropy_on_the_way(tokens, entropy_share)
        self.alpha = bisect_exponent(tokens, target_entropy, repetition_limit, budget)
        weights = shares(tokens, self.alpha)
        times = passes(tokens, weights, budget)
        rows = []
        for i, r in enumerate(sorted(totals, key=lambda r: (r["source"] is not None, r["source"]))):
            n = float(times.get(r["source"], 1.0))
            whole = math.floor(n + 1e-9)
            rows.append((i, r["source"], weights[r["source"]], whole, (n - whole) * r["tokens"], max(1, -(-r["rows"] // bucket_rows))))
        self.sources = F.broadcast(docs.sparkSession.createDataFrame(rows, "_number int, _source string, weight double, _whole int, _cut double, _buckets long"))

    def with_sources(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    def starts(self, copies: DataFrame) -> DataFrame:
        """Where each bucket of a block starts, in rows and tokens; written."""
        sums = copies.groupBy("_number", "block", "_bucket").agg(F.count(F.lit(1)).alias("_rows"), F.sum("n_tokens").alias("_tokens"))
        before = Window.partitionBy("_number", "block").orderBy("_bucket")
        return materialise(sums.select("_number", "block", "_bucket", (F.sum("_rows").over(before) - F.col("_rows")).alias("_first"), (F.sum("_tokens").over(before) - F.col("_tokens")).alias("_before"), "_tokens"))


def counted(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(seed: int):
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def _place(draw: str, block):
    """A document's place in a block's permutation: its bucket, and the order there."""
    turn = F.xxhash64(draw, block)
    return F.pmod(turn, F.col("_buckets")), turn


def block_permutations(docs: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None, budget: float | None = None, budget_share: float | None = None, seed: int = 11, bucket_rows: int = 2_000, entropy_share: float | None = None) -> DataFrame:
    """doc_id, source, n_tokens, weight, block and position: one row for each time that a document is taken.

    The budget is in tokens, or as a share of all tokens; without one it is the smallest at which each source is passed
    once. A block's positions are 0, 1, 2, ...; a source's last block ends before the document that would exceed its budget."""
    plan = Plan(docs, target_entropy, repetition_limit, budget, budget_share, seed, bucket_rows, entropy_share)
    last = F.col("_whole") - F.when(F.col("_cut") > 0, 0).otherwise(1)
    copies = plan.with_sources(plan.held).where(last >= 0).withColumn("block", F.explode(F.sequence(F.lit(0), last)))
    bucket, turn = _place("draw", F.col("block"))
    copies = copies.withColumns({"_bucket": bucket, "_turn": turn})
    inside = Window.partitionBy("_number", "block", "_bucket").orderBy("_turn", "doc_id")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = copies.withColumns({"_at": F.row_number().over(inside), "_used": F.sum("n_tokens").over(running)})
    # the buckets' starts have the rows' partitioning already
    placed = placed.join(plan.starts(copies).drop("_tokens"), ["_number", "block", "_bucket"])
    taken = placed.where((F.col("block") < F.col("_whole")) | (F.col("_before") + F.col("_used") <= F.col("_cut")))
    return taken.select("doc_id", "source", "n_tokens", "weight", "block", (F.col("_first") + F.col("_at") - 1).alias("position"))


def mix(docs: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None, budget: float | None = None, budget_share: float | None = None, seed: int = 11, bucket_rows: int = 2_000, entropy_share: float | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, ``weight`` and ``copies``: in how many blocks of :func:`block_permutations` the document is taken.

    Documents taken in no block (only with a budget below the one of ``passes``)
    are left out. Expand with ``explode(sequence(1, copies))`` for one row a copy."""
    plan = Plan(docs, target_entropy, repetition_limit, budget, budget_share, seed, bucket_rows, entropy_share)
    own = ("n_tokens", "weight", "copies", "_draw", "_number", "_source", "_whole", "_cut", "_buckets", "_bucket", "_turn", "_edge", "_before", "_of")
    base = docs.drop(*[c for c in docs.columns if c.lower() in own])
    bucket, turn = _place("draw", F.col("_whole"))
    partial = plan.with_sources(plan.held).where("_cut > 0").withColumn("block", F.col("_whole")).withColumn("_bucket", bucket)
    # only the bucket that holds the cut is ordered row by row; no other needs more than its sums
    edge = plan.starts(partial).join(plan.sources.select("_number", "_cut"), "_number").where("_before <= _cut and _before + _tokens > _cut")
    edge = edge.groupBy(F.col("_number").alias("_of")).agg(F.min("_bucket").alias("_edge"), F.min("_before").alias("_before"))  # at most one row a source
    held = plan.with_sources(base.withColumns({"n_tokens": counted(F.col("text")), "_draw": _draw(seed)}))
    bucket, turn = _place("_draw", F.col("_whole"))
    held = held.withColumns({"_bucket": bucket, "_turn": turn}).join(F.broadcast(edge), F.col("_number") == F.col("_of"), "left")
    columns = [c for c in held.columns if not c.startswith("_") or c in base.columns]
    at_edge = F.coalesce(F.col("_bucket") == F.col("_edge"), F.lit(False))
    running = F.sum("n_tokens").over(Window.partitionBy("_number").orderBy("_turn", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = held.where(at_edge).withColumn("copies", F.col("_whole") + F.when(F.col("_before") + running <= F.col("_cut"), 1).otherwise(0))
    # without an edge the cut lies behind all buckets, or there is none
    more = F.when(F.col("_cut") <= 0, False).when(F.col("_edge").isNull(), True).otherwise(F.col("_bucket") < F.col("_edge"))
    outer = held.where(~at_edge).withColumn("copies", F.col("_whole") + F.when(more, 1).otherwise(0))
    return taken.unionByName(outer).where("copies > 0").select(*columns, F.col("copies").cast("int").alias("copies"))
