"""The exponent of the mixture against a search of its own."""

import math
import random

import pytest

from otflow.llm import entry, mixing


def flattened(tokens, a):
    used = [n for n in tokens.values() if n]
    raised = [math.exp(a * (math.log(n) - math.log(max(used)))) for n in used]
    return [x / math.fsum(raised) for x in raised]


def spread(weights):
    return -math.fsum(w * math.log(w) for w in weights)


def scanned(good, falling):
    """The end of the exponents in [0, 1] that are good, by grids ten times finer each time."""
    low, high = 0.0, 1.0
    for _ in range(12):
        grid = [low + (high - low) * k / 10 for k in range(11)]
        ok = [a for a in grid if good(a)]
        if not ok:
            return None
        edge = max(ok) if falling else min(ok)
        low, high = (edge, min(high, edge + (high - low) / 10)) if falling else (max(low, edge - (high - low) / 10), edge)
    return edge


@pytest.mark.parametrize("seed", range(8))
def test_bisection_finds_the_end_of_what_fits(seed):
    draw = random.Random(seed)
    tokens = {f"s{i}": draw.choice([0, 1, draw.randrange(1, 10**6), draw.randrange(1, 100)]) for i in range(draw.randrange(2, 30))} | {"large": 10**7, "small": 50}
    used = [n for n in tokens.values() if n]
    for share in (0.1, 0.5, 0.9):
        target = spread(flattened(tokens, 1.0)) * (1 - share) + share * math.log(len(used))
        assert mixing.entropy_on_the_way(tokens, share) == pytest.approx(target)
        found = mixing.bisect_exponent(tokens, target_entropy=target)
        assert 0 < found < 1 and found == pytest.approx(scanned(lambda a: spread(flattened(tokens, a)) >= target, True), abs=1e-6)  # noqa: B023
    budget = 1.25 * sum(used)
    for limit in (2.0, 50.0):
        passes = lambda a: max(w * budget / n for w, n in zip(flattened(tokens, a), used, strict=True))
        want = scanned(lambda a: passes(a) <= limit, False)  # noqa: B023
        assert mixing.bisect_exponent(tokens, repetition_limit=limit, budget=budget) == pytest.approx(1.0 if want is None else want, abs=1e-6)


def test_weights_of_the_registered_share(spark):
    sizes = {"a": 900, "b": 90, None: 10, "empty": 0}
    docs = spark.createDataFrame([(i, f"{s}", "w " * 10 if n else "") for s, n in sizes.items() for i in range(max(1, n // 10))], "doc_id long, source string, text string")
    out = mixing.block_permutations(docs, budget_share=entry.MIXED, entropy_share=entry.EVENED)
    got = {r["source"]: r["weight"] for r in out.select("source", "weight").distinct().collect()}
    weights = [got[str(s)] for s in ("a", "b", None)]
    natural = spread([0.9, 0.09, 0.01])
    assert spread(weights) == pytest.approx((natural + math.log(3)) / 2, abs=1e-6) and got["empty"] == 0
    taken = {r["source"]: r["n"] for r in out.groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert all(abs(taken[str(s)] - w * 1250) <= 10 for s, w in zip(("a", "b", None), weights, strict=True))
