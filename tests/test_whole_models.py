"""Models are registered at the operators' default sizes, and grow the same trees wherever their nodes are grown."""

import inspect

import numpy as np
import pytest

from otflow.operators import ml as ML
from otflow.operators import trees as T
from otflow.plans import models

SCHEMA = "row_id long, a double, b double, c double, label int"


@pytest.fixture(scope="module")
def table(spark):
    a, b, c, u = np.random.default_rng(4).random((4, 4000))
    rows = [(i, *map(float, v), int((v[0] > 0.5) != (v[1] > 0.3)) if w < 0.8 else int(w < 0.9)) for i, (*v, w) in enumerate(zip(a, b, c, u, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def deepest(model):
    return max(int(np.flatnonzero(f >= 0).max() + 1).bit_length() for f in model.feature)


def test_boosted_trees_have_all_rounds(spark, monkeypatch):
    """Not fitted: 1,200 levels are a job each."""
    asked = []

    def fit(*a, **how):
        asked.append(inspect.signature(T.fit_boosted).bind(*a, **how))
        asked[0].apply_defaults()
        return T.Trees(models.NAMES, "xgb", [[]] * len(models.NAMES), 1)

    monkeypatch.setattr(ML, "fit_boosted", fit)
    assert models.boosted(spark, "/root/testdata/sf0.001").count() == 6000
    assert (asked[0].arguments["rounds"], asked[0].arguments["depth"], asked[0].arguments["share"]) == (200, 6, 0.8)


def test_random_forest_has_all_trees(spark, monkeypatch):
    found, fit = [], ML.fit_forest
    monkeypatch.setattr(ML, "fit_forest", lambda *a, **how: found.append(fit(*a, **how)) or found[-1])
    out = models.forest(spark, "/root/testdata/sf0.001")
    assert out.count() == 6000
    assert len(found[0].feature) == 200 and found[0].depth == 15 and deepest(found[0]) > 8
    assert all((f >= 0).any() for f in found[0].feature)


def same(one, other):
    assert all((a == b).all() for k in ("feature", "cut") for a, b in zip(getattr(one, k), getattr(other, k), strict=True))
    assert all(np.allclose(a, b) for k in ("value", "gains") for a, b in zip(getattr(one, k), getattr(other, k), strict=True))


def test_trees_are_the_same_however_nodes_are_dealt_out(table, monkeypatch):
    held = T.cells(*T.prepared(table, ["a", "b", "c"]))
    how = {"trees": 3, "depth": 8, "held": held}
    whole = T.fit_forest(table, ["a", "b", "c"], **how)
    assert deepest(whole) > 6
    for local, nodes in ((300, 7), (40, 4096), (0, 50)):  # some nodes, most nodes and all nodes by passes
        monkeypatch.setattr(T, "LOCAL", local)
        monkeypatch.setattr(T, "NODES", nodes)
        same(T.fit_forest(table, ["a", "b", "c"], **how), whole)


def test_boosting_goes_on_from_written_scores(table, monkeypatch):
    held = T.cells(*T.prepared(table, ["a", "b", "c"]))
    how = {"rounds": 7, "depth": 3, "held": held}
    whole = T.fit_boosted(table, ["a", "b", "c"], **how)
    assert len(whole.feature) == 7 and all((f >= 0).any() for f in whole.feature)
    monkeypatch.setattr(T, "ROUNDS", 3)
    monkeypatch.setattr(T, "PARTS", 1)
    same(T.fit_boosted(table, ["a", "b", "c"], **how), whole)


def test_a_subtree_agrees_with_counting():
    rng = np.random.default_rng(8)
    x, weight, y = rng.integers(0, T.BINS, (5, 300)).astype(np.uint8), rng.integers(1, 4, 300).astype(float), rng.integers(0, 2, 300).astype(float)
    feature, cut, value, _ = T._subtree(x, weight, y, 3, 6, 6, 2, 42)  # node 6: four levels left

    def check(own, at, node):
        n, s = weight[own].sum(), (weight * y)[own].sum()
        assert np.isclose(value[at], s / n)
        if at >= 15:
            return
        found = [(-1.0, 0, 0)]
        for f in T.subsets_of(42, np.array([3]), np.array([node]), 5, 2)[0]:
            for c in range(T.BINS - 1):
                sides = [own & (x[f] <= c), own & (x[f] > c)]
                if all(side.any() for side in sides):
                    found.append((sum((weight * y)[side].sum() ** 2 / weight[side].sum() for side in sides) - s * s / n, f, c))
        gain = max(found)[0]
        if gain <= 1e-9 * max(1.0, n):
            assert feature[at] == -1
            return
        assert any(np.isclose(g, gain) and (f, c) == (feature[at], cut[at]) for g, f, c in found)
        goes = x[feature[at]] <= cut[at]
        check(own & goes, 2 * at + 1, 2 * node + 1)
        check(own & ~goes, 2 * at + 2, 2 * node + 2)

    check(np.ones(300, bool), 0, 6)


def test_copies_of_rows_are_one_cell(spark):
    rows = [(i, float(i % 3), float("nan") if i % 2 else None, float(i % 5), int(i % 4 == 0)) for i in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA)
    cuts, packs = T.cells(*T.prepared(df, ["a", "b", "c"]))
    held = [(tuple(v), y, n) for r in packs.collect() for v, y, n in zip(np.frombuffer(r.x, np.uint8).reshape(3, -1).T.tolist(), r.y, np.frombuffer(r.n, np.int64).tolist(), strict=True)]
    assert len(held) == len({h[:2] for h in held}) == 30 and sum(n for *_, n in held) == 6000  # 15 rows of bins, labels of both kinds
    assert sum(y * n for _, y, n in held) == 1500


def test_wide_rows_keep_their_bins():
    x = np.random.default_rng(1).integers(0, T.BINS, (30, 100)).astype(np.uint8)
    words = T.words_of(x)
    words[0] |= np.int64(1) << T.LABEL
    assert len(words) == 3 and (T.bins_in(words, 30) == x).all()


def test_draws_of_cells_are_those_of_their_rows():
    n = np.repeat([1, 5, 300], 20_000)
    for got, mean, variance in ((T.times(n, 11, 3), n, n), (T.chosen(n, 11, 3, 0.8), 0.8 * n, 0.16 * n)):
        for k in range(0, 60_000, 20_000):
            own = got[k : k + 20_000]
            assert abs(own.mean() / mean[k] - 1) < 0.02 and abs(own.var() / variance[k] - 1) < 0.05


def test_scores_by_cell_are_those_of_rows_and_are_saved(spark, table, tmp_path):
    for model in (ML.fit_forest(table, ["a", "b", "c"], trees=4, depth=6), ML.fit_boosted(table, ["a", "b", "c"], rounds=4, depth=3)):
        out = model.transform(table.unionByName(table)).orderBy("row_id").toPandas()
        sums = model.sums(np.ascontiguousarray(T.bins_of(out[["a", "b", "c"]].to_numpy(), model.cuts).T))
        assert len(out) == 8000 and np.allclose(out[f"{model.name}_p"], sums if model.name == "rf" else 1 / (1 + np.exp(-2 * sums)))
        model.save(spark, f"{tmp_path}/{model.name}")
        same(T.Trees.load(spark, f"{tmp_path}/{model.name}"), model)
