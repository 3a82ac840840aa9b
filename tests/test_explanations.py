"""Contributions to an isolation forest's path length against Shapley values over all subsets."""

import itertools
import math

import numpy as np
import pytest

from otflow.operators import ml as ML


def value(tree, x, known, at=0, depth=0):
    """Path length if only ``known`` features are seen: other turns are averaged by the training rows."""
    feature, cut, left, right, size = tree
    if feature[at] < 0:
        return depth + ML.expected_path(size[at])
    if feature[at] in known:
        return value(tree, x, known, left[at] if x[feature[at]] < cut[at] else right[at], depth + 1)
    return sum(size[c] / size[at] * value(tree, x, known, c, depth + 1) for c in (left[at], right[at]))


def shapley(tree, x):
    d = len(x)
    out = np.zeros(d)
    for i in range(d):
        for k in range(d):
            for some in itertools.combinations([j for j in range(d) if j != i], k):
                weight = math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)
                out[i] += weight * (value(tree, x, {*some, i}) - value(tree, x, set(some)))
    return out


@pytest.mark.parametrize(("features", "rows"), [(1, 20), (3, 40), (5, 64)])
def test_exact_on_small_trees(features, rows):
    draw = np.random.default_rng(features)
    trees = [tuple(np.array(c) for c in zip(*ML._grow(draw.normal(size=(rows, features)), draw), strict=True)) for _ in range(4)]
    x = draw.normal(size=(6, features)) * 1.5
    got = ML.path_contributions(trees, x)
    want = np.mean([[shapley(t, row) for row in x] for t in trees], axis=0)
    assert np.allclose(got, want)
    whole = np.mean([[value(t, row, set(range(features))) - value(t, row, set()) for row in x] for t in trees], axis=0)
    assert np.allclose(got.sum(1), whole)


def test_every_row_is_ranked(spark):
    rows = [(i, float(i % 10), float(i * 7 % 13), None if i == 5 else 1.0) for i in range(200)] + [(1000, 60.0, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, same double")
    model = ML.fit_isolation_forest(df.fillna(0.0), ["a", "b", "same"], trees=20, psi=64)
    out = ML.explain(model, df, 2).collect()
    assert len(out) == 2 * 201 and {r["rank"] for r in out} == {1, 2}
    far = [r for r in out if r.row_id == 1000]
    assert far[0].feature == "a" and far[0]["rank"] == 1 and far[0].direction == "toward anomaly" and far[0].contribution < 0
    parts = {r.row_id: sum(r.contributions) for r in ML.contributions(model, df).collect()}
    scores = {r.row_id: -math.log2(-r.iso_score) for r in model.score(df).collect()}  # path in units of the expected one
    offsets = [scores[i] - parts[i] for i in parts]
    assert max(offsets) - min(offsets) < 1e-9


def test_cells_turn_as_their_rows_do():
    draw = np.random.default_rng(1)
    trees = [ML._grow(draw.normal(size=(64, 7)), draw) for _ in range(30)]
    cells = ML.Cells(trees, 7)
    cuts = np.array([n[1] for t in trees for n in t if n[0] >= 0])
    x = np.concatenate([draw.normal(size=(200, 7)) * 2, np.full((1, 7), np.inf), np.full((1, 7), -np.inf), np.full((1, 7), np.nan), draw.choice(cuts, (50, 7))])
    y = cells.values(list(cells.pack(x)))
    for tree in trees:
        for feature, cut, *_ in tree:
            assert feature < 0 or ((x[:, feature] < cut) == (y[:, feature] < cut)).all()


def test_copies_are_explained_once_and_counted(spark):
    rows = [(i, float(i % 10), float(i * 7 % 13), i % 3 % 2) for i in range(1300)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, label int")
    model = ML.fit_isolation_forest(df, ["a", "b"], trees=20, psi=64)
    held = ML.Cells(model.trees, 2)
    assert model.placed(df, held).select(*held.names).distinct().count() <= 130
    slow = {(r.feature, r.label): r.mean_abs for r in ML.global_attribution(ML.explain(model, df, 2, ("row_id", "label")), ("label",)).collect()}
    fast = {(r.feature, r.label): r.mean_abs for r in ML.attribution(model, df, ("label",)).collect()}
    assert slow.keys() == fast.keys() and all(abs(slow[k] - fast[k]) < 1e-9 for k in slow)
    scores = sorted(r.iso_score for r in model.score(df).collect())
    assert len(scores) == 1300 and model.threshold == scores[129] == model.quantile(df, 0.1)
