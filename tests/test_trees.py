"""Forests and boosted trees from counts of bins."""

import numpy as np
from pyspark.sql import functions as F

from otflow.operators import ml as ML
from otflow.operators import trees as T

SCHEMA = "row_id long, a double, b double, label int"


def crossed(n=4000, seed=1):
    """Label is 1 where just one of two values is above a half."""
    a, b = np.random.default_rng(seed).random((2, n))
    return [(i, float(x), float(y), int((x > 0.5) != (y > 0.5))) for i, (x, y) in enumerate(zip(a, b, strict=True))]


def test_rows_reach_python_packed(spark):
    df = spark.createDataFrame(crossed(), SCHEMA)
    cuts, rows = T.prepared(df, ["a", "b"])
    held = rows.collect()
    assert len(held) <= df.rdd.getNumPartitions() and sum(len(r.y) for r in held) == 4000
    assert sum(sum(r.y) for r in held) == df.agg(F.sum("label")).first()[0]
    assert all(len(c) < T.BINS for c in cuts)


def test_forest_and_boosting_learn_a_crossing(spark):
    df = spark.createDataFrame(crossed(), SCHEMA)
    new = spark.createDataFrame(crossed(1000, 2), SCHEMA)
    for model, name in ((ML.fit_forest(df, ["a", "b"], trees=5, depth=4), "rf"), (ML.fit_boosted(df, ["a", "b"], rounds=20, depth=3), "xgb")):
        assert model.transform(new).where(F.col(name) == F.col("label")).count() > 950
        assert abs(model.importances().sum() - 1) < 1e-9 and min(model.importances()) > 0.1


def test_a_tree_of_all_rows_agrees_with_counting(spark):
    rows = crossed(3000, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    model = ML.fit_boosted(df, ["a"], rounds=1, depth=1, share=1.0)
    x, y = np.array([r[1] for r in rows]), np.array([2.0 * r[3] - 1 for r in rows])
    at = [(sum(y[s].sum() ** 2 / max(1, s.sum()) for s in (x <= c, x > c)), c) for c in model.cuts[0] if (x > c).any()]
    best = max(at)[1]
    assert model.cuts[0][model.cut[0][0]] == best
    assert np.allclose(model.value[0][1:], [y[x <= best].mean(), y[x > best].mean()])


def test_missing_values_few_values_and_one_class(spark):
    rows = [(i, None if i % 3 == 0 else float(i % 2), float("nan") if i % 5 == 0 else 1.0, int(i % 3 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = ML.fit_forest(df, ["a", "b"], trees=5, depth=2)
    assert model.transform(df).where("rf != label").count() == 0
    alone = ML.fit_forest(df.where("label = 0"), ["a", "b"], trees=2, depth=2)
    assert alone.transform(df).where("rf != 0 or rf_p != 0").count() == 0


def test_isolation_scores_are_those_of_walking_each_row(spark):
    model = ML.IsolationForest(["a", "b"], [ML._grow(np.random.default_rng(k).random((64, 2)), np.random.default_rng(k)) for k in range(7)], 64)
    rows = [(i, float(a), float(b), 0) for i, (a, b) in enumerate(np.random.default_rng(9).random((300, 2)) * 1.4 - 0.2)]
    for r in model.score(spark.createDataFrame(rows, SCHEMA)).collect():
        total = 0.0
        for tree in model.trees:
            at, steps = 0, 0
            while tree[at][0] >= 0:
                at, steps = tree[at][2] if (r.a, r.b)[tree[at][0]] < tree[at][1] else tree[at][3], steps + 1
            total += steps + ML.expected_path(tree[at][4])
        assert r.iso_score == -(2.0 ** (-(total / 7) / ML.expected_path(64)))
    nodes = ML._walk(tuple(np.array(c) for c in zip(*model.trees[0], strict=True)))
    assert nodes[4] <= 6 and len(nodes[2]) == 2 * len(model.trees[0])


def test_draws_are_those_of_their_distributions():
    z = np.concatenate([T.draws(number, 50_000, 3) for number in (5, 6)])
    counts = np.bincount(T.POISSON[z], minlength=4) / len(z)
    assert np.allclose(counts[:4], [0.3679, 0.3679, 0.1839, 0.0613], atol=0.01)
    assert abs(np.corrcoef(T.draws(5, 50_000, 3), T.draws(5, 50_000, 4))[0, 1]) < 0.02
