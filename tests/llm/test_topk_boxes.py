"""Top-k with the boxes broadcast and joined by a shuffle."""

import numpy as np
import pytest

from otflow.llm import topk_search as T


@pytest.mark.parametrize("bound", [T.BOXES, -1])
def test_shards_give_the_best_of_all_rows(spark, monkeypatch, bound):
    monkeypatch.setattr(T, "BOXES", bound)
    draw = np.random.default_rng(4)
    vectors = {i: draw.integers(-9, 9, 3 if i % 5 else 2).astype(float) for i in range(150)}
    table = spark.createDataFrame([(i, [float(x) / 1024 for x in v]) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    rows = T.whole_vectors(table)
    got = sorted(tuple(r) for r in T.search(rows, rows.where("vec_id % 10 = 0"), 4, shard_rows=40).collect())
    want = []
    for q in range(0, 150, 10):
        scores = sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))[:4]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scores, 1)]
    assert got == sorted(want)
