"""A task's share of a table stays the same however large the table is."""

from otflow import catalog
from otflow.operators import ml as ML
from otflow.operators.ordered import spread, written
from otflow.plans import models


def test_parts_hold_a_bounded_number_of_rows(spark):
    df = spark.range(40_000).selectExpr("id div 2 as k", "id")
    parts = spread(df, "k", rows=1_000).groupBy("k").count()
    assert parts.count() == 20_000
    sizes = spread(df, "k", rows=1_000).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 40 and max(sizes) < 2_000


def test_joins_of_flows_keep_their_spread(spark):
    for name in ("join_features_labels", "win_top_features"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "REPARTITION_BY_NUM" in plan


def test_models_read_a_written_table(spark):
    df = models.training(spark, "/root/testdata/sf0.001")
    assert "lineitem" not in df.inputFiles()[0] and df.count() == 6000
    assert written(spark.range(3)).count() == 3


def test_trees_train_on_parts_of_bounded_size(spark):
    df = spark.range(9_000).selectExpr("id", "cast(id % 7 as double) as a", "cast(id % 2 as int) as label").coalesce(1)
    parts = ML.dealt(df, ["a"], "label", rows=1_000)
    sizes = parts.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 9 and max(sizes) < 1_500 and sum(sizes) == 9_000
    assert ML.dealt(df, ["a"], "label").rdd.getNumPartitions() == 1
