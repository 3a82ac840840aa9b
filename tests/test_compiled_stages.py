"""Wide feature stages run in methods that the JVM compiles."""

from otflow import catalog
from otflow.plans.flows import features

HUGE = "spark.sql.codegen.hugeMethodLimit"


def test_feature_tables_leave_no_method_uncompiled(spark):
    spark.conf.unset(HUGE)
    catalog.QUERIES["feat_all_v2"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(HUGE)) <= 8000
    spark.conf.unset(HUGE)
    before = sorted(map(tuple, features(spark, "/root/testdata/sf0.001").limit(0).collect()))
    assert before == [] and int(spark.conf.get(HUGE)) <= 8000
