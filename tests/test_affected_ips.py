"""Addresses by pattern, from marks that rows of one id share, without a join of the rows."""

import pytest
from otflow import catalog
from otflow.operators import detectors as D
from otflow.operators import enrich as E
from otflow.plans import flows as Q
from pyspark.sql import functions as F

NAMES = ["first", "second"]


def test_rows_of_one_id_share_their_marks(spark):
    rows = [(1, "b", "x", 1), (1, "a", "x", 2), (2, "c", None, 2), (3, "d", "y", 0), (None, "e", "z", 3), (4, "f", "y", 1), (4, "f", "y", 1)]
    got = E.affected_ips(spark.createDataFrame(rows, "row_id long, sIPs string, rIPs string, marks long"), NAMES, 3).collect()
    assert {tuple(r) for r in got} == {("first", 5, "a,b,f"), ("second", 4, "a,b,c")}
    assert not E.affected_ips(spark.createDataFrame([], "row_id long, sIPs string, rIPs string, marks long"), NAMES).collect()


def test_marks_are_the_detections(spark):
    held = Q.features(spark, "/root/testdata/sf0.001")
    marks, names = D.marks(held, Q.T)
    each = held.select("row_id", F.explode(F.array_compact(F.array(*[F.when(F.getbit(marks, F.lit(k)) == 1, n) for k, n in enumerate(names)]))).alias("pattern"))
    found = D.detect(held, Q.T).select("row_id", "pattern")
    assert each.count() and not each.exceptAll(found).count() and not found.exceptAll(each).count()
    with pytest.raises(ValueError):
        D.marks(held, Q.T, D.DETECTORS * 7)


def test_rows_are_exchanged_once_and_not_joined(spark, capsys):
    catalog.QUERIES["agg_affected_ips"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and plan.count("hashpartitioning(row_id") == 1
