"""Slices of heavy keys: the same windows as over whole keys."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from otflow.operators.ordered import sliced

SCHEMA = "k string, t double, id long, v long"


def made(seed=1):
    draw = random.Random(seed)
    rows = [("hot", float(draw.randrange(1000)), i, draw.randrange(9)) for i in range(900)]
    rows += [("tied", 5.0, i, 1) for i in range(900, 1300)] + [(None, float(i % 7), i, 2) for i in range(1300, 1500)]
    return rows + [(f"k{i % 40}", float(draw.randrange(50)), i, 3) for i in range(1500, 1700)]


@pytest.mark.parametrize("keys", [["k"], []])
def test_led_and_carried(spark, keys):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    s = sliced(df, keys, "t", "id", rows=60)
    assert s.heavy
    sizes = s.df.groupBy(*keys, "_slice").count()
    assert sizes.agg(F.max("count")).first()[0] <= 160 and s.df.count() == len(rows)
    led = s.led(["t", "id"], 3)
    w = s.window("t", "id")
    got = led.withColumns({"before": F.lag("id", 1).over(w), "third": F.lag("id", 3).over(w)}).where(~F.col("_copy"))
    got = s.carried(got, {"sum_before": F.sum("v"), "n_before": F.count(F.lit(1))})
    inside = s.window("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    got = got.withColumns({"running": F.sum("v").over(inside) + F.col("sum_before"), "place": F.count(F.lit(1)).over(inside) + F.col("n_before")})
    groups = defaultdict(list)
    for r in rows:
        groups[r[0] if keys else 0].append(r)
    want = {}
    for own in groups.values():
        own.sort(key=lambda r: (r[1], r[2]))
        total = 0
        for i, r in enumerate(own):
            total += r[3]
            want[r[2]] = (own[i - 1][2] if i else None, own[i - 3][2] if i > 2 else None, total, i + 1)
    assert {r["id"]: (r["before"], r["third"], r["running"], r["place"]) for r in got.collect()} == want


def test_light_keys_and_empty_tables(spark):
    df = spark.createDataFrame(made(), SCHEMA)
    s = sliced(df, ["k"], "t")
    assert not s.heavy and s.carried(s.df, {"x": F.sum("v"), "y": F.sum("t")}).select("x", "y").distinct().collect() == [(0, 0.0)]
    assert sliced(df.limit(0), ["k"], "t").led(["t"], 2).collect() == []
