"""Operators of heavy sources and flows: cut into slices, they give what one task would."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from otflow.functions import scalar as S
from otflow.operators import markov as M
from otflow.operators import packets as K
from otflow.operators import sessions as W
from otflow.operators.sweep import Ranks, windows

FLOWS = "row_id long, sIPs string, rIPs string, start double, sPayloadAvg double, sPayloadSum double"


def flows(seed=4, n=600):
    draw = random.Random(seed)
    source = lambda: draw.choice(["hot"] * 5 + ["a", "b", None])
    rows = [(i, source(), draw.choice(["x", "y", "z", None]), float(draw.randrange(400)) + draw.choice([0, 0.25, 0.5]), draw.choice([0.0, 1.0, 2.5, 7.0, draw.random()]), 3.0) for i in range(n)]
    return rows + [(n + i, "hot", "x", 77.0, 2.0, 1.0) for i in range(150)]  # one instant


def spread(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


def test_ranks_count_and_select():
    draw = np.random.default_rng(1)
    for top in (1, 2, 9, 1000):
        v = draw.integers(0, top, 200)
        tree, low = Ranks(v), draw.integers(0, 150, 80)
        high = low + draw.integers(1, 50, 80)
        than = draw.integers(0, top + 3, 80)
        assert tree.less(low, high, than).tolist() == [int((v[a:z] < t).sum()) for a, z, t in zip(low, high, than, strict=True)]
        k = (draw.random(80) * (high - low)).astype(np.int64)
        assert tree.kth(low, high, k).tolist() == [sorted(v[a:z])[i] for a, z, i in zip(low, high, k, strict=True)]


@pytest.mark.parametrize("seconds", [0.5, 60, 1000])
def test_session_window_by_brute_force(spark, seconds):
    rows = flows()
    by = defaultdict(list)
    for r in rows:
        by[r[1] or "unknown"].append((r[3], r[2] or "unknown", r[4], r[0]))
    want = {}
    for own in by.values():
        for t, _, _, row in own:
            near = sorted(x for x in own if abs(x[0] - t) <= seconds)
            gaps = [b[0] - a[0] for a, b in zip(near, near[1:], strict=False)]
            mean = sum(gaps) / len(gaps) if gaps else 0.0
            positive = [x[2] for x in near if x[2] > 0]
            entropy = 0.0
            if positive and max(positive) > min(positive):
                bins = Counter(min(int((x - min(positive)) / (max(positive) - min(positive)) * 10), 9) for x in positive)
                entropy = -sum(c / len(positive) * math.log2(c / len(positive)) for c in bins.values())
            d = len({x[1] for x in near})
            want[row] = spread((float(d), float(len(near)), mean, sum((g - mean) ** 2 for g in gaps) / len(gaps) if gaps else 0.0, len(near) / d, entropy))
    got = W.session_window(spark.createDataFrame(rows, FLOWS).repartition(3), seconds).collect()
    assert {r[0]: spread(tuple(r)[1:]) for r in got} == want


def test_window_memory_is_linear():
    n = 50_000
    draw = np.random.default_rng(2)
    start, dst, payload = np.sort(draw.random(n) * 60), draw.integers(0, 99, n), draw.random(n)
    out = windows(np.zeros(n, np.int64), start, dst, payload, np.arange(n) < 10_000, 60.0)
    assert out.shape == (6, 10_000) and (out[1] == n).all() and (out[0] == 99).all() and (out[5] > 3.3).all()


def test_session_global_in_slices(spark):
    df = spark.createDataFrame(flows(), FLOWS).repartition(4)
    whole, cut = (sorted(map(spread, W.session_global(df, rows).select("row_id", *[c for c in W.session_global(df).columns if c.startswith("src_")]).collect())) for rows in (10**6, 40))
    assert whole == cut and len(cut) == 750
    odd = df.withColumn("timestamp", F.when(F.col("row_id") % 5 > 0, F.timestamp_seconds("start").cast("string"))).drop("start")
    whole, cut = (sorted(map(spread, W.session_global(odd, rows).select("row_id", "src_inter_flow_interval", "src_inter_flow_variance").collect())) for rows in (10**6, 40))
    assert whole == cut


@pytest.mark.parametrize("rows", [10**6, 30])
def test_rate_excess(spark, rows):
    made = flows()
    got = W.rate_excess(spark.createDataFrame(made, FLOWS).repartition(4), "sIPs", "start", 12, 20, rows)
    assert got.columns == [*[c.split()[0] for c in FLOWS.split(", ")], "in_window"]
    n = {r[0]: sum(o[1] == r[1] and r[3] - 20 <= o[3] <= r[3] for o in made) for r in made}
    assert {r.row_id: r.in_window for r in got.collect()} == {k: v for k, v in n.items() if v > 12}


def test_chains_in_slices(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice(["hot", "hot", "a", None]), draw.choice([float(draw.randrange(60)), None]), 50000, draw.choice([502, 80, 2404]), "tcp", 1) for i in range(500)]
    df = M.with_state(spark.createDataFrame(rows, "row_id long, src_ip string, ts double, src_port int, dst_port int, protocol string, fc int").repartition(3))
    for f in (lambda n: M.with_previous(df, n).select("row_id", "prev"), lambda n: M.global_transitions(df, n)):
        assert Counter(map(tuple, f(10**6).collect())) == Counter(map(tuple, f(25).collect()))
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0.0, r[0]))
    assert M.global_transitions(df, 25).count() == len(order) - 1


def test_long_flow_in_slices(spark):
    draw = random.Random(6)
    ends = [("a", 1000), ("b", 502)]
    rows = [(i, draw.choice([float(draw.randrange(90)), 33.0]), *(x := draw.sample(ends, 2) if i % 9 else [("c", 5), ("c", 5)])[0], *x[1], 6, 64 + i % 3, 40 + i % 50, draw.randrange(64), 100 + i) for i in range(400)]
    df = spark.createDataFrame(rows, "pkt_id long, ts double, src_ip string, src_port int, dst_ip string, dst_port int, proto int, ttl int, length int, tcp_flags int, tcp_window int").repartition(3)
    for f in (K.iat, K.assemble):
        whole, cut = ({tuple(sorted(r.asDict().items(), key=lambda x: x[0]))[:9] if f is K.iat else spread(tuple(r)) for r in f(df, n).drop("end_a", "end_b", "own_end").collect()} for n in (10**6, 30))
        assert whole == cut
    first = min((r for r in rows if r[2] != "c"), key=lambda r: (r[1], r[0]))
    flow = next(r for r in K.assemble(df, 30).collect() if r.src_ip != "c")
    mine = sorted((r for r in rows if r[2:4] == first[2:4]), key=lambda r: (r[1], r[0]))
    assert (flow.src_ip, flow.src_port, flow.fwd_packets, flow.fwd_bytes, flow.fwd_win) == (*first[2:4], len(mine), sum(r[8] for r in mine), first[10])
    times = sorted(r[1] for r in rows if r[2] != "c")
    assert abs(flow.iat_std - np.std(np.diff(times))) < 1e-9 and S.has_flag is not None
