"""Crafted rows for features, detectors, sessions, chains, packets, models, sources, streams."""

import math
import random
import struct
import warnings
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from otflow.functions import scalar as S
from otflow.functions.knowledge import PATTERNS
from otflow.operators import detectors as D
from otflow.operators import enrich as E
from otflow.operators import features as X
from otflow.operators import inspect as I
from otflow.operators import markov as M
from otflow.operators import ml as ML
from otflow.operators import packets as K
from otflow.operators import profile as P
from otflow.operators import sessions as W
from otflow.plans import models
from otflow.sources import files
from otflow.streaming import streams

RAW = ["sPackets", "rPackets", "sBytesSum", "rBytesSum", "duration", "sBytesMax", "rBytesMax", "sBytesMin", "rBytesMin", "sBytesAvg", "rBytesAvg", "sLoad", "rLoad", "sPayloadSum", "sPayloadAvg", "rPayloadAvg", "sInterPacketAvg", "rInterPacketAvg"]
RAW += [f"{s}{f}Rate" for s in "sr" for f in ("Ack", "Syn", "Fin", "Rst", "Psh", "Urg", "Fragment")] + ["sttl", "rttl", "sWinTCP", "rWinTCP", "sAckDelayAvg", "rAckDelayAvg"]


def raw_flows(spark, n=50):
    return spark.createDataFrame([(i, *[float((i * 7 + j * 3) % 11) for j in range(len(RAW))], i % 2, "replay" if i % 2 else "Normal") for i in range(n)], ["row_id", *RAW, "IT_B_Label", "IT_M_Label"])


def test_feature_counts(spark):
    flows = raw_flows(spark)
    v1, v2 = X.feature_table(flows, 1), X.feature_table(flows, 2)
    assert len(v1.columns) - 1 == 58 and len(v2.columns) - 1 == 63
    assert not set(v2.columns) & set(X.LABELS)
    assert all(math.isfinite(x) for r in v2.collect() for x in r[1:])
    assert "dst_packets" not in X.feature_table(flows.drop("rPackets"), 2).columns
    with pytest.raises(ValueError):
        X.leak_guard(flows, reject=True)
    assert X.plc_columns(spark.range(1).selectExpr("1 AS Tank1", "2 AS other")) == ["Tank1"]


FIRES = {
    "modbus_flooding": {"src_packet_rate": 50_001.0, "total_packets": 10_001.0},
    "plc_scanning": {"packet_ratio": 0.04, "dst_packets": 3.0, "byte_ratio": 0.04},
    "unauthorized_write": {"src_psh_rate": 0.41, "src_packet_rate": 51.0, "src_rst_rate": 0.1, "dst_psh_rate": 0.5},
    "protocol_fuzzing": {"packet_size_anomaly": 301.0, "src_urg_rate": 0.02},
    "man_in_the_middle": {"traffic_symmetry": 0.96, "byte_ratio": 1.1, "src_ttl": 128.0},
    "command_injection": {"src_psh_rate": 0.6, "dst_psh_rate": 0.05, "src_packet_rate": 16.0},
    "time_based_attack": {"src_inter_packet_avg": 0.001, "dst_inter_packet_avg": 0.001, "total_packets": 101.0, "src_packet_rate": 10.0},
    "replay_attack": {"byte_ratio": 1.0, "packet_ratio": 1.0, "traffic_symmetry": 0.99},
    "credential_stuffing": {"syn_ack_imbalance": 0.31, "total_packets": 14.0, "src_fin_rate": 0.2, "src_syn_rate": 0.31},
    "firmware_modification": {"total_bytes": 100_001.0, "bytes_per_packet": 71.0, "packet_ratio": 0.14},
}
QUIET = {"src_packet_rate": 1.0, "total_packets": 50.0, "packet_ratio": 0.7, "dst_packets": 20.0, "byte_ratio": 0.7, "src_psh_rate": 0.1, "dst_psh_rate": 0.5, "src_rst_rate": 0.0, "packet_size_anomaly": 1.0, "src_urg_rate": 0.0, "bytes_per_packet": 60.0, "traffic_symmetry": 0.5, "src_ttl": 64.0, "src_inter_packet_avg": 0.5, "dst_inter_packet_avg": 0.5, "syn_ack_imbalance": 0.0, "src_fin_rate": 0.0, "src_syn_rate": 0.0, "total_bytes": 500.0}


def test_detectors_fire_alone(spark):
    names = list(QUIET)
    rows = [(i, *[(QUIET | FIRES[p[0]])[c] for c in names]) for i, p in enumerate(PATTERNS)] + [(99, *QUIET.values())]
    found = D.detect(spark.createDataFrame(rows, ["row_id", *names])).collect()
    assert {(r.row_id, r.pattern) for r in found} >= {(i, p[0]) for i, p in enumerate(PATTERNS)}
    assert 99 not in {r.row_id for r in found} and all(0.5 <= r.confidence <= 1 for r in found)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert D.detect(spark.createDataFrame([(1, 1.0)], ["row_id", "x"])).count() == 0 and len(said) == 10


def test_session_window(spark):
    rows = [(i, f"s{i % 3}", f"d{i % 4}", float(i * 13 % 300), float(i % 6)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, sIPs string, rIPs string, start double, sPayloadAvg double")
    one = W.session_window(df.limit(1)).first()
    assert (one.src_flow_count, one.src_inter_flow_variance, one.src_payload_entropy) == (1, 0, 0)
    with pytest.raises(ValueError):
        W.session_window(df.drop("start"))
    assert W.session_window(df.limit(0)).collect() == []


def test_markov_by_hand(spark):
    rows = [(i, "a", float(i), 50000, p, "tcp", 1) for i, p in enumerate([502, 80, 502, 80, 502, 502])] + [(10, "b", 99.0, 50000, 9, "udp", 1), (11, "b", 100.0, 50000, 9, "udp", 1)]
    df = spark.createDataFrame(rows, "row_id long, src_ip string, ts double, src_port int, dst_port int, protocol string, fc int")
    model = M.fit(df)
    got = {r.row_id: r for r in M.score(df, model).collect()}
    assert got[0].transition_anomaly_score == 0.0
    assert abs(got[1].p - (2 + 0.1) / (3 + 0.2)) < 1e-12 and abs(got[5].p - (1 + 0.1) / (3 + 0.2)) < 1e-12
    assert got[11].chain == "*" and 0 <= got[11].transition_anomaly_score <= 1
    with pytest.raises(ValueError):
        M.fit(df.limit(0))


def test_flows_from_packets(spark):
    rows = [(i, float(i), *(("a", "b") if i % 3 else ("b", "a")), 6, *((1000, 502) if i % 3 else (502, 1000)), 64, 40 + i, 24, 100, None) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "pkt_id long, ts double, src_ip string, dst_ip string, proto int, src_port int, dst_port int, ttl int, length int, tcp_flags int, tcp_window int, payload binary")
    (flow,) = K.assemble(df).collect()
    assert (flow.src_ip, flow.fwd_packets, flow.bwd_packets, flow.fwd_psh, flow.iat_mean) == ("a", 5, 2, 5, 1.0)


def capture():
    def frame(flags, payload):
        tcp = struct.pack(">HHIIBBHHH", 1000, 502, 1, 1, 0x50, flags, 512, 0, 0) + payload
        ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(tcp), 1, 0, 64, 6, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + tcp
        eth = bytes(12) + b"\x08\x00" + ip
        return struct.pack("<IIII", 5, 250000, len(eth), len(eth)) + eth

    data = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    return data + frame(24, bytes.fromhex("000100000006010600500007")) + frame(16, b"") + b"cut off"


def test_capture_and_inspection(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture())
    packets = files.captures(spark, f"file://{tmp_path}/a.pcap")
    rows = packets.orderBy("pkt_id").collect()
    assert len(rows) == 2 and rows[0].ts == 5.25 and rows[0].dst_port == 502 and rows[0].tcp_flags == 24
    (event,) = I.modbus(packets).collect()
    assert event.severity == "CRITICAL" and event.address == 80 and event.alert == "CRITICAL: Write to protected register 80"


def test_vote_truth_table(spark):
    rows = [(i, i & 1, i >> 1 & 1, i >> 2 & 1) for i in range(8)]
    out = P.ensemble_vote(spark.createDataFrame(rows, "row_id int, iso int, xgb int, rf int"), ML.WEIGHTS).collect()
    assert all(r.prediction == int(bool(r.iso or r.xgb or r.rf)) for r in out)


def test_models(spark, tmp_path):
    rows = [(i, float(i % 10), float(i * 7 % 13), 0) for i in range(300)] + [(1000 + i, 50.0 + i, -40.0 - i, 1) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, label int")
    model = ML.fit_ensemble(df, ["a", "b"], forest={"trees": 30, "psi": 64}, boosted={"rounds": 3, "depth": 2}, trees={"trees": 5, "depth": 3})
    assert abs(sum(model.weights().values()) - 1) < 1e-12
    out = model.predict(df, ("row_id", "label"))
    best = {r.model: r for r in ML.evaluate(out).collect()}
    assert best["rf"].recall == 1.0 and best["iso"].recall > 0.9
    model.forest.save(spark, f"{tmp_path}/forest")
    assert ML.IsolationForest.load(spark, f"{tmp_path}/forest").trees == [[list(n) for n in t] for t in model.forest.trees]
    model.save(f"{tmp_path}/ensemble")
    model.save(f"{tmp_path}/ensemble")
    again = ML.Ensemble.load(spark, f"{tmp_path}/ensemble")
    key = lambda rows: sorted((r.row_id, r.iso, r.xgb, r.rf, r.prediction, round(r.ensemble_score, 9)) for r in rows.collect())
    assert key(again.predict(df)) == key(model.predict(df))
    scaled = ML.scale(df, model.parameters)
    why = ML.explain(model.forest, scaled.where("row_id = 1029"), 2).collect()
    assert len(why) == 2 and sum(r.contribution for r in why) < 0 and why[0].direction == "toward anomaly"
    alone = ML.fit_ensemble(df.where("label = 0"), ["a", "b"], forest={"trees": 5, "psi": 16})
    assert alone.boosted is None and alone.weights() == {"iso": 1.0}
    alone.save(f"{tmp_path}/alone")
    assert ML.Ensemble.load(spark, f"{tmp_path}/alone").weights() == {"iso": 1.0}


def test_sources_and_sinks(spark, tmp_path):
    for name, text in (("b", "x,y\n1,2\n"), ("a", "x,z\n3,4\n")):
        (tmp_path / "set").mkdir(exist_ok=True)
        (tmp_path / "set" / f"{name}.csv").write_text(text)
    assert [tuple(r) for r in files.list_datasets(spark, str(tmp_path)).collect()] == [("set", 2)]
    got = files.csv_dataset(spark, f"{tmp_path}/set")
    assert set(got.columns) == {"x", "y", "z", "row_id"} and got.count() == 2
    (tmp_path / "nvd.json").write_text('{"vulnerabilities":[{"cve":{"id":"CVE-1","published":"2024","descriptions":[{"lang":"es","value":"no"},{"lang":"en","value":"Modbus ICS modicon flaw"}],"metrics":{"cvssMetricV31":[{"cvssData":{"baseScore":9.0}}]}}}]}')
    cves = files.nvd_responses(spark, f"{tmp_path}/nvd.json")
    row = cves.first()
    assert (row.cve_id, row.severity, row.iec_sl, row.description) == ("CVE-1", "CRITICAL", "SL-4", "Modbus ICS modicon flaw")
    summary = spark.createDataFrame([("modbus_flooding", 3, "HIGH", 0.7, True), ("unauthorized_write", 1, "CRITICAL", 0.9, True), ("command_injection", 1, "CRITICAL", 0.9, True)], "pattern string, n_flows long, severity string, confidence double, detected boolean")
    enriched = {r.pattern: r for r in E.pattern_cves(summary, cves).collect()}
    assert enriched["modbus_flooding"].top_cve == "CVE-1" and enriched["command_injection"].required_iec_sl == "SL-2"
    assert E.vendor_cves(cves).first().vendor == "schneider_electric"
    sids = {r.sid for r in E.rule_text(summary).collect()}
    assert sids == {9000001, 9000003, 9000053, 9000006}
    kinds = {r.type: r["count"] for r in E.stix_objects(summary).groupBy("type").count().collect()}
    assert kinds == {"identity": 1, "indicator": 3, "attack-pattern": 2, "relationship": 3}
    files.write_rules(E.rule_text(summary), f"{tmp_path}/rules")
    files.write_bundle(E.stix_objects(summary), f"{tmp_path}/bundle")
    assert spark.read.text(f"{tmp_path}/rules").count() == 4 and spark.read.json(f"{tmp_path}/bundle").first().type == "bundle"
    flows = raw_flows(spark, 6)
    table = X.feature_table(flows, 2)
    files.write_features(table, flows, flows.select("row_id", "IT_B_Label"), f"{tmp_path}/features")
    back = files.features_with_labels(spark.read.parquet(f"{tmp_path}/features/features_v3"), spark.read.parquet(f"{tmp_path}/features/labels"))
    assert back.count() == 6 and len(back.columns) == 65
    files.write_table(P.value_counts(flows, "IT_M_Label"), f"{tmp_path}/dist", "csv")
    files.write_sample(flows, f"{tmp_path}/sample", 3)
    assert spark.read.option("header", True).csv(f"{tmp_path}/sample").count() == 3


def run_stream(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.sql(f"SELECT * FROM {name}")


def test_streams(spark, tmp_path):
    flows = raw_flows(spark, 20)
    flows.write.parquet(f"{tmp_path}/flows")
    live = spark.readStream.schema(flows.schema).parquet(f"{tmp_path}/flows")
    low = {"scan_packet_ratio": 5.0, "scan_dst_packets": 9.0, "scan_byte_ratio": 9.0}
    batch = D.detect(X.feature_table(flows, 2, mean_size=1.0, sessions=False), low)
    got = run_stream(streams.score_stream(live, 1.0, low), "scored")
    assert got.count() == batch.count() > 0
    packets = spark.createDataFrame([(i, float(i * 50 + (10_000 if i == 9 else 0)), "a", "b", 6, 1, 502, 64, 40, 0, 0, bytes.fromhex("000100000006010100010002")) for i in range(10)], "pkt_id long, ts double, src_ip string, dst_ip string, proto int, src_port int, dst_port int, ttl int, length int, tcp_flags int, tcp_window int, payload binary").withColumn("ts", F.timestamp_seconds("ts"))
    packets.write.parquet(f"{tmp_path}/packets")
    flowing = spark.readStream.schema(packets.schema).parquet(f"{tmp_path}/packets")
    ruled = run_stream(streams.rules_stream(flowing, 1, 2, 100), "ruled")
    assert ruled.count() == 4
    alerts = flowing.withColumn("pattern", F.lit("x")).select("pattern", "src_ip", "ts")
    assert run_stream(streams.dedup_alerts(alerts), "alerts").count() == 1
    named = flowing.withColumnRenamed("src_ip", "sIPs").withColumnRenamed("dst_ip", "rIPs")
    assert run_stream(streams.session_counts_stream(named), "sessions").count() > 0


def test_entropy_and_labels(spark):
    df = spark.createDataFrame([([1.0, 1.0],), ([0.0, 10.0],), ([3.0],)], "v array<double>")
    assert [r.e for r in df.select(S.entropy_hist(F.col("v")).alias("e")).collect()] == [0.0, 1.0, 0.0]
    assert S.rounded(spark.range(1).select(F.lit(1.23456789).alias("x")), 3).first().x == 1.235


def test_every_request_is_scored(spark, tmp_path):
    """Requests that share order and line are all scored."""
    rows = [(i // 2, 1 + i // 2 % 4, i % 40, 3 * i % 50 + 1.0, 100.0 + 7 * i, i % 10 / 100, i % 8 / 100) for i in range(200)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double").withColumn("l_suppkey", F.col("l_partkey"))
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    out = models.request_scores(spark, str(tmp_path)).groupBy("row_id").count().collect()
    valid = Counter((o * 8 + n) for o, n, p, *_ in rows if p * 37 % 70000 <= 65535)
    assert {r["row_id"]: r["count"] for r in out} == dict(valid) and len(rows) == sum(valid.values())


def test_explained_rows(spark, monkeypatch):
    """The first five true positives are explained, and all features and rows count in the global attribution, also where row_id repeats."""
    data = [(i // 2, i % 3 // 2, *[float((i * (k + 3)) % 17 + (i % 3 // 2) * 30) for k in range(len(models.NAMES))]) for i in range(120)]
    df = spark.createDataFrame(data, "row_id long, label int, " + ", ".join(f"{n} double" for n in models.NAMES))
    monkeypatch.setattr(models, "training", lambda s, d: df)
    monkeypatch.setattr(models, "FOREST", {"trees": 10, "psi": 32})
    report = models.audit(spark, "").collect()
    assert len({(r.row_id, r.nth) for r in report}) == 5 and len(report) == 5 * min(10, len(models.NAMES))
    spread = models.attribution(spark, "").collect()
    assert sorted((r.feature, r.label) for r in spread) == sorted((n, y) for n in models.NAMES for y in (0, 1))


def test_late_rows(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    for k, seconds in enumerate(([0, 300], [10, 290, 310], [100, 200, 400])):
        spark.createDataFrame([(at(s), s) for s in seconds], "t string, s int").selectExpr("to_timestamp(t) AS ts", "s").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    kept, gone = {}, {}
    take = lambda held: lambda rows, batch: held.__setitem__(batch, sorted(r.s for r in rows.collect()))
    for k in range(3):  # one folder a batch, in order
        spark.read.parquet(f"{tmp_path}/in/{k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/live")
        live = spark.readStream.schema("ts timestamp, s int").parquet(f"{tmp_path}/live")
        query = streams.split_late(live, take(kept), take(gone), f"{tmp_path}/checkpoint", seconds=120).trigger(availableNow=True).start()
        query.awaitTermination()
        assert streams.late_rows(query) == 0
    assert kept == {0: [0, 300], 1: [290, 310], 2: [200, 400]} and gone == {0: [], 1: [10], 2: [100]}


def test_running_sums_and_quantiles(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.random(), round(rng.random(), 1), -5.0]) for _ in range(500)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 3.0), ("c", None)], "feature string, value double")
    got = {r.feature: r for r in P.quantiles(df, {"low": 0.01, "mid": 0.5, "high": 0.99}).collect()}
    want = np.quantile(values, [0.01, 0.5, 0.99])
    assert np.allclose([got["a"].low, got["a"].mid, got["a"].high], want) and got["b"].mid == 3.0 and "c" not in got
    counts = df.where("feature = 'a'").groupBy("value").count()
    for falling in (False, True):
        out = sorted(((r.value, r.running_count) for r in P.cumulative(counts, [], "value", ["count"], parts=7, descending=falling).collect()))
        assert out == [(v, sum(x >= v if falling else x <= v for x in values)) for v in sorted(set(values))]
    assert P.quantiles(df.limit(0), {"mid": 0.5}).collect() == []


def test_inspection_in_one_pass(spark):
    """Events agree with the decoders one by one, over random payloads."""
    rng = random.Random(5)
    ports = [502, 502, 502, 20000, 44818, 2222, 102, 4840, 47808, 1911, 789, 80]
    head = lambda: rng.choice([b"", b"\x05\x64", b"\x03\x00", b"\x00\x01\x00\x00\x00\x06\x01" + bytes([rng.choice([1, 3, 6, 16, 99])]), b"\x6f\x00"])
    rows = [(i, rng.choice([6, 6, 6, 17]), rng.choice(ports), head() + bytes(rng.randrange(256) for _ in range(rng.randrange(30))) if i % 20 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "pkt_id long, proto int, dst_port int, payload binary").withColumns({"src_ip": F.lit("a"), "dst_ip": F.lit("b")})
    parts = [I.route(df).where("severity is not null")] + [f(df) for f in (I.modbus, I.dnp3, I.ethernetip, I.s7comm, I.opcua)]
    want = sorted(tuple(r) for p in parts for r in p.select("pkt_id", "protocol", "severity").collect())
    assert sorted(tuple(r) for r in I.events(df).collect()) == want and len({w[1:] for w in want}) > 8
