"""Stateful streams give what the batch operators give on the same rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from otflow.operators import markov as M
from otflow.operators import packets as K
from otflow.operators import sessions as W
from otflow.streaming import stateful, streams

PROVIDER, IDLE_BATCHES = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set(PROVIDER, stateful.STATE_STORE)
    yield
    spark.conf.unset(PROVIDER)
    spark.conf.unset(IDLE_BATCHES)


def put(spark, rows, schema, path):
    """One more file of a stream's folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def live(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(stream, path, name):
    query = stream.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    if not query.awaitTermination(150):
        query.stop()
        raise TimeoutError(name)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/{name}")


STATES = "row_id long, src_ip string, ts double, src_port int, dst_port int, protocol string, fc int"


def test_chain_after_a_restart(spark, tmp_path):
    spark.conf.set(IDLE_BATCHES, "false")  # time to live is processing time, for which there's always another batch
    draw = random.Random(8)
    rows = [(i, draw.choice("aaabc"), float(i // 2), 50000, draw.choice([502, 80, 2404]), "tcp", 1) for i in range(120)]
    model = M.fit(spark.createDataFrame(rows, STATES))
    M.save(model, f"{tmp_path}/model")
    model = M.load(spark, f"{tmp_path}/model")
    want = {r.row_id: r.transition_anomaly_score for r in M.score(spark.createDataFrame(rows, STATES), model).collect()}
    for part in (rows[:50], rows[50:80]):
        put(spark, part[::-1], STATES, tmp_path / "in")
    make = lambda: streams.markov_stream(live(spark, STATES, tmp_path / "in"), model)
    run(make(), tmp_path, "scores")
    put(spark, rows[80:], STATES, tmp_path / "in")
    out = run(make(), tmp_path, "scores").collect()  # a new query on the old checkpoint
    assert len(out) == 120 and all(abs(r.score - want[r.row_id]) < 1e-9 for r in out)


def test_state_of_silent_sources_goes(spark, tmp_path):
    spark.conf.set(IDLE_BATCHES, "false")
    rows = [(i, "a", float(i), 50000, 502, "tcp", 1) for i in range(4)]
    make = lambda ttl: stateful.previous_stream(live(spark, STATES, tmp_path / f"in{ttl}").withColumn("state", F.lit("s")), ttl)
    for ttl, before in ((1, None), (3600, "s")):
        put(spark, rows[:2], STATES, tmp_path / f"in{ttl}")
        run(make(ttl), tmp_path, f"out{ttl}")
        time.sleep(2.5)
        put(spark, rows[2:], STATES, tmp_path / f"in{ttl}")
        out = {r.row_id: r.prev for r in run(make(ttl), tmp_path, f"out{ttl}").collect()}
        assert out == {0: None, 1: "s", 2: before, 3: "s"}


FLOWS = "row_id long, sIPs string, rIPs string, seconds double, sPayloadAvg double"


def test_centred_sessions_equal_the_batch(spark, tmp_path):
    draw = random.Random(9)
    rows = [(i, draw.choice(["a", "a", "b", None]), draw.choice("xyz"), 1000.0 + i + draw.choice([0, 0.25]), draw.choice([0.0, 1.0, 5.0, draw.random()])) for i in range(400)]
    order = sorted(rows, key=lambda r: r[3] + draw.random() * 15)  # out of order by less than the watermark
    for k in range(0, 400, 100):
        put(spark, order[k : k + 100], FLOWS, tmp_path / "in")
    stream = live(spark, FLOWS, tmp_path / "in").withColumn("ts", F.timestamp_seconds("seconds"))
    out = run(streams.session_stream(stream, 60, "20 seconds"), tmp_path, "sessions").collect()
    batch = W.session_window(spark.createDataFrame(rows, FLOWS).withColumnRenamed("seconds", "start"), 60)
    want = {r.row_id: tuple(r)[1:] for r in batch.collect()}
    closed = {r[0] for r in rows if r[3] + 60 <= max(x[3] for x in rows) - 21}
    got = {r.row_id: tuple(r)[2:] for r in out}
    assert len(out) == len(got) and closed <= got.keys() and len(closed) > 250
    assert all(got[i] == pytest.approx(want[i], abs=1e-6) for i in got)


PACKETS = "pkt_id long, seconds double, src_ip string, src_port int, dst_ip string, dst_port int, proto int, ttl int, length int, tcp_flags int, tcp_window int"


def test_flows_equal_the_batch(spark, tmp_path):
    draw = random.Random(10)
    rows, n = [], 0
    for f in range(12):
        ends, at, count = [(f"h{f}", 1000 + f), ("plc", 502)], 100.0 + 20 * f, draw.randrange(1, 30)
        for k in range(count):
            x = draw.sample(ends, 2) if f else [ends[0], ends[0]]
            flags = draw.choice([2, 16, 24]) | (1 if f % 3 == 1 and k == count - 1 else 4 if f % 3 == 2 and k == count - 1 else 0)
            rows.append((n, at, *x[0], *x[1], 6, 60 + k % 5, 40 + draw.randrange(900), flags, draw.choice([None, 8192])))
            n, at = n + 1, at + draw.choice([0.0, 0.5, 7.25])
    again = [(n, 390.0, "h1", 1001, "plc", 502, 6, 64, 40, 2, 1), (n + 1, 2000.0, "end", 1, "end", 2, 17, 64, 40, None, None)]
    order = sorted(rows, key=lambda r: r[1] + draw.random() * 15) + again
    for k in range(0, len(order), 60):
        put(spark, order[k : k + 60], PACKETS, tmp_path / "in")
    stream = live(spark, PACKETS, tmp_path / "in").withColumn("ts", F.timestamp_seconds("seconds"))
    out = run(streams.assemble_stream(stream, idle=30, linger=2, watermark="20 seconds"), tmp_path, "flows")
    batch = K.assemble(spark.createDataFrame(rows, PACKETS).withColumnRenamed("seconds", "ts"))
    assert set(out.columns) == set(batch.columns)
    key = lambda r: (r["src_ip"], r["src_port"], r["start"])
    got, want = sorted(out.collect(), key=key), sorted(batch.collect(), key=key)
    rejoined = [r for r in got if r["start"] == 390.0]
    assert len(rejoined) == 1 and rejoined[0]["fwd_packets"] == 1  # the same ends, later than idleness: another flow
    got = [r for r in got if r["start"] != 390.0]
    assert len(got) == len(want) == 12
    for g, w in zip(got, want, strict=True):
        for c in batch.columns:
            assert g[c] == (pytest.approx(w[c], abs=1e-5) if isinstance(w[c], float) else w[c]), c
