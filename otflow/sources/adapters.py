"""Tables of the test data as flows, sessions, packets, requests and scores: deterministic renamings.

``SQL`` has the same adapters as common table expressions, for the SQL of the registered queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import epoch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    back = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    per, back_per = F.col("l_extendedprice") / F.col("l_quantity"), back / F.col("l_linenumber")
    return t.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("sIPs"),
        F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")).alias("rIPs"),
        F.when(F.col("l_linenumber") % 3 == 0, "IPV4-UDP").otherwise("IPV4-TCP").alias("protocol"),
        F.element_at(F.array(*[F.lit(p) for p in (502, 20000, 44818, 102, 4840, 80, 443)]), F.col("l_linenumber").cast("int")).alias("dst_port"),
        F.col("l_quantity").alias("sPackets"), F.col("l_linenumber").cast("double").alias("rPackets"),
        F.col("l_extendedprice").alias("sBytesSum"), back.alias("rBytesSum"), F.col("l_tax").alias("duration"),
        F.col("l_extendedprice").alias("sBytesMax"), back.alias("rBytesMax"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("sBytesMin"), (back * F.col("l_discount")).alias("rBytesMin"),
        per.alias("sBytesAvg"), back_per.alias("rBytesAvg"), (F.col("l_extendedprice") * 8).alias("sLoad"), (back * 8).alias("rLoad"),
        F.col("l_extendedprice").alias("sPayloadSum"), per.alias("sPayloadAvg"), back_per.alias("rPayloadAvg"),
        (F.col("l_tax") / F.col("l_quantity")).alias("sInterPacketAvg"), (F.col("l_tax") / F.col("l_linenumber")).alias("rInterPacketAvg"),
        (F.col("l_discount") * 10).alias("sAckRate"), (F.col("l_tax") * 10).alias("rAckRate"),
        (F.col("l_tax") * 10).alias("sSynRate"), (F.col("l_discount") * 10).alias("rSynRate"),
        (F.col("l_discount") * 5).alias("sFinRate"), (F.col("l_tax") * 5).alias("rFinRate"),
        (F.col("l_tax") * 2).alias("sRstRate"), (F.col("l_discount") * 2).alias("rRstRate"),
        (F.col("l_discount") * 10).alias("sPshRate"), (F.col("l_tax") * 4).alias("rPshRate"),
        (F.col("l_tax") / 4).alias("sUrgRate"), (F.col("l_discount") / 4).alias("rUrgRate"),
        F.when(F.col("l_linestatus") == "F", 128.0).otherwise(64.0).alias("sttl"), F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(64.0).alias("rttl"),
        (F.col("l_quantity") * 100).alias("sWinTCP"), F.lit(0.0).alias("rWinTCP"), F.lit(0.0).alias("sFragmentRate"), F.lit(0.0).alias("rFragmentRate"),
        F.col("l_tax").alias("sAckDelayAvg"), F.col("l_discount").alias("rAckDelayAvg"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("IT_B_Label"),
        F.when(F.col("l_returnflag") == "R", "replay").when(F.col("l_returnflag") == "A", "ddos").otherwise("Normal").alias("IT_M_Label"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    return t.select(F.col("event_id").alias("row_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sIPs"), F.col("event_type").alias("rIPs"), epoch(F.col("ts")).alias("start"), F.col("value").alias("sPayloadAvg"), F.col("value").alias("sPayloadSum"), F.when(F.col("event_type") == "error", "replay").otherwise("Normal").alias("IT_M_Label"))


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _k()
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src_ip"), epoch(F.col("ts")).alias("ts"), (k + 49102).alias("src_port"),
        F.element_at(F.array(*[F.lit(p) for p in (502, 20000, 44818, 2404, 80)]), k % 5 + 1).alias("dst_port"), F.element_at(F.array(F.lit("tcp"), F.lit("udp"), F.lit("icmp")), k % 3 + 1).alias("protocol"),
        F.element_at(F.array(F.lit(1), F.lit(3), F.lit(6), F.lit(16)), k % 4 + 1).alias("fc"), F.when(F.col("event_type") == "error", "attack").otherwise("Normal").alias("label"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _k()
    user, plc = F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("plc"), (F.col("user_id") % 5).cast("string"))
    port = F.element_at(F.array(*[F.lit(p) for p in (502, 502, 20000, 44818, 102, 4840, 47808)]), (F.col("event_id") % 7 + 1).cast("int"))
    own, out = (F.col("user_id") + 49152).cast("int"), k % 2 == 0
    fc = F.element_at(F.array(F.lit(1), F.lit(3), F.lit(6), F.lit(16)), (F.col("event_id") % 4 + 1).cast("int"))
    number = lambda c, n: F.lpad(F.hex(c), n, "0")
    modbus = F.concat(number(F.col("event_id") % 65536, 4), F.when(F.col("event_id") % 101 == 0, "0001").otherwise("0000"), F.lit("0006"), number(k % 8, 2), number(fc, 2), number(k * 20, 4), number(F.col("event_id") % 1000, 4), F.lit("02"))
    dnp3 = F.concat(F.lit("0564"), number(k, 2), F.lit("C4"), number(F.col("event_id") * 37 % 65536, 4), number(k * 655, 4), F.lit("0000"))
    other = F.concat(F.when(k % 3 == 0, "03").otherwise("6F"), F.lit("00"), number(k * 10, 4), F.repeat(F.lit("00"), 24))
    payload = F.unhex(F.when(port == 502, modbus).when(port == 20000, dnp3).otherwise(other))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pkt_id"), epoch(F.col("ts")).alias("ts"), F.when(out, user).otherwise(plc).alias("src_ip"), F.when(out, plc).otherwise(user).alias("dst_ip"), F.lit(6).alias("proto"),
        F.when(out, own).otherwise(port).alias("src_port"), F.when(out, port).otherwise(own).alias("dst_port"), F.when(F.col("event_type") == "error", 128).otherwise(64).alias("ttl"),
        (k + 40).alias("length"), k.alias("tcp_flags"), (k + 8192).alias("tcp_window"), payload.alias("payload"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), F.concat(F.lit("10.0.0."), (F.col("l_suppkey") % 300).cast("string")).alias("src_ip"), F.concat(F.lit("10.0.1."), (F.col("l_partkey") % 256).cast("string")).alias("dst_ip"),
        (F.col("l_partkey") * 37 % 70000).cast("int").alias("src_port"), F.element_at(F.array(*[F.lit(p) for p in (502, 20000, 44818, 80, 443, 8080, 9)]), F.col("l_linenumber").cast("int")).alias("dst_port"), F.when(F.col("l_linenumber") == 5, 300).otherwise(6).alias("protocol"),
        F.col("l_quantity").cast("int").alias("fwd_packets"), (F.col("l_linenumber") - 1).cast("int").alias("bwd_packets"), F.floor("l_extendedprice").cast("int").alias("fwd_bytes"), (F.floor("l_extendedprice") / 2).cast("int").alias("bwd_bytes"),
        F.col("l_tax").alias("duration"), F.col("l_discount").alias("iat_mean"), F.col("l_tax").alias("iat_std"), (F.col("l_linenumber") % 4).cast("int").alias("fwd_psh"), (F.col("l_linenumber") % 3).cast("int").alias("bwd_psh"), F.lit(0).alias("fwd_urg"), F.lit(0).alias("bwd_urg"),
    )


#: What an adapted vulnerability is about, by its key modulo their number.
TOPICS = ["Modbus ICS gateway of a modicon line", "Siemens S7 SCADA flaw in simatic panels", "unauthorized Modbus writes on s7-1200", "SCADA MITM between logix stations", "ICS remote code execution in centum", "SCADA replay against ac800m", "web server flaw", "industrial protocol parser of factorytalk"]


def nvd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as vulnerabilities in the shape of NVD v2 responses: one response a part, scores under one of three metrics."""
    k = F.col("p_partkey")
    score = F.struct(F.struct((k % 101 / 10).cast("double").alias("baseScore")).alias("cvssData"))
    held = lambda ok: F.when(ok, F.array(score)).otherwise(F.array().cast("array<struct<cvssData:struct<baseScore:double>>>"))
    metrics = F.struct(held(k % 4 == 0).alias("cvssMetricV31"), held(k % 4 == 1).alias("cvssMetricV30"), held(k % 4 == 2).alias("cvssMetricV2"))
    text = F.concat(F.element_at(F.array(*[F.lit(t) for t in TOPICS]), (k % len(TOPICS) + 1).cast("int")), F.lit(" in "), F.col("p_name"))
    texts = F.array(F.struct(F.lit("es").alias("lang"), F.lit("otro").alias("value")), F.struct(F.lit("en").alias("lang"), text.alias("value")))
    cve = F.struct(F.concat(F.lit("CVE-2024-"), k.cast("string")).alias("id"), texts.alias("descriptions"), metrics.alias("metrics"), F.lit("2024-01-01T00:00:00.000").alias("published"))
    return table(spark, sf_dir, "part").select(F.array(F.struct(cve.alias("cve"))).alias("vulnerabilities"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("iso"), F.when(F.col("quality") == 0, 1).otherwise(0).alias("xgb"), F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0).alias("rf"), F.col("toxic").cast("int").alias("y"), F.when(F.col("doc_id") % 2 == 0, "ddos").otherwise("replay").alias("attack_type"))


_TOPICS = ", ".join(f"'{t}'" for t in TOPICS)
SQL = {
    "nvd": f"nvd AS (SELECT 'CVE-2024-'||p_partkey AS cve_id, [{_TOPICS}][p_partkey%{len(TOPICS)}+1]||' in '||p_name AS description, CASE WHEN p_partkey%4<3 THEN (p_partkey%101)/10.0::DOUBLE END AS score, '2024-01-01T00:00:00.000' AS published FROM part)",
    "flows": """flows AS (SELECT l_orderkey*8+l_linenumber AS row_id, 's'||l_suppkey AS sIPs, 'p'||(l_partkey%50) AS rIPs,
 CASE WHEN l_linenumber%3=0 THEN 'IPV4-UDP' ELSE 'IPV4-TCP' END AS protocol, [502,20000,44818,102,4840,80,443][l_linenumber] AS dst_port,
 l_quantity AS sPackets, l_linenumber::DOUBLE AS rPackets, l_extendedprice AS sBytesSum, l_extendedprice*(1-l_discount) AS rBytesSum, l_tax AS duration,
 l_extendedprice AS sBytesMax, l_extendedprice*(1-l_discount) AS rBytesMax, l_extendedprice*l_discount AS sBytesMin, l_extendedprice*(1-l_discount)*l_discount AS rBytesMin,
 l_extendedprice/l_quantity AS sBytesAvg, l_extendedprice*(1-l_discount)/l_linenumber AS rBytesAvg, l_extendedprice*8 AS sLoad, l_extendedprice*(1-l_discount)*8 AS rLoad,
 l_extendedprice AS sPayloadSum, l_extendedprice/l_quantity AS sPayloadAvg, l_extendedprice*(1-l_discount)/l_linenumber AS rPayloadAvg,
 l_tax/l_quantity AS sInterPacketAvg, l_tax/l_linenumber AS rInterPacketAvg, l_discount*10 AS sAckRate, l_tax*10 AS rAckRate, l_tax*10 AS sSynRate, l_discount*10 AS rSynRate,
 l_discount*5 AS sFinRate, l_tax*5 AS rFinRate, l_tax*2 AS sRstRate, l_discount*2 AS rRstRate, l_discount*10 AS sPshRate, l_tax*4 AS rPshRate, l_tax/4 AS sUrgRate, l_discount/4 AS rUrgRate,
 CASE WHEN l_linestatus='F' THEN 128.0::DOUBLE ELSE 64.0 END AS sttl, CASE WHEN l_linenumber=7 THEN NULL ELSE 64.0::DOUBLE END AS rttl, l_quantity*100 AS sWinTCP, 0.0::DOUBLE AS rWinTCP,
 0.0::DOUBLE AS sFragmentRate, 0.0::DOUBLE AS rFragmentRate, l_tax AS sAckDelayAvg, l_discount AS rAckDelayAvg, CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS IT_B_Label,
 CASE l_returnflag WHEN 'R' THEN 'replay' WHEN 'A' THEN 'ddos' ELSE 'Normal' END AS IT_M_Label FROM lineitem)""",
    "sessions": """sessions AS (SELECT event_id AS row_id, 'u'||user_id AS sIPs, event_type AS rIPs, epoch_us(ts)/1e6 AS start, value AS sPayloadAvg, value AS sPayloadSum,
 CASE WHEN event_type='error' THEN 'replay' ELSE 'Normal' END AS IT_M_Label FROM events)""",
    "states": """raw_states AS (SELECT *, (props->>'$.k')::INT AS k FROM events), states AS (SELECT event_id AS row_id, 'u'||user_id AS src_ip, epoch_us(ts)/1e6 AS ts, k+49102 AS src_port,
 [502,20000,44818,2404,80][k%5+1] AS dst_port, ['tcp','udp','icmp'][k%3+1] AS protocol, [1,3,6,16][k%4+1] AS fc, CASE WHEN event_type='error' THEN 'attack' ELSE 'Normal' END AS label FROM raw_states)""",
    "packets": """raw_packets AS (SELECT *, (props->>'$.k')::INT AS k, [502,502,20000,44818,102,4840,47808][(event_id%7+1)::INT] AS port FROM events),
 packets AS (SELECT event_id AS pkt_id, epoch_us(ts)/1e6 AS ts, CASE WHEN k%2=0 THEN 'u'||user_id ELSE 'plc'||(user_id%5) END AS src_ip, CASE WHEN k%2=0 THEN 'plc'||(user_id%5) ELSE 'u'||user_id END AS dst_ip, 6 AS proto,
 CASE WHEN k%2=0 THEN (user_id+49152)::INT ELSE port END AS src_port, CASE WHEN k%2=0 THEN port ELSE (user_id+49152)::INT END AS dst_port, CASE WHEN event_type='error' THEN 128 ELSE 64 END AS ttl,
 k+40 AS length, k AS tcp_flags, k+8192 AS tcp_window, k, event_id, [1,3,6,16][(event_id%4+1)::INT] AS fc, k*20 AS addr, event_id%1000 AS val, (event_id%65536)::INT AS tid, CASE WHEN event_id%101=0 THEN 1 ELSE 0 END AS pid FROM raw_packets)""",
    "requests": """requests AS (SELECT l_orderkey*8+l_linenumber AS row_id, '10.0.0.'||(l_suppkey%300) AS src_ip, '10.0.1.'||(l_partkey%256) AS dst_ip, (l_partkey*37%70000)::INT AS src_port,
 [502,20000,44818,80,443,8080,9][l_linenumber] AS dst_port, CASE WHEN l_linenumber=5 THEN 300 ELSE 6 END AS protocol, l_quantity::INT AS fwd_packets, (l_linenumber-1)::INT AS bwd_packets,
 floor(l_extendedprice)::INT AS fwd_bytes, floor(floor(l_extendedprice)/2)::INT AS bwd_bytes, l_tax AS duration, l_discount AS iat_mean, l_tax AS iat_std, (l_linenumber%4)::INT AS fwd_psh, (l_linenumber%3)::INT AS bwd_psh FROM lineitem)""",
    "scores": """scores AS (SELECT doc_id, CASE WHEN doc_id%3=0 THEN 1 ELSE 0 END AS iso, CASE WHEN quality=0 THEN 1 ELSE 0 END AS xgb, CASE WHEN doc_id%5=0 THEN 1 ELSE 0 END AS rf, toxic::INT AS y, CASE WHEN doc_id%2=0 THEN 'ddos' ELSE 'replay' END AS attack_type FROM labels)""",
}
