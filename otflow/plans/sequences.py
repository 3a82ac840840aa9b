"""Queries over events: sessions, Markov chains, packets, inspection, rules, compliance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.knowledge import CRITICAL_REGISTERS, ZONES, values_sql
from ..operators import detectors as D
from ..operators import enrich as E
from ..operators import features as X
from ..operators import inspect as I
from ..operators import markov as M
from ..operators import packets as K
from ..operators import sessions as W
from ..operators.ordered import spread
from ..sources import adapters as A
from .registry import add

R = S.rounded
SECONDS = 21_600
FLAG = 0.36

# --- sessions ---
_GLOBAL = """SELECT row_id, round(d::DOUBLE,6) AS src_unique_dst_count, round(n::DOUBLE,6) AS src_flow_count, round(gap,4) AS src_inter_flow_interval,
 round(coalesce(var_samp(gap) OVER (PARTITION BY sIPs ORDER BY start, row_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),0),0) AS src_inter_flow_variance, round(pair/(n+1.0),6) AS src_dst_flow_ratio, round(ln(1+sPayloadSum),6) AS src_payload_entropy
 FROM (SELECT *, coalesce(start-lag(start) OVER (PARTITION BY sIPs ORDER BY start, row_id),0) AS gap, count(*) OVER (PARTITION BY sIPs) AS n, count(*) OVER (PARTITION BY sIPs, rIPs) AS pair, count(DISTINCT rIPs) OVER (PARTITION BY sIPs) AS d FROM sessions)"""


def session_columns(df):
    out = df.select("row_id", *X.SESSION)
    return out.select("row_id", *[F.round(c, 0 if c.endswith("variance") else 4 if c.endswith("interval") else 6).alias(c) for c in X.SESSION])


for _n in ("win_session_global", "feat_session_global", "join_session_to_flow"):
    add(_n, lambda s, d: session_columns(W.session_global(A.sessions(s, d))), _GLOBAL, "sessions")
_FRAME = f"near AS (SELECT a.row_id, count(*) AS n, count(DISTINCT b.rIPs) AS d, max(b.start)-min(b.start) AS span, list(b.start ORDER BY b.start) AS times, list(b.sPayloadAvg) AS payloads FROM sessions a JOIN sessions b ON a.sIPs=b.sIPs AND abs(a.start-b.start)<={SECONDS} GROUP BY 1)"
_HIST = "hist AS (SELECT row_id, -sum(p*log2(p)) AS e FROM (SELECT row_id, bin, count(*)/max(m)::DOUBLE AS p FROM (SELECT row_id, least(floor((x-lo)/(hi-lo)*10),9) AS bin, m FROM (SELECT row_id, unnest(v) AS x, list_min(v) AS lo, list_max(v) AS hi, len(v) AS m FROM (SELECT row_id, list_filter(payloads, lambda z: z>0) AS v FROM near)) WHERE hi>lo) GROUP BY 1,2) GROUP BY 1)"
_W60 = "SELECT row_id, round(d::DOUBLE,6) AS src_unique_dst_count, round(n::DOUBLE,6) AS src_flow_count, round(CASE WHEN n>1 THEN span/(n-1) ELSE 0 END,3) AS src_inter_flow_interval, round(CASE WHEN n>1 THEN list_var_pop(list_transform(range(1,n), lambda i: times[i+1]-times[i])) ELSE 0 END/1000,1) AS src_inter_flow_variance, round(n/greatest(d,1)::DOUBLE,6) AS src_dst_flow_ratio, round(coalesce(e,0),6) AS src_payload_entropy FROM near LEFT JOIN hist USING (row_id)"


def window_columns(df):
    return df.select("row_id", *[F.round(F.col(c) / (1000 if c.endswith("variance") else 1), {"src_inter_flow_interval": 3, "src_inter_flow_variance": 1}.get(c, 6)).alias(c) for c in X.SESSION])


for _n in ("win_session_60s", "win_session_60s_buckets"):
    add(_n, lambda s, d: window_columns(W.session_window(A.sessions(s, d), SECONDS)), _W60, "sessions", _FRAME, _HIST)
add("join_neighbours_60s", lambda s, d: W.neighbours(A.sessions(s, d).withColumn("payload", F.col("sPayloadAvg")), SECONDS).groupBy("row_id").agg(F.count(F.lit(1)).alias("n")), "SELECT row_id, n FROM near", "sessions", _FRAME)
add("fn_entropy_hist", lambda s, d: R(W.entropy_by(A.sessions(s, d), "sIPs", "sPayloadAvg")), "SELECT sIPs, round(coalesce(max(e),0),6) AS e FROM (SELECT sIPs, -sum(p*log2(p)) AS e FROM (SELECT sIPs, bin, count(*)/max(m)::DOUBLE AS p FROM (SELECT sIPs, least(floor((sPayloadAvg-lo)/(hi-lo)*10),9) AS bin, m FROM (SELECT *, min(sPayloadAvg) OVER (PARTITION BY sIPs) AS lo, max(sPayloadAvg) OVER (PARTITION BY sIPs) AS hi, count(*) OVER (PARTITION BY sIPs) AS m FROM sessions) WHERE hi>lo) GROUP BY 1,2) GROUP BY 1) GROUP BY 1", "sessions")
add("win_rate_excess", lambda s, d: W.rate_excess(A.sessions(s, d).select("row_id", "sIPs", "start"), "sIPs", "start", 3, 86_400).select("row_id", "in_window"), "SELECT row_id, n AS in_window FROM (SELECT row_id, count(*) OVER (PARTITION BY sIPs ORDER BY start RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM sessions) WHERE n>3", "sessions")
add("agg_analysis_window", lambda s, d: R(A.sessions(s, d).agg(F.min("start").alias("first"), F.max("start").alias("last")), 3), "SELECT round(min(start),3) AS first, round(max(start),3) AS last FROM sessions", "sessions")
add("fn_parse_timestamp", lambda s, d: A.table(s, d, "events").select("event_id", F.unix_seconds(S.parse_timestamp(F.when(F.col("event_id") % 7 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))).alias("t")), "SELECT event_id, CASE WHEN event_id%7<>0 THEN floor(epoch_us(ts)/1e6)::BIGINT END AS t FROM events")
add("fn_epoch_diff", lambda s, d: R(A.table(s, d, "events").select("event_id", (S.epoch(F.col("ts")) - F.lit(1704067200)).alias("seconds")), 4), "SELECT event_id, round(epoch_us(ts)/1e6-1704067200,4) AS seconds FROM events")
add("win_top_features", lambda s, d: W.top_per_key(spread(A.flows(s, d), "row_id").dropDuplicates(["row_id"]).groupBy("row_id").agg(F.lit(1).alias("one")).select("row_id", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), v.alias("value")) for n, v in (("a", F.col("row_id") % 7), ("b", -(F.col("row_id") % 5)), ("c", F.col("row_id") % 3))])).alias("x")).select("row_id", "x.feature", "x.value"), ["row_id"], [F.desc(F.abs("value")), F.col("feature")], 2), "SELECT row_id, feature, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(value) DESC, feature) AS rank FROM (SELECT row_id, unnest(['a','b','c']) AS feature, unnest([row_id%7, -(row_id%5), row_id%3]) AS value FROM (SELECT DISTINCT row_id FROM flows))) WHERE rank<=2", "flows")

# --- Markov ---
STATE = "(CASE WHEN src_port>=49152 THEN 'ephemeral' ELSE 'well-known' END||'|'||CASE WHEN dst_port IN (502,20000,44818,2404) THEN dst_port::VARCHAR ELSE 'other' END||'|'||CASE protocol WHEN 'tcp' THEN 'tcp' WHEN 'udp' THEN 'udp' ELSE 'other' END||'|'||fc)"
ST = f"st AS (SELECT *, {STATE} AS state FROM states)"
SEQ = "seq AS (SELECT *, lag(state) OVER (PARTITION BY src_ip ORDER BY ts, row_id) AS prev, lag(state) OVER (ORDER BY ts, row_id) AS gprev, count(*) OVER (PARTITION BY src_ip) AS rows_ FROM st)"
TRANS = "tr AS (SELECT '*' AS chain, gprev AS prev, state AS cur, count(*) AS n FROM seq WHERE gprev IS NOT NULL GROUP BY 1,2,3 UNION ALL SELECT src_ip, prev, state, count(*) FROM seq WHERE prev IS NOT NULL AND rows_>=5 GROUP BY 1,2,3)"
VOC = "voc AS (SELECT DISTINCT '*' AS chain, state FROM st UNION ALL SELECT DISTINCT src_ip, state FROM seq WHERE rows_>=5), ks AS (SELECT chain, count(*) AS k FROM voc GROUP BY 1), outs AS (SELECT chain, prev, sum(n) AS o FROM tr GROUP BY 1,2)"
SCORED = "scored AS (SELECT seq.row_id, seq.src_ip, seq.prev, seq.state AS cur, CASE WHEN v1.state IS NOT NULL AND v2.state IS NOT NULL THEN (coalesce(tr.n,0)+0.1)/(coalesce(outs.o,0)+0.1*ks.k) ELSE 1.0/(ks.k+1) END AS p FROM (SELECT *, CASE WHEN rows_>=5 THEN src_ip ELSE '*' END AS chain FROM seq) seq LEFT JOIN tr ON tr.chain=seq.chain AND tr.prev=seq.prev AND tr.cur=seq.state LEFT JOIN outs ON outs.chain=seq.chain AND outs.prev=seq.prev LEFT JOIN ks ON ks.chain=seq.chain LEFT JOIN voc v1 ON v1.chain=seq.chain AND v1.state=seq.prev LEFT JOIN voc v2 ON v2.chain=seq.chain AND v2.state=seq.state)"
FLAGGED = "flagged AS (SELECT *, CASE WHEN prev IS NULL THEN 0.0 ELSE 1/(1+exp(-0.5*(-ln(p)-3))) END AS sc FROM scored)"
MS, MT = ("states", ST, SEQ), ("states", ST, SEQ, TRANS)
MF = (*MT, VOC, SCORED, FLAGGED)


def model(s, d):
    return M.fit(A.states(s, d))


def scored(s, d):
    return M.score(A.states(s, d), model(s, d))


def flagged(s, d):
    return M.flag(A.states(s, d), model(s, d), FLAG)


for _n in ("markov_state", "fn_markov_state"):
    add(_n, lambda s, d: M.with_state(A.states(s, d)).select("row_id", "state"), "SELECT row_id, state FROM st", "states", ST)
add("win_markov_prev", lambda s, d: M.with_previous(M.with_state(A.states(s, d))).select("row_id", "state", "prev"), "SELECT row_id, state, prev FROM seq", *MS)
add("win_global_transitions", lambda s, d: M.global_transitions(M.with_state(A.states(s, d))).groupBy("prev", "cur").agg(F.count(F.lit(1)).alias("n")), "SELECT gprev AS prev, state AS cur, count(*) AS n FROM seq WHERE gprev IS NOT NULL GROUP BY 1,2", *MS)
for _n in ("agg_markov_transitions", "markov_fit"):
    add(_n, lambda s, d: model(s, d)["transitions"], "SELECT chain, prev, cur, n FROM tr", *MT)
add("markov_sizes", lambda s, d: model(s, d)["sizes"], "SELECT chain, k FROM ks", *MT, VOC)
for _n in ("markov_prob", "join_markov_prob"):
    add(_n, lambda s, d: R(scored(s, d).where("prev is not null").select("row_id", "p"), 8), "SELECT row_id, round(p,8) AS p FROM scored WHERE prev IS NOT NULL", *MT, VOC, SCORED)
add("markov_score", lambda s, d: R(scored(s, d).select("row_id", "src_ip", "transition_anomaly_score")), "SELECT row_id, src_ip, round(sc,6) AS transition_anomaly_score FROM flagged", *MF)
add("markov_flag", lambda s, d: flagged(s, d).select("row_id", "markov_anomaly"), "SELECT row_id, sc>=0.36 AS markov_anomaly FROM flagged", *MF)
add("markov_detect", lambda s, d: R(M.summary(flagged(s, d))), "SELECT true AS detected, n AS n_anomalous, round(n/t,4) AS fraction, CASE WHEN n/t>0.3 THEN 'critical' WHEN n/t>0.1 THEN 'high' WHEN n/t>0.03 THEN 'medium' ELSE 'low' END AS severity, round(c,6) AS confidence FROM (SELECT count(*)::DOUBLE AS t, count(*) FILTER (sc>=0.36) AS n, avg(sc) FILTER (sc>=0.36) AS c FROM flagged)", *MF)
add("top_flows", lambda s, d: R(M.top_flows(flagged(s, d))), "SELECT row_id, src_ip, round(sc,6) AS transition_anomaly_score FROM flagged WHERE sc>=0.36 ORDER BY row_id LIMIT 50", *MF)
add("markov_train_labelled", lambda s, d: M.fit_labelled(A.states(s, d))["transitions"].where(F.col("chain") == "*"), "SELECT '*' AS chain, gprev AS prev, state AS cur, count(*) AS n FROM (SELECT state, lag(state) OVER (ORDER BY ts, row_id) AS gprev FROM st WHERE label='Normal') WHERE gprev IS NOT NULL GROUP BY 2,3", "states", ST)

# --- packets ---
KEY = "keyed AS (SELECT *, CASE WHEN src_ip<dst_ip OR (src_ip=dst_ip AND src_port<=dst_port) THEN src_ip||':'||src_port||'>'||dst_ip||':'||dst_port ELSE dst_ip||':'||dst_port||'>'||src_ip||':'||src_port END AS fkey FROM packets)"
ORD = "ord AS (SELECT *, ts-lag(ts) OVER (PARTITION BY fkey ORDER BY ts, pkt_id) AS iat, first(src_ip) OVER (PARTITION BY fkey ORDER BY ts, pkt_id) AS head, first(src_port) OVER (PARTITION BY fkey ORDER BY ts, pkt_id) AS hport FROM keyed)"
DIR = "dir AS (SELECT *, (src_ip=head AND src_port=hport) AS fwd FROM ord)"
PK = ("packets", KEY, ORD, DIR)
_ASM = """SELECT any_value(head) AS src_ip, any_value(hport)::INT AS src_port, count(*) FILTER (fwd) AS fwd_packets, count(*) FILTER (NOT fwd) AS bwd_packets, coalesce(sum(length) FILTER (fwd),0)::BIGINT AS fwd_bytes, coalesce(sum(length) FILTER (NOT fwd),0)::BIGINT AS bwd_bytes,
 min(length) FILTER (fwd) AS fwd_size_min, max(length) FILTER (NOT fwd) AS bwd_size_max, round(avg(length) FILTER (fwd),6) AS fwd_size_avg, count(*) FILTER (fwd AND (tcp_flags&8)<>0) AS fwd_psh, count(*) FILTER (NOT fwd AND (tcp_flags&2)<>0) AS bwd_syn,
 arg_min(ttl, ts) FILTER (fwd) AS fwd_ttl, arg_min(tcp_window, ts) FILTER (NOT fwd) AS bwd_win, round(max(ts)-min(ts),3) AS span, round(avg(iat),3) AS iat_mean, round(stddev_pop(iat),2) AS iat_std FROM dir GROUP BY fkey"""


def assembled(s, d):
    return K.assemble(A.packets(s, d))


for _n in ("flow_assemble", "join_bidirectional_flow"):
    add(_n, lambda s, d: assembled(s, d).select("src_ip", "src_port", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "fwd_size_min", "bwd_size_max", F.round("fwd_size_avg", 6).alias("fwd_size_avg"), "fwd_psh", "bwd_syn", "fwd_ttl", "bwd_win", F.round(F.col("end") - F.col("start"), 3).alias("span"), F.round("iat_mean", 3).alias("iat_mean"), F.round("iat_std", 2).alias("iat_std")), _ASM, *PK)
add("win_iat", lambda s, d: R(K.iat(A.packets(s, d)).select("pkt_id", "iat"), 3), "SELECT pkt_id, round(iat,3) AS iat FROM ord", "packets", KEY, ORD)
_FPF = """SELECT src_ip, src_port, round(fp/greatest(bp,1.0),6) AS packet_ratio, round((fb+bb)/greatest(fp+bp,1.0),6) AS bytes_per_packet, round(abs((fb+bb)/greatest(fp+bp,1.0)-500),6) AS packet_size_anomaly, round(1-abs(fp-bp)/greatest(fp+bp,1.0),6) AS traffic_symmetry,
 round(fp/greatest(fp+bp,1.0)*(1-least(bp/greatest(fp,1.0),1.0)),6) AS scan_signature_score, round(psh/greatest(fp,1.0),6) AS src_psh_rate, round(CASE WHEN coalesce(ttl,0)=0 THEN 64.0 ELSE ttl END,6) AS src_ttl FROM (SELECT any_value(head) AS src_ip, any_value(hport)::INT AS src_port, count(*) FILTER (fwd) AS fp, count(*) FILTER (NOT fwd) AS bp, coalesce(sum(length) FILTER (fwd),0) AS fb, coalesce(sum(length) FILTER (NOT fwd),0) AS bb, count(*) FILTER (fwd AND (tcp_flags&8)<>0) AS psh, arg_min(ttl, ts) FILTER (fwd) AS ttl FROM dir GROUP BY fkey)"""
add("feat_from_packet_flow", lambda s, d: R(X.from_packet_flow(assembled(s, d)).select("src_ip", "src_port", "packet_ratio", "bytes_per_packet", "packet_size_anomaly", "traffic_symmetry", "scan_signature_score", "src_psh_rate", "src_ttl")), _FPF, *PK)
add("fn_tcp_flag", lambda s, d: A.packets(s, d).select("pkt_id", *[S.has_flag(F.col("tcp_flags"), b).alias(n) for n, b in K.FLAGS.items()]), "SELECT pkt_id, (tcp_flags&1)<>0 AS fin, (tcp_flags&2)<>0 AS syn, (tcp_flags&4)<>0 AS rst, (tcp_flags&8)<>0 AS psh, (tcp_flags&16)<>0 AS ack, (tcp_flags&32)<>0 AS urg FROM packets", "packets")
add("fn_bytes", lambda s, d: I.tcp(A.packets(s, d)).where("dst_port = 502").select("pkt_id", S.u16be(F.col("payload"), 0).alias("be"), S.u16le(F.col("payload"), 0).alias("le"), S.byte_at(F.col("payload"), 7).alias("byte"), S.hex_label(S.byte_at(F.col("payload"), 7)).alias("label")), "SELECT pkt_id, tid AS be, ((tid%256)*256+tid//256)::INT AS le, fc AS byte, '0x'||lpad(upper(to_hex(fc::BIGINT)),2,'0') AS label FROM packets WHERE dst_port=502", "packets")
for _n, _c, _sql in (("fn_u16be", lambda: S.u16be(F.col("payload"), 0), "tid"), ("fn_u16le", lambda: S.u16le(F.col("payload"), 0), "((tid%256)*256+tid//256)::INT"), ("fn_byte", lambda: S.byte_at(F.col("payload"), 7), "fc")):
    add(_n, lambda s, d, c=_c: I.tcp(A.packets(s, d)).where("dst_port = 502").select("pkt_id", c().alias("y")), f"SELECT pkt_id, {_sql} AS y FROM packets WHERE dst_port=502", "packets")

# --- inspection ---
add("dpi_route", lambda s, d: I.route(A.packets(s, d)).select("pkt_id", "protocol", "severity", "alert"), "SELECT pkt_id, p.name AS protocol, CASE WHEN p.name='BACnet' THEN 'MEDIUM' END AS severity, CASE WHEN p.name='BACnet' THEN 'BACnet detected on port 47808' END AS alert FROM packets JOIN (VALUES (502,'Modbus/TCP'),(20000,'DNP3'),(44818,'EtherNet/IP'),(102,'S7comm (Siemens)'),(4840,'OPC UA'),(47808,'BACnet')) p(port,name) ON dst_port=p.port", "packets")
CRIT = "((addr>=0 AND addr<300) OR (addr>=1000 AND addr<2000))"
MB = f"mb AS (SELECT *, CASE WHEN pid<>0 THEN 'CRITICAL' WHEN fc=3 AND {CRIT} THEN 'HIGH' WHEN fc=6 AND {CRIT} THEN 'CRITICAL' WHEN fc=6 THEN 'HIGH' WHEN fc=16 THEN 'CRITICAL' ELSE 'LOW' END AS severity, CASE WHEN pid<>0 THEN 'Invalid Modbus protocol ID: 0x0001 (should be 0x0000)' WHEN fc=3 AND {CRIT} THEN 'Read access to critical registers: '||addr||'-'||(addr+val) WHEN fc=6 AND {CRIT} THEN 'CRITICAL: Write to protected register '||addr WHEN fc=6 THEN 'Modbus WRITE to register '||addr||' = '||val WHEN fc=16 THEN 'Multiple register write: '||val||' registers starting at '||addr END AS alert FROM packets WHERE dst_port=502)"
add("dpi_modbus", lambda s, d: I.modbus(A.packets(s, d)).select("pkt_id", "protocol", "severity", "alert", "transaction_id", "unit_id", "function_code", "is_write", "address", "value", "is_malformed"), "SELECT pkt_id, 'Modbus/TCP' AS protocol, severity, alert, tid AS transaction_id, CASE WHEN pid=0 THEN k%8 END AS unit_id, CASE WHEN pid=0 THEN fc END AS function_code, CASE WHEN pid=0 THEN fc IN (6,16) END AS is_write, CASE WHEN pid=0 AND fc<>1 THEN addr END AS address, CASE WHEN pid=0 AND fc<>1 THEN val::INT END AS value, pid<>0 AS is_malformed FROM mb", "packets", MB)
add("dpi_dnp3", lambda s, d: I.dnp3(A.packets(s, d)), "SELECT pkt_id, 'DNP3' AS protocol, CASE WHEN t>65000 OR b>65000 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, t AS destination_address, b AS source_address, k AS frame_length, 196 AS control FROM (SELECT *, ((a%256)*256+a//256)::INT AS t, ((c%256)*256+c//256)::INT AS b FROM (SELECT *, (event_id*37%65536)::INT AS a, k*655 AS c FROM packets WHERE dst_port=20000))", "packets")
add("dpi_ethernetip", lambda s, d: I.ethernetip(A.packets(s, d)), "SELECT pkt_id, 'EtherNet/IP' AS protocol, CASE WHEN k%3<>0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN k%3<>0 THEN 'SendRRData' ELSE 'Unknown' END AS command FROM packets WHERE dst_port=44818", "packets")
add("dpi_s7comm", lambda s, d: I.s7comm(A.packets(s, d)), "SELECT pkt_id, 'S7comm' AS protocol, CASE WHEN k%3=0 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, CASE WHEN k%3=0 THEN k*10 END AS tpkt_length FROM packets WHERE dst_port=102", "packets")
add("dpi_opcua", lambda s, d: I.opcua(A.packets(s, d)), "SELECT pkt_id, 'OPC UA' AS protocol, 'MEDIUM' AS severity FROM packets WHERE dst_port=4840", "packets")
ALL = "ev AS (SELECT pkt_id, 'Modbus/TCP' AS protocol, severity, pid FROM mb UNION ALL SELECT pkt_id, 'DNP3', CASE WHEN ((event_id*37%65536)%256)*256+(event_id*37%65536)//256>65000 OR ((k*655)%256)*256+(k*655)//256>65000 THEN 'CRITICAL' ELSE 'HIGH' END, 0 FROM packets WHERE dst_port=20000 UNION ALL SELECT pkt_id, 'EtherNet/IP', CASE WHEN k%3<>0 THEN 'HIGH' ELSE 'MEDIUM' END, 0 FROM packets WHERE dst_port=44818 UNION ALL SELECT pkt_id, 'S7comm', CASE WHEN k%3=0 THEN 'CRITICAL' ELSE 'HIGH' END, 0 FROM packets WHERE dst_port=102 UNION ALL SELECT pkt_id, 'OPC UA', 'MEDIUM', 0 FROM packets WHERE dst_port=4840 UNION ALL SELECT pkt_id, 'BACnet', 'MEDIUM', 0 FROM packets WHERE dst_port=47808)"
add("dpi_alerts", lambda s, d: I.alerts(I.events(A.packets(s, d))), "SELECT pkt_id, protocol, severity FROM ev WHERE severity IN ('HIGH','CRITICAL')", "packets", MB, ALL)
add("agg_dpi_statistics", lambda s, d: I.statistics(A.packets(s, d)), "SELECT protocol, count(*) AS packets, sum((severity IN ('HIGH','CRITICAL'))::INT)::BIGINT AS alerts FROM ev WHERE pid=0 AND protocol<>'BACnet' GROUP BY 1", "packets", MB, ALL)
_W = "writes AS (SELECT * FROM mb WHERE pid=0 AND fc IN (6,16))"
add("det_write_dpi", lambda s, d: D.write_dpi(I.modbus(A.packets(s, d))).drop("confidence"), "SELECT pkt_id, 'unauthorized_write' AS pattern, CASE WHEN fc=16 OR severity='CRITICAL' THEN 'CRITICAL' ELSE 'HIGH' END AS severity, 'modbus_dpi' AS detection_source, tid AS transaction_id, k%8 AS unit_id, fc AS function_code, '0x'||lpad(upper(to_hex(fc::BIGINT)),2,'0') AS function_hex FROM writes", "packets", MB, _W)
add("det_modbus_write_dpi", lambda s, d: D.modbus_write_dpi(I.modbus(A.packets(s, d))).drop("confidence"), "SELECT pkt_id, 'modbus_write_dpi' AS pattern, CASE WHEN fc=16 OR severity='CRITICAL' THEN 'CRITICAL' ELSE 'HIGH' END AS severity, tid AS transaction_id, fc AS function_code, fc=16 AS is_bulk_write FROM writes", "packets", MB, _W)
for _n in ("join_novel_dpi", "except_novel_dpi"):
    add(_n, lambda s, d: D.novel_dpi(D.modbus_write_dpi(I.modbus(A.packets(s, d))), D.write_dpi(I.modbus(A.packets(s, d))).where("function_code = 6")).select("pkt_id", "transaction_id"), "SELECT pkt_id, tid AS transaction_id FROM writes WHERE tid NOT IN (SELECT tid FROM writes WHERE fc=6)", "packets", MB, _W)


def _confirmed(s, d):
    from .flows import found

    return D.dpi_confirm(found(s, d), D.write_dpi(I.modbus(A.packets(s, d)))).groupBy("pattern", "detection_source").agg(F.count(F.lit(1)).alias("n"))


from .flows import FD  # noqa: E402

add("join_dpi_confirm", _confirmed, "SELECT pattern, CASE WHEN pattern='unauthorized_write' AND (SELECT count(*) FROM writes)>0 THEN 'both' ELSE 'flow_features' END AS detection_source, count(*) AS n FROM detections GROUP BY 1,2", *FD, "packets", MB, _W)
add("join_critical_register", lambda s, d: I.critical_register(I.modbus(A.packets(s, d)).where("address is not null").select("pkt_id", "address")), "SELECT pkt_id, addr AS address, description FROM mb LEFT JOIN regs ON addr>=lo AND addr<hi WHERE pid=0 AND fc<>1", "packets", MB, values_sql(CRITICAL_REGISTERS, "lo, hi, description", "regs"))
_thr = lambda fc, n, w: f"SELECT src_ip, (floor(ts/{w})*{w})::BIGINT AS window_start, count(*) AS n FROM packets WHERE dst_port=502 AND pid=0 AND fc={fc} GROUP BY 1,2 HAVING count(*)>={n}"
add("rule_flooding", lambda s, d: I.rule_flooding(A.packets(s, d), 2, 86400), _thr(1, 2, 86400), "packets")
add("rule_scanning", lambda s, d: I.rule_scanning(A.packets(s, d), 2, 21600), _thr(1, 2, 21600), "packets")
add("rule_replay", lambda s, d: I.rule_replay(A.packets(s, d), 1, 600), _thr(3, 1, 600), "packets")
add("rule_unauthorized_write", lambda s, d: I.rule_unauthorized_write(A.packets(s, d)), "SELECT pkt_id, src_ip, dst_ip, fc FROM packets WHERE dst_port=502 AND pid=0 AND fc IN (6,16)", "packets")
add("rule_mitm", lambda s, d: I.rule_mitm(A.packets(s, d)), "SELECT pkt_id, src_ip, dst_ip FROM packets WHERE dst_port=502 AND ttl=128", "packets")

# --- compliance: one site a supplier nation ---
SITES = "sites AS (SELECT 'site'||n_nationkey AS site, n_nationkey AS k FROM nation)"


def sites(s, d):
    k = F.col("n_nationkey")
    flag = lambda m: k % m != 0
    return A.table(s, d, "nation").select(F.concat(F.lit("site"), k.cast("string")).alias("site"), flag(5).alias("auth"), flag(2).alias("mfa"), flag(7).alias("logging"), flag(3).alias("siem"), (k * 10).cast("int").alias("retention_days"), flag(4).alias("rbac"), flag(3).alias("least_privilege"), flag(2).alias("checksums"), flag(6).alias("signing"), flag(8).alias("detection"), F.lit("SL-3").alias("target_sl"))


AUTH = "CASE WHEN k%5=0 THEN 0.0 WHEN k%2<>0 THEN 1.0 ELSE 0.6 END"
LOGG = "CASE WHEN k%7=0 THEN 0.0 WHEN k%3<>0 AND k*10>=90 THEN 1.0 WHEN k*10>=90 THEN 0.7 ELSE 0.5 END"
ACC = "CASE WHEN k%4<>0 AND k%3<>0 THEN 1.0 WHEN k%4<>0 THEN 0.7 ELSE 0.3 END"
INTG = "CASE WHEN k%2<>0 AND k%6<>0 THEN 1.0 WHEN k%2<>0 OR k%6<>0 THEN 0.6 ELSE 0.2 END"
for _n, _c, _sql in (("iec_authentication", "authentication", AUTH), ("iec_logging", "logging", LOGG), ("iec_access_control", "access_control", ACC), ("iec_data_integrity", "data_integrity", INTG)):
    add(_n, lambda s, d, c=_c: E.site_scores(sites(s, d)).select("site", c), f"SELECT site, ({_sql})::DOUBLE AS {_c} FROM sites", SITES)
add("iec_segmentation", lambda s, d: R(E.segmentation(A.flows(s, d)).drop("ratio_text")), "SELECT round(r,6) AS ratio, round(greatest(1-2*r,0),6) AS score, CASE WHEN greatest(1-2*r,0)>=0.8 THEN 'COMPLIANT' WHEN greatest(1-2*r,0)>=0.5 THEN 'PARTIAL' ELSE 'NON-COMPLIANT' END AS status FROM (SELECT avg((dst_port IN (502,20000,44818,102,4840))::INT) AS r FROM flows)", "flows")
_rate = "rate AS (SELECT 100*avg(IT_B_Label) AS rate FROM flows)"


def rate(s, d):
    return A.flows(s, d).agg((100 * F.avg("IT_B_Label")).alias("rate"))


def _anomaly(s, d):
    score, status = E.anomaly_detection(F.col("rate"), F.col("detection"))
    return sites(s, d).crossJoin(F.broadcast(rate(s, d))).select("site", score.alias("score"), status.alias("status"))


ANOM = "CASE WHEN k%8=0 THEN 0.0 WHEN rate BETWEEN 5 AND 15 THEN 1.0 WHEN rate<5 THEN 0.6 ELSE 0.7 END"
add("iec_anomaly_detection", _anomaly, f"SELECT site, ({ANOM})::DOUBLE AS score, CASE WHEN ({ANOM})>=1 THEN 'COMPLIANT' WHEN ({ANOM})>0 THEN 'PARTIAL' ELSE 'NON-COMPLIANT' END AS status FROM sites, rate", "flows", SITES, _rate)
REP = f"rep AS (SELECT site, greatest(1-2*r,0) AS segmentation, ({ANOM})::DOUBLE AS anomaly_detection, ({AUTH})::DOUBLE AS authentication, ({LOGG})::DOUBLE AS logging, ({ACC})::DOUBLE AS access_control, ({INTG})::DOUBLE AS data_integrity FROM sites, rate, (SELECT avg((dst_port IN (502,20000,44818,102,4840))::INT) AS r FROM flows)), full_rep AS (SELECT *, (segmentation+anomaly_detection+authentication+logging+access_control+data_integrity)/6 AS overall FROM rep)"


def report(s, d):
    return E.compliance_report(sites(s, d), E.segmentation(A.flows(s, d)), rate(s, d))


LEVEL = "CASE WHEN overall>=0.95 THEN 'SL-4' WHEN overall>=0.8 THEN 'SL-3' WHEN overall>=0.6 THEN 'SL-2' WHEN overall>=0.4 THEN 'SL-1' ELSE 'Below SL-1' END"
for _n in ("iec_report", "agg_compliance_score"):
    add(_n, lambda s, d: R(report(s, d).select("site", "overall", "level", "compliant")), f"SELECT site, round(overall,6) AS overall, {LEVEL} AS level, ((segmentation>=0.8)::INT+(anomaly_detection>=0.8)::INT+(authentication>=0.8)::INT+(logging>=0.8)::INT+(access_control>=0.8)::INT+(data_integrity>=0.8)::INT) AS compliant FROM full_rep", "flows", SITES, _rate, REP)
add("top_compliance_gaps", lambda s, d: R(E.compliance_gaps(report(s, d))), "SELECT site, unnest(['segmentation','anomaly_detection','authentication','logging','access_control','data_integrity']) AS requirement, unnest([round(segmentation,6),anomaly_detection,authentication,logging,access_control,data_integrity]) AS score FROM rep", "flows", SITES, _rate, REP)
add("iec_zones", lambda s, d: E.zones(s).join(A.packets(s, d).groupBy((F.col("pkt_id") % 5).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n")), "level"), "SELECT level, zone, count(*) AS n FROM packets JOIN zones ON (pkt_id%5)=level GROUP BY 1,2", "packets", values_sql(ZONES, "level, zone", "zones"))
