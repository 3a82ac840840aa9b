"""Queries over flows: features, detectors, profile, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.knowledge import CVE_KEYWORDS, DEFAULT_MITIGATION, IEC_VIOLATIONS, MITIGATIONS, MITRE, PATTERNS, RULES, VENDORS, values_sql
from ..operators import detectors as D
from ..operators import enrich as E
from ..operators import features as X
from ..operators import ml as ML
from ..operators import profile as P
from ..operators import sessions as W
from ..operators.ordered import spread
from ..sources import adapters as A
from .registry import add

R = S.rounded
Z = "coalesce({},0)"


def _round(columns: dict[str, str], digits: int = 6) -> str:
    step = f"1e{digits}::DOUBLE"
    return ", ".join(f"floor(({v})::DOUBLE*{step}+0.5000001::DOUBLE)/{step} AS {k}" for k, v in columns.items())


DUR = "(CASE WHEN duration=0 THEN 0.001 ELSE duration END)"
BASIC = {"src_packets": "sPackets", "dst_packets": "rPackets", "src_bytes": "sBytesSum", "dst_bytes": "rBytesSum", "flow_duration": "duration", "total_packets": "sPackets+rPackets", "packet_ratio": "sPackets/(rPackets+1)", "total_bytes": "sBytesSum+rBytesSum", "byte_ratio": "sBytesSum/(rBytesSum+1)", "bytes_per_packet": "(sBytesSum+rBytesSum)/(sPackets+rPackets+1)"}
TIMING = {"src_inter_packet_avg": "sInterPacketAvg", "dst_inter_packet_avg": "rInterPacketAvg", "src_packet_rate": f"sPackets/{DUR}", "src_byte_rate": f"sBytesSum/{DUR}", "dst_packet_rate": f"rPackets/{DUR}", "dst_byte_rate": f"rBytesSum/{DUR}"}
STAT = {n: f"coalesce({c},0)" for n, c in X.STATISTICAL if c != "rPayloadSum"}
PROTO = {n: f"coalesce({c},{d})" for n, c, d in X.PROTOCOL}
BEHAV = {"syn_ack_imbalance": "sSynRate-sAckRate", "packet_size_anomaly": "abs(sBytesSum/(sPackets+1)-(SELECT avg(sBytesSum/(sPackets+1)) FROM flows))", "reset_rate_total": "sRstRate+rRstRate", "traffic_symmetry": "1-abs(sPackets-rPackets)/(sPackets+rPackets+1)"}
ENGIN = {"byte_rate_asymmetry": f"abs(sBytesSum/{DUR}-rBytesSum/{DUR})/(sBytesSum/{DUR}+rBytesSum/{DUR}+1)"}
ADVANCED = {"src_bytes_per_packet": "sBytesSum/(sPackets+1)", "dst_bytes_per_packet": "rBytesSum/(rPackets+1)", "src_bytes_range": "sBytesMax-sBytesMin", "src_bytes_cv": "(sBytesMax-sBytesMin)/(sBytesAvg+1)", "total_packet_rate": f"(sPackets+rPackets)/{DUR}"}
ZERO = {c: "0.0" for c in X.SESSION}
V1 = BASIC | TIMING | STAT | PROTO | BEHAV | ENGIN | ZERO
V2 = BASIC | TIMING | STAT | PROTO | BEHAV | ADVANCED | ENGIN | ZERO
TARGETED = {"inter_packet_timing_asymmetry": "abs(sInterPacketAvg-rInterPacketAvg)", "timing_regularity": f"least(1/(abs(sInterPacketAvg-{DUR}/(sPackets+1))+0.001),1000)", "payload_size_consistency": "sPayloadAvg/(CASE WHEN sBytesMax=0 THEN 1 ELSE sBytesMax END)", "scan_signature_score": "least(sPackets/(duration+0.001)/(sBytesAvg+1),1000)", "flow_burstiness": "(sBytesMax-sBytesAvg)/(sBytesAvg+1)"}

for _name, _sql in {"network_basic": BASIC, "timing": TIMING, "statistical": STAT, "protocol": PROTO, "behavioral": BEHAV, "network_advanced": ADVANCED, "engineered": ENGIN}.items():
    _digits = 4 if _name == "behavioral" else 6
    add(f"feat_{_name}", lambda s, d, n=_name, k=_digits: S.settled(X.group(A.flows(s, d), n), k), f"SELECT row_id, {_round(_sql, _digits)} FROM flows", "flows")
for _v, _sql in ((1, V1), (2, V2)):
    add(f"feat_all_v{_v}", lambda s, d, v=_v: S.settled(X.feature_table(A.flows(s, d), v), 4), f"SELECT row_id, {_round(_sql, 4)} FROM flows", "flows")
add("feat_targeted", lambda s, d: S.settled(A.flows(s, d).transform(lambda f: f.select("row_id", *[c.alias(n) for n, c in X.targeted(f).items()]))), f"SELECT row_id, {_round(TARGETED)} FROM flows", "flows")
REQ = {"src_packets": "fwd_packets", "dst_packets": "bwd_packets", "src_bytes": "fwd_bytes", "dst_bytes": "bwd_bytes", "flow_duration": "duration", "total_packets": "fwd_packets+bwd_packets", "packet_ratio": "fwd_packets/greatest(bwd_packets,1.0)", "total_bytes": "fwd_bytes+bwd_bytes", "byte_ratio": "fwd_bytes/greatest(bwd_bytes,1.0)", "bytes_per_packet": "(fwd_bytes+bwd_bytes)/greatest(fwd_packets+bwd_packets,1.0)", "src_inter_packet_avg": "iat_mean", "src_packet_rate": "fwd_packets/greatest(duration,0.001)", "dst_packet_rate": "bwd_packets/greatest(duration,0.001)", "src_load": "fwd_bytes/greatest(duration,0.001)", "dst_load": "bwd_bytes/greatest(duration,0.001)", "syn_ack_imbalance": "abs(fwd_psh-bwd_psh)/greatest(fwd_packets+bwd_packets,1.0)", "timing_regularity": "1/(1+iat_std)", "flow_burstiness": "iat_std/greatest(iat_mean,0.001)"}
add("feat_from_api_flow", lambda s, d: S.settled(X.from_request(A.requests(s, d)), 4), f"SELECT row_id, {_round(REQ, 4)} FROM requests", "requests")
add("align_features", lambda s, d: R(X.align(X.group(A.flows(s, d), "network_basic"), ["total_bytes", "absent", "src_packets"])), "SELECT row_id, round(sBytesSum+rBytesSum,6) AS total_bytes, 0.0::DOUBLE AS absent, round(sPackets,6) AS src_packets FROM flows", "flows")
add("label_binary", lambda s, d: A.flows(s, d).transform(lambda f: f.select("row_id", X.label_binary(f).alias("label"))), "SELECT row_id, IT_B_Label AS label FROM flows", "flows")
add("label_text_fix", lambda s, d: A.flows(s, d).select("row_id", X.label_text_fix(F.concat(F.lit(" "), F.upper("IT_M_Label"))).alias("label")), "SELECT row_id, CASE WHEN lower(trim(' '||upper(IT_M_Label)))<>'normal' THEN 1 ELSE 0 END AS label FROM flows", "flows")
add("sanitize", lambda s, d: R(S.sanitize(A.flows(s, d).select("row_id", F.try_divide("sPackets", "duration").alias("rate"), F.when(F.col("sPackets") > 40, float("inf")).when(F.col("sPackets") > 30, float("nan")).otherwise(F.col("sPackets")).alias("odd")), ["rate", "odd"]), 4), "SELECT row_id, round(CASE WHEN duration=0 THEN 0 ELSE sPackets/duration END,4) AS rate, CASE WHEN sPackets>30 THEN 0.0 ELSE sPackets END AS odd FROM flows", "flows")
add("select_well_filled", lambda s, d: A.flows(s, d).transform(lambda f: f.select("row_id", F.when(F.lit(False), F.col("rttl")).alias("empty"), "rttl", "sttl")).transform(lambda f: f.select(*X.well_filled(f, 0.5))), "SELECT row_id, rttl, sttl FROM flows", "flows")

# --- detectors; thresholds fit the value range of the adapter ---
T = {"flood_rate": 1000.0, "flood_packets": 30.0, "scan_packet_ratio": 0.5, "scan_dst_packets": 7.0, "scan_byte_ratio": 1.2, "fuzz_size": 300.0, "mitm_low": 0.85, "mitm_high": 1.15, "mitm_symmetry": 0.9, "time_iat": 0.01, "time_packets": 20.0, "time_low": 0.5, "time_high": 8.0, "time_rate": 2000.0, "replay_low": 0.9, "replay_high": 1.1, "replay_symmetry": 0.9, "cred_packets": 40.0, "firmware_bytes": 50_000.0, "firmware_ratio": 5.0}
_conf = lambda v, lo, hi: f"least(greatest(0.5+0.5*(({v})-({lo}))/(({hi})-({lo})),0.5),1.0)"
DET = {
    "modbus_flooding": ("src_packet_rate>1000 AND total_packets>30", _conf("src_packet_rate", 1000, 3000)),
    "plc_scanning": ("packet_ratio<0.5 AND dst_packets<=7 AND byte_ratio<1.2", _conf("1/greatest(packet_ratio,1e-6)", 2, 20)),
    "unauthorized_write": ("src_psh_rate>0.4 AND src_packet_rate>50 AND src_rst_rate>0", _conf("src_psh_rate", 0.4, 1)),
    "protocol_fuzzing": ("packet_size_anomaly>300 AND (src_urg_rate>0.01 OR bytes_per_packet<25)", _conf("packet_size_anomaly", 300, 800)),
    "man_in_the_middle": ("traffic_symmetry>0.9 AND byte_ratio BETWEEN 0.85 AND 1.15 AND src_ttl=128", _conf("traffic_symmetry", 0.9, 1)),
    "command_injection": ("src_psh_rate>0.5 AND dst_psh_rate<0.1 AND src_packet_rate>15", _conf("src_psh_rate-dst_psh_rate", 0.5, 1)),
    "time_based_attack": ("src_inter_packet_avg>0 AND src_inter_packet_avg<0.01 AND total_packets>20 AND dst_inter_packet_avg/greatest(src_inter_packet_avg,1e-9) BETWEEN 0.5 AND 8.0 AND src_packet_rate<1000 AND src_packet_rate<2000", _conf("0.01-src_inter_packet_avg", 0, 0.01)),
    "replay_attack": ("byte_ratio BETWEEN 0.9 AND 1.1 AND packet_ratio BETWEEN 0.9 AND 1.1 AND traffic_symmetry>0.9", _conf("traffic_symmetry", 0.9, 1)),
    "credential_stuffing": ("syn_ack_imbalance>0.3 AND total_packets<40 AND src_fin_rate>0.1 AND src_syn_rate>0.3", _conf("syn_ack_imbalance", 0.3, 1)),
    "firmware_modification": ("total_bytes>50000 AND bytes_per_packet>70 AND packet_ratio<5", _conf("total_bytes", 50000, 500000)),
}
FEATURES_SQL = "feats AS (SELECT row_id, sIPs, rIPs, " + ", ".join(f"({v})::DOUBLE AS {k}" for k, v in (BASIC | TIMING | PROTO | BEHAV).items()) + " FROM flows)"
SEV = {p[0]: p[1] for p in PATTERNS}
_one = lambda n: f"SELECT row_id, '{n}' AS pattern, '{SEV[n]}' AS severity, round({DET[n][1]}, 5) AS confidence FROM feats WHERE {DET[n][0]}"
DETECTIONS_SQL = "detections AS (" + " UNION ALL ".join(_one(n) for n in DET) + ")"
SUMMARY_SQL = "summary AS (SELECT pattern, count(*) AS n_flows, min(severity) AS severity, avg(confidence) AS confidence FROM detections GROUP BY 1)"
FD = ("flows", FEATURES_SQL, DETECTIONS_SQL)
FDS = (*FD, SUMMARY_SQL)


def features(s, d):
    return X.feature_table(A.flows(s, d), 2, sessions=False)


def found(s, d):
    return D.detect(features(s, d), T)


def marked(s, d):
    flows = A.flows(s, d)
    held = X.feature_table(flows, 2, ("row_id", "sIPs", "rIPs"), X.mean_packet_size(flows), sessions=False)
    marks, names = D.marks(held, T)
    return held.select("row_id", "sIPs", "rIPs", marks.alias("marks")), names


def summary(s, d):
    return E.pattern_summary(found(s, d))


for _n in DET:
    add(f"det_{_n}", lambda s, d, n=_n: R(D.detect_one(features(s, d), n, T).select("row_id", "pattern", "severity", "confidence"), 5), _one(_n), "flows", FEATURES_SQL)
add("det_all", lambda s, d: R(found(s, d).select("row_id", "pattern", "severity", "confidence"), 5), "SELECT * FROM detections", *FD)
add("union_detections", lambda s, d: R(found(s, d).select("row_id", "pattern", "severity", "detection_source", "confidence", F.size("details").alias("n_details")), 5), "SELECT row_id, pattern, severity, 'flow_features' AS detection_source, confidence, CASE pattern WHEN 'modbus_flooding' THEN 2 WHEN 'time_based_attack' THEN 4 WHEN 'credential_stuffing' THEN 4 ELSE 3 END AS n_details FROM detections", *FD)
DIM = values_sql([(i, *p) for i, p in enumerate(PATTERNS)], "ord, pattern, severity, name, technique", "dim")
add("agg_detections_by_pattern", lambda s, d: D.by_pattern(found(s, d)), "SELECT dim.pattern, count(detections.row_id) AS n FROM dim LEFT JOIN detections USING (pattern) GROUP BY 1", *FD, DIM)
add("agg_severity_breakdown", lambda s, d: D.by_severity(found(s, d)), "SELECT s.severity, count(detections.row_id) AS n FROM (VALUES ('CRITICAL'),('HIGH'),('MEDIUM'),('LOW')) s(severity) LEFT JOIN detections USING (severity) GROUP BY 1", *FD)
add("join_pattern_info", lambda s, d: R(E.pattern_info(found(s, d)).select("row_id", "pattern", "confidence", "name", "technique"), 5), "SELECT row_id, pattern, confidence, name, technique FROM detections LEFT JOIN dim USING (pattern)", *FD, DIM)
add("agg_pattern_summary", lambda s, d: R(summary(s, d), 4), "SELECT pattern, n_flows, severity, round(confidence,4) AS confidence, true AS detected FROM summary", *FDS)
add("agg_affected_ips", lambda s, d: E.affected_ips(*marked(s, d)), "SELECT pattern, count(*) AS n_ips, array_to_string(list_sort(list(ip))[1:5], ',') AS first_ips FROM (SELECT DISTINCT pattern, unnest([sIPs, rIPs]) AS ip FROM detections JOIN flows USING (row_id)) GROUP BY 1", *FD)
add("top_examples", lambda s, d: E.top_examples(found(s, d).groupBy("row_id", "pattern").agg(F.max("confidence").alias("confidence"))), "SELECT pattern, place::INT AS place, row_id, greatest(total-3,0) AS more FROM (SELECT pattern, row_id, row_number() OVER (PARTITION BY pattern ORDER BY row_id) AS place, count(*) OVER (PARTITION BY pattern) AS total FROM (SELECT DISTINCT row_id, pattern FROM detections)) WHERE place<=3", *FD)
add("threat_report_rows", lambda s, d: R(E.pattern_info(summary(s, d)).select("pattern", F.col("n_flows").alias("instances"), "severity", "name", "technique")), "SELECT pattern, n_flows AS instances, summary.severity, name, technique FROM summary JOIN dim USING (pattern)", *FDS, DIM)
RANK = "(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END)"
TITLE = "array_to_string(list_transform(string_split(pattern,'_'), lambda w: upper(w[1])||w[2:]),' ')"
for _n in ("sort_timeline", "report_timeline"):
    add(_n, lambda s, d: E.timeline(summary(s, d)), f"SELECT pattern, severity, {RANK}::INT AS rank, {TITLE} AS title, row_number() OVER (ORDER BY {RANK} DESC, pattern)::INT AS place FROM summary", *FDS)
add("fn_title", lambda s, d: E.timeline(summary(s, d)).select("pattern", "title"), f"SELECT pattern, {TITLE} AS title FROM summary", *FDS)
add("report_summary", lambda s, d: E.report_summary(summary(s, d)), f"SELECT count(*) AS n_patterns, max_by(severity, {RANK}) AS max_severity, sum(n_flows)::BIGINT AS total_flows FROM summary", *FDS)
_mitre = values_sql([(i, *p) for i, p in enumerate(MITRE)], "ord, pattern, technique_id, technique_name, tactic", "mitre")
_TECH = "SELECT pattern, technique_id, technique_name, tactic, 'https://attack.mitre.org/techniques/'||technique_id||'/' AS url FROM (SELECT *, row_number() OVER (PARTITION BY technique_id ORDER BY ord) AS t FROM summary JOIN mitre USING (pattern)) WHERE t=1"
for _n in ("join_mitre", "win_dedup_technique", "report_mitre"):
    add(_n, lambda s, d: E.techniques(summary(s, d)), _TECH, *FDS, _mitre)
for _n in ("join_iec_violation", "report_iec"):
    add(_n, lambda s, d: E.iec_violations(summary(s, d)), "SELECT pattern, requirement, description, required_sl FROM summary JOIN iec USING (pattern)", *FDS, values_sql(IEC_VIOLATIONS, "pattern, requirement, description, required_sl", "iec"))
_steps = values_sql([(p, i, t) for p, x in MITIGATIONS.items() for i, t in enumerate(x)], "pattern, step, text", "steps")
for _n in ("join_mitigations", "report_mitigations"):
    add(_n, lambda s, d: E.mitigations(summary(s, d)), f"SELECT pattern, coalesce(step,0)::INT AS step, coalesce(text,'{DEFAULT_MITIGATION}') AS text FROM summary LEFT JOIN steps USING (pattern)", *FDS, _steps)
add("stix_objects", lambda s, d: E.stix_objects(summary(s, d)).groupBy("type").agg(F.count(F.lit(1)).alias("n")), "SELECT 'identity' AS type, 1::BIGINT AS n UNION ALL SELECT 'indicator', count(*) FROM summary JOIN mitre USING (pattern) UNION ALL SELECT 'attack-pattern', count(DISTINCT technique_id) FROM summary JOIN mitre USING (pattern) UNION ALL SELECT 'relationship', count(*) FROM summary JOIN mitre USING (pattern)", *FDS, _mitre)
add("rule_text", lambda s, d: E.rule_text(summary(s, d)).select("sid", "pattern"), "SELECT sid::BIGINT AS sid, pattern FROM summary JOIN rules USING (pattern) UNION ALL SELECT sid::BIGINT+50, pattern FROM summary JOIN rules USING (pattern) WHERE pattern='unauthorized_write'", *FDS, values_sql(RULES, "pattern, sid, classtype, priority", "rules"))

# --- joins of tables ---
add("join_features_labels", lambda s, d: R(spread(A.flows(s, d), "row_id").transform(lambda f: X.group(f.dropDuplicates(["row_id"]).select("row_id", "sPackets", "rPackets", "sBytesSum", "rBytesSum", "duration"), "network_basic").groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).join(f.groupBy("row_id").agg(F.max("IT_B_Label").alias("label")), "row_id"))), "SELECT row_id, 1::BIGINT AS n, max(IT_B_Label) AS label FROM flows GROUP BY 1", "flows")
add("join_port_protocol", lambda s, d: E.port_protocol(A.flows(s, d)).select("row_id", "dst_port", "protocol_name"), "SELECT row_id, dst_port, CASE dst_port WHEN 502 THEN 'Modbus/TCP' WHEN 20000 THEN 'DNP3' WHEN 44818 THEN 'EtherNet/IP' WHEN 102 THEN 'S7comm' WHEN 4840 THEN 'OPC UA' WHEN 47808 THEN 'BACnet' END AS protocol_name FROM flows", "flows")
ZONE = "CASE WHEN dst_port IN (502,20000) THEN 'Level 1 - Process Control' WHEN dst_port IN (44818,2222) THEN 'Level 1 - Field Devices' WHEN dst_port IN (80,443,8080) THEN 'Level 2 - Supervisory Control' ELSE 'Level 3 - Enterprise Network' END"
ZSEV = "CASE WHEN abs({0})>0.6 THEN 'CRITICAL' WHEN abs({0})>0.5 THEN 'HIGH' WHEN dst_port IN (502,20000) THEN 'CRITICAL' WHEN dst_port IN (44818,2222) THEN 'HIGH' WHEN dst_port IN (80,443,8080) THEN 'MEDIUM' ELSE 'LOW' END"
SCORE = "(sPackets/50)"
for _n in ("join_port_zone", "fn_zone_severity"):
    add(_n, lambda s, d: E.port_zone(A.flows(s, d), F.col("sPackets") / 50).select("row_id", "zone", "zone_severity"), f"SELECT row_id, {ZONE} AS zone, {ZSEV.format(SCORE)} AS zone_severity FROM flows", "flows")
add("fn_recommended_action", lambda s, d: E.port_zone(A.flows(s, d), F.col("sPackets") / 50).select("row_id", S.recommended_action(F.col("zone_severity"), F.col("IT_B_Label") == 1).alias("action")), f"SELECT row_id, CASE WHEN IT_B_Label=0 THEN 'No action required - normal traffic' ELSE CASE {ZSEV.format(SCORE)} WHEN 'CRITICAL' THEN 'IMMEDIATE: Isolate affected zone, activate incident response' WHEN 'HIGH' THEN 'Investigate immediately, consider traffic blocking' WHEN 'MEDIUM' THEN 'Monitor closely, log for investigation' ELSE 'Log and review during routine audit' END END AS action FROM flows", "flows")
add("fn_severity_from_score", lambda s, d: A.flows(s, d).select("row_id", S.severity_from_score(F.col("sPackets") / 70, F.col("IT_B_Label") == 1).alias("severity")), "SELECT row_id, CASE WHEN IT_B_Label=0 THEN 'NORMAL' WHEN sPackets/70>0.6 THEN 'CRITICAL' WHEN sPackets/70>0.5 THEN 'HIGH' WHEN sPackets/70>0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM flows", "flows")
add("fn_confidence", lambda s, d: R(A.flows(s, d).select("row_id", S.confidence(F.col("sPackets"), 10, 40).alias("c"))), f"SELECT row_id, round({_conf('sPackets', 10, 40)},6) AS c FROM flows", "flows")
add("fn_sigmoid", lambda s, d: R(A.flows(s, d).select("row_id", S.sigmoid(F.col("rPackets")).alias("y"))), "SELECT row_id, round(1/(1+exp(-0.5*(rPackets-3))),6) AS y FROM flows", "flows")
add("fn_cvss_severity", lambda s, d: A.flows(s, d).select("row_id", S.cvss_severity(F.when(F.col("rPackets") < 7, F.col("sPackets") / 5)).alias("severity")), "SELECT row_id, CASE WHEN rPackets>=7 THEN 'UNKNOWN' WHEN sPackets/5>=9 THEN 'CRITICAL' WHEN sPackets/5>=7 THEN 'HIGH' WHEN sPackets/5>=4 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM flows", "flows")
for _n in ("fn_cvss_to_sl", "join_cvss_sl"):
    add(_n, lambda s, d: A.flows(s, d).select("row_id", S.cvss_to_sl(F.when(F.col("rPackets") < 7, F.col("sPackets") / 5)).alias("sl")), "SELECT row_id, CASE WHEN rPackets>=7 THEN 'SL-1' WHEN sPackets/5>=9 THEN 'SL-4' WHEN sPackets/5>=7 THEN 'SL-3' WHEN sPackets/5>=4 THEN 'SL-2' ELSE 'SL-1' END AS sl FROM flows", "flows")
add("fn_numeric", lambda s, d: R(A.flows(s, d).select("row_id", S.filled("rttl", 64.0).alias("filled"), S.safe_duration(F.col("duration")).alias("eps"), S.clip(F.col("sPackets"), 10.0, 40.0).alias("clipped"), F.abs(F.col("sPackets") - 25).alias("absolute"), F.log1p("sBytesSum").alias("logged"), F.bround(F.col("sPackets") / 8, 2).alias("half_even"))), "SELECT row_id, coalesce(rttl,64.0) AS filled, CASE WHEN duration=0 THEN 0.001 ELSE duration END AS eps, least(greatest(sPackets,10.0),40.0) AS clipped, abs(sPackets-25) AS absolute, round(ln(1+sBytesSum),6) AS logged, round_even(sPackets/8,2) AS half_even FROM flows", "flows")
for _n, _c, _sql in (
    ("fn_fillna", lambda: S.filled("rttl", 64.0), "coalesce(rttl,64.0)"), ("fn_zero_to_eps", lambda: S.safe_duration(F.col("duration")), "CASE WHEN duration=0 THEN 0.001 ELSE duration END"), ("fn_clip", lambda: S.clip(F.col("sPackets"), 10.0, 40.0), "least(greatest(sPackets,10.0),40.0)"),
    ("fn_abs", lambda: F.abs(F.col("sPackets") - 25), "abs(sPackets-25)"), ("fn_percent_text", lambda: S.percent_text(F.col("duration")), "printf('%.1f%%', duration*100)"), ("fn_truncate", lambda: S.cut(F.col("sIPs"), 2), "sIPs[1:2]"),
    ("fn_hex_label", lambda: S.hex_label(F.col("sPackets").cast("int")), "'0x'||lpad(upper(to_hex(sPackets::BIGINT)),2,'0')"),
):
    add(_n, lambda s, d, c=_c: A.flows(s, d).select("row_id", c().alias("y")), f"SELECT row_id, {_sql} AS y FROM flows", "flows")
add("fn_safe_div", lambda s, d: R(A.flows(s, d).select("row_id", S.over_at_least(F.col("sPackets"), F.col("rPackets") - 1).alias("a"), S.over_one_more(F.col("sPackets"), F.col("rPackets")).alias("b"))), "SELECT row_id, round(sPackets/greatest(rPackets-1,1.0),6) AS a, round(sPackets/(rPackets+1),6) AS b FROM flows", "flows")
add("fn_text", lambda s, d: A.flows(s, d).select("row_id", S.percent_text(F.col("duration")).alias("percent"), F.substring("sIPs", 1, 2).alias("cut"), S.hex_label(F.col("sPackets").cast("int")).alias("hexed")), "SELECT row_id, printf('%.1f%%', duration*100) AS percent, sIPs[1:2] AS cut, '0x'||lpad(upper(to_hex(sPackets::BIGINT)),2,'0') AS hexed FROM flows", "flows")
add("filter_ics_ports", lambda s, d: A.flows(s, d).where(F.col("dst_port").isin(502, 20000, 44818, 102, 4840)).select("row_id", "dst_port"), "SELECT row_id, dst_port FROM flows WHERE dst_port IN (502,20000,44818,102,4840)", "flows")
add("filter_normal", lambda s, d: A.flows(s, d).where("IT_M_Label = 'Normal'").select("row_id", "IT_M_Label"), "SELECT row_id, IT_M_Label FROM flows WHERE IT_M_Label='Normal'", "flows")
VALID = "src_port BETWEEN 0 AND 65535 AND dst_port BETWEEN 0 AND 65535 AND protocol BETWEEN 0 AND 255 AND fwd_packets>=0 AND bwd_packets>=0 AND fwd_bytes>=0 AND bwd_bytes>=0 AND string_split(src_ip,'.')[4]::INT<=255 AND string_split(dst_ip,'.')[4]::INT<=255"
add("validate_api_flow", lambda s, d: E.validate(A.requests(s, d)).select("row_id", "src_ip", "src_port", "valid"), f"SELECT row_id, src_ip, src_port, ({VALID}) AS valid FROM requests", "requests")
add("agg_api_batch", lambda s, d: E.validate(A.requests(s, d)).where("valid").agg(F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("fwd_packets") > 40, 1).otherwise(0)).alias("anomalies"), F.sum(F.when(F.col("fwd_packets") > 40, 0).otherwise(1)).alias("normal")), f"SELECT count(*) AS total, sum((fwd_packets>40)::INT)::BIGINT AS anomalies, sum((fwd_packets<=40)::INT)::BIGINT AS normal FROM requests WHERE {VALID}", "requests")

# --- profile ---
LABEL_NAME = "IT_B_Label"
NUM = ["sPackets", "sBytesSum", "duration", "rttl"]
LONG = "long AS (SELECT IT_B_Label AS y, unnest(['sPackets','sBytesSum','duration','rttl']) AS feature, unnest([sPackets, sBytesSum, duration, rttl]) AS value FROM flows)"
add("agg_label_distribution", lambda s, d: R(P.label_distribution(A.flows(s, d), "IT_M_Label")), "SELECT IT_M_Label AS value, count(*) AS n, round(100.0*count(*)/(SELECT count(*) FROM flows),6) AS percent FROM flows GROUP BY 1", "flows")
add("agg_value_counts", lambda s, d: P.value_counts(A.flows(s, d), "rIPs", 10), "SELECT rIPs AS value, count(*) AS n FROM flows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "flows")
add("agg_distinct_ips", lambda s, d: A.flows(s, d).agg(F.count_distinct("sIPs").alias("sources"), F.count_distinct("rIPs").alias("destinations")), "SELECT count(DISTINCT sIPs) AS sources, count(DISTINCT rIPs) AS destinations FROM flows", "flows")
add("agg_describe", lambda s, d: R(P.describe(A.flows(s, d), NUM), 4), "SELECT feature, count(value) AS count, round(avg(value),4) AS mean, round(stddev_samp(value),4) AS std, round(min(value),4) AS min, round(quantile_cont(value,0.25),4) AS p25, round(quantile_cont(value,0.5),4) AS p50, round(quantile_cont(value,0.75),4) AS p75, round(max(value),4) AS max FROM long GROUP BY 1", "flows", LONG)
_CLASS = "SELECT feature, avg(value) FILTER (y=0) AS normal_mean, avg(value) FILTER (y=1) AS attack_mean FROM long GROUP BY 1"
add("agg_class_comparison", lambda s, d: R(P.class_comparison(A.flows(s, d), NUM, F.col(LABEL_NAME)), 4), f"SELECT feature, round(normal_mean,4) AS normal_mean, round(attack_mean,4) AS attack_mean, round(attack_mean-normal_mean,4) AS difference FROM ({_CLASS})", "flows", LONG)
add("agg_missing_values", lambda s, d: R(P.missing_values(A.flows(s, d), [*NUM, "sIPs"])), "SELECT 'rttl' AS \"column\", count(*) FILTER (rttl IS NULL) AS missing, round(100.0*count(*) FILTER (rttl IS NULL)/count(*),6) AS percent FROM flows", "flows")
_corr = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a},{b}),5) AS r FROM flows" for i, a in enumerate(NUM[:3]) for b in NUM[i:3])
add("agg_correlation", lambda s, d: R(P.correlation(A.flows(s, d), NUM[:3]), 5), _corr, "flows")
add("agg_dataset_summary", lambda s, d: P.dataset_summary(A.flows(s, d)), """SELECT count(*) AS total, sum(IT_B_Label)::BIGINT AS attacks, count(DISTINCT sIPs) AS sources, count(DISTINCT rIPs) AS destinations, '{"Normal":'||count(*) FILTER (IT_M_Label='Normal')||',"ddos":'||count(*) FILTER (IT_M_Label='ddos')||',"replay":'||count(*) FILTER (IT_M_Label='replay')||'}' AS labels FROM flows""", "flows")
for _n in ("agg_discriminability", "top_discriminative"):
    add(_n, lambda s, d: R(P.discriminability(A.flows(s, d), NUM[:3], F.col(LABEL_NAME)), 5), "SELECT feature, round(abs(avg(value) FILTER (y=1)-avg(value) FILTER (y=0))/stddev_samp(value),5) AS score FROM long WHERE feature<>'rttl' GROUP BY 1", "flows", LONG)
add("agg_feature_ratio", lambda s, d: R(P.feature_ratio(A.flows(s, d), NUM[:3], F.col(LABEL_NAME)), 5), f"SELECT feature, round(attack_mean/(normal_mean+1e-6),5) AS ratio, abs(attack_mean/(normal_mean+1e-6)-1)>0.3 AS discriminative FROM ({_CLASS}) WHERE feature<>'rttl'", "flows", LONG)
add("agg_class_histogram", lambda s, d: P.class_histogram(A.flows(s, d), "sPackets", F.col(LABEL_NAME)), "SELECT y, bin::INT AS bin, count(*) AS n FROM (SELECT IT_B_Label AS y, least(floor((least(greatest(sPackets,lo),hi)-lo)/(hi-lo)*50),49) AS bin FROM flows, (SELECT quantile_cont(sPackets,0.01) AS lo, quantile_cont(sPackets,0.99) AS hi FROM flows)) GROUP BY 1,2", "flows")
add("agg_attack_type_dist", lambda s, d: A.flows(s, d).groupBy("IT_M_Label").agg(F.count(F.lit(1)).alias("n")), "SELECT IT_M_Label, count(*) AS n FROM flows GROUP BY 1", "flows")
add("agg_protocol_counts", lambda s, d: E.protocol_counts(A.flows(s, d)), "SELECT p.name AS protocol_name, count(row_id) AS n FROM (VALUES (502,'Modbus/TCP'),(20000,'DNP3'),(44818,'EtherNet/IP'),(102,'S7comm'),(4840,'OPC UA'),(47808,'BACnet')) p(port,name) LEFT JOIN flows ON dst_port=port GROUP BY 1", "flows")
add("agg_segmentation_ratio", lambda s, d: R(E.segmentation(A.flows(s, d)).select("ratio")), "SELECT round(avg((dst_port IN (502,20000,44818,102,4840))::INT),6) AS ratio FROM flows", "flows")
add("agg_flow_stats", lambda s, d: R(A.flows(s, d).agg(F.count(F.lit(1)).alias("total_flows"), F.avg("sPackets").alias("mean_packets"), F.min("sPackets").alias("min_packets"), F.max("sPackets").alias("max_packets"), F.avg("duration").alias("mean_duration")), 4), "SELECT count(*) AS total_flows, round(avg(sPackets),4) AS mean_packets, min(sPackets) AS min_packets, max(sPackets) AS max_packets, round(avg(duration),4) AS mean_duration FROM flows", "flows")
add("report_stats", lambda s, d: R(A.flows(s, d).agg(F.count(F.lit(1)).alias("total_flows"), F.avg("sBytesSum").alias("mean_bytes"), F.max("sBytesSum").alias("max_bytes")), 3), "SELECT count(*) AS total_flows, round(avg(sBytesSum),3) AS mean_bytes, round(max(sBytesSum),3) AS max_bytes FROM flows", "flows")
add("agg_ks_drift", lambda s, d: R(P.ks_drift(A.flows(s, d).where("IT_B_Label = 0"), A.flows(s, d).where("IT_B_Label = 1"), ["sPackets", "duration"])), "SELECT feature, round(max(abs(ca/all_a-cb/all_b)),6) AS ks FROM (SELECT feature, sum(a) OVER (PARTITION BY feature ORDER BY value) AS ca, sum(b) OVER (PARTITION BY feature ORDER BY value) AS cb, sum(a) OVER (PARTITION BY feature) AS all_a, sum(b) OVER (PARTITION BY feature) AS all_b FROM (SELECT feature, value, sum(1-y) AS a, sum(y) AS b FROM long WHERE feature IN ('sPackets','duration') GROUP BY 1,2)) GROUP BY 1", "flows", LONG)
add("ml_scale", lambda s, d: R(ML.scale(A.flows(s, d), ML.scale_parameters(A.flows(s, d), ["sPackets", "duration"])).select("row_id", "sPackets", "duration")), "SELECT row_id, round((sPackets-avg(sPackets) OVER ())/stddev_pop(sPackets) OVER (),6) AS \"sPackets\", round((duration-avg(duration) OVER ())/stddev_pop(duration) OVER (),6) AS duration FROM flows", "flows")
add("union_files", lambda s, d: A.flows(s, d).select("row_id", "sPackets").unionByName(A.flows(s, d).select("row_id", "duration"), allowMissingColumns=True), "SELECT row_id, sPackets AS \"sPackets\", NULL::DOUBLE AS duration FROM flows UNION ALL SELECT row_id, NULL, duration FROM flows", "flows")
add("union_columns", lambda s, d: R(X.feature_table(A.flows(s, d), 1).select("row_id", "total_bytes", "byte_rate_asymmetry")), f"SELECT row_id, round(sBytesSum+rBytesSum,6) AS total_bytes, round({ENGIN['byte_rate_asymmetry']},6) AS byte_rate_asymmetry FROM flows", "flows")
add("join_ground_truth", lambda s, d: R(found(s, d).select("row_id").distinct().withColumn("hit", F.lit(1)).join(A.flows(s, d).groupBy("row_id").agg(F.max("IT_M_Label").alias("attack_type")), "row_id", "right").groupBy("attack_type").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("caught"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))), "SELECT attack_type, count(*) AS total, count(h.row_id) AS caught, round(avg((h.row_id IS NOT NULL)::INT),6) AS recall FROM (SELECT row_id, max(IT_M_Label) AS attack_type FROM flows GROUP BY 1) t LEFT JOIN (SELECT DISTINCT row_id FROM detections) h USING (row_id) GROUP BY 1", *FD)

# --- evaluation ---
VOTES = {"iso": 0.40, "xgb": 0.35, "rf": 0.25}
VOTE = "votes AS (SELECT *, 0.40*iso+0.35*xgb+0.25*rf AS s, CASE WHEN iso+xgb+rf>0 THEN 1 ELSE 0 END AS p FROM scores)"


def votes(s, d):
    return P.ensemble_vote(A.scores(s, d), VOTES)


_M = lambda m, c: f"SELECT '{m}' AS model, sum(({c}=y)::INT)/count(*)::DOUBLE AS accuracy, coalesce(sum(({c}=1 AND y=1)::INT)/nullif(sum({c}),0)::DOUBLE,0) AS precision, coalesce(sum(({c}=1 AND y=1)::INT)/nullif(sum(y),0)::DOUBLE,0) AS recall FROM votes"
METRICS = "m AS (SELECT model, accuracy, precision, recall, coalesce(2*precision*recall/nullif(precision+recall,0),0) AS f1 FROM (" + " UNION ALL ".join(_M(m, c) for m, c in (("iso", "iso"), ("xgb", "xgb"), ("rf", "rf"), ("prediction", "p"))) + "))"
SV = ("scores", VOTE)
for _n in ("ml_ensemble_vote", "ml_weights"):
    add(_n, lambda s, d: R(votes(s, d).select("doc_id", "ensemble_score", "prediction", "confidence")), "SELECT doc_id, round(s,6) AS ensemble_score, p AS prediction, round(abs(s-0.5)*2,6) AS confidence FROM votes", *SV)
add("agg_anomaly_rate", lambda s, d: R(votes(s, d).agg(F.sum("prediction").alias("anomalies"), F.sum(1 - F.col("prediction")).alias("normal"), (100 * F.avg("prediction")).alias("rate"))), "SELECT sum(p)::BIGINT AS anomalies, sum(1-p)::BIGINT AS normal, round(100*avg(p),6) AS rate FROM votes", *SV)
add("agg_confusion", lambda s, d: R(P.confusion(votes(s, d), "y", "prediction")), "SELECT tp, fp, tn, fn, round(coalesce(fp/nullif(fp+tn,0)::DOUBLE,0),6) AS fpr, round(coalesce(fn/nullif(fn+tp,0)::DOUBLE,0),6) AS fnr FROM (SELECT sum((y=1 AND p=1)::INT)::BIGINT AS tp, sum((y=0 AND p=1)::INT)::BIGINT AS fp, sum((y=0 AND p=0)::INT)::BIGINT AS tn, sum((y=1 AND p=0)::INT)::BIGINT AS fn FROM votes)", *SV)
_METRICS = "SELECT model, round(accuracy,6) AS accuracy, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1 FROM m"
for _n in ("agg_metrics", "ml_evaluate"):
    add(_n, lambda s, d: R(P.metrics(votes(s, d), "y", ["iso", "xgb", "rf", "prediction"])), _METRICS, *SV, METRICS)
add("agg_classification_report", lambda s, d: R(P.classification_report(votes(s, d), "y", "prediction")), "SELECT class, round(precision,6) AS precision, round(recall,6) AS recall, round(coalesce(2*precision*recall/nullif(precision+recall,0),0),6) AS f1, support FROM (SELECT c.class, coalesce(sum((y=c.class AND p=c.class)::INT)/nullif(sum((p=c.class)::INT),0)::DOUBLE,0) AS precision, coalesce(sum((y=c.class AND p=c.class)::INT)/nullif(sum((y=c.class)::INT),0)::DOUBLE,0) AS recall, sum((y=c.class)::INT)::BIGINT AS support FROM votes, (VALUES (0),(1)) c(class) GROUP BY 1)", *SV)
_ROC = "SELECT round(s,4) AS threshold, sum(y) AS p, sum(1-y) AS n FROM votes GROUP BY 1"
add("agg_roc_auc", lambda s, d: R(P.roc_auc(votes(s, d).withColumn("s", F.round("ensemble_score", 4)), "y", "s")), f"SELECT round(sum((f-f0)*(t+t0)/2),6) AS auc FROM (SELECT t, f, coalesce(lag(t) OVER (ORDER BY threshold DESC),0) AS t0, coalesce(lag(f) OVER (ORDER BY threshold DESC),0) AS f0 FROM (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC)/sum(p) OVER ()::DOUBLE AS t, sum(n) OVER (ORDER BY threshold DESC)/sum(n) OVER ()::DOUBLE AS f FROM ({_ROC})))", *SV)
add("agg_attack_recall", lambda s, d: R(P.attack_recall(votes(s, d).where("y = 1"), "attack_type", "prediction")), "SELECT attack_type, count(*) AS total, sum(p)::BIGINT AS caught, round(avg(p),6) AS recall FROM votes WHERE y=1 GROUP BY 1", *SV)
_SWEEP = "sweep AS (SELECT threshold, precision, recall, coalesce(2*precision*recall/nullif(precision+recall,0),0) AS f1, coalesce(5*precision*recall/nullif(4*precision+recall,0),0) AS f2 FROM (SELECT threshold, coalesce(sum((hit AND y=1)::INT)/nullif(sum(hit::INT),0)::DOUBLE,0) AS precision, coalesce(sum((hit AND y=1)::INT)/nullif(sum(y),0)::DOUBLE,0) AS recall FROM (SELECT y, threshold, round(s,4)>=threshold AS hit FROM votes, (SELECT round(0.2+0.05*i,2) AS threshold FROM range(9) r(i))) GROUP BY 1))"


def sweep(s, d):
    return P.threshold_sweep(votes(s, d).withColumn("s", F.round("ensemble_score", 4)), "y", "s")


add("agg_threshold_sweep", lambda s, d: R(sweep(s, d)), "SELECT threshold::DOUBLE AS threshold, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1, round(f2,6) AS f2 FROM sweep", *SV, _SWEEP)
add("agg_best_thresholds", lambda s, d: P.best_thresholds(R(sweep(s, d), 9)), "SELECT (SELECT threshold::DOUBLE FROM sweep ORDER BY round(f1,9) DESC, threshold LIMIT 1) AS best_f1, (SELECT threshold::DOUBLE FROM sweep ORDER BY round(f2,9) DESC, threshold LIMIT 1) AS best_f2, coalesce((SELECT threshold::DOUBLE FROM sweep WHERE abs(round(precision,9)-round(recall,9))<0.10 ORDER BY round(f1,9) DESC, threshold LIMIT 1), (SELECT min(threshold)::DOUBLE FROM sweep)) AS best_balanced", *SV, _SWEEP)
add("agg_model_comparison", lambda s, d: R(P.model_comparison(R(P.metrics(votes(s, d), "y", ["iso", "rf"]), 9), "iso", "rf")), "SELECT metric, round(a,6) AS a, round(b,6) AS b, round(a-b,6) AS difference, CASE WHEN a>b THEN 'iso' WHEN a<b THEN 'rf' ELSE 'tie' END AS winner FROM (SELECT metric, max(v) FILTER (model='iso') AS a, max(v) FILTER (model='rf') AS b FROM (SELECT model, unnest(['accuracy','precision','recall','f1']) AS metric, unnest([round(accuracy,9),round(precision,9),round(recall,9),round(f1,9)]) AS v FROM m) GROUP BY 1)", *SV, METRICS)
add("agg_metric_delta", lambda s, d: R(P.metric_delta(P.metrics(votes(s, d), "y", ["iso"]).drop("model", "accuracy"), P.metrics(votes(s, d), "y", ["prediction"]).drop("model", "accuracy"))), "SELECT metric, round(max(v) FILTER (model='iso'),6) AS baseline, round(max(v) FILTER (model='prediction'),6) AS variant, round(max(v) FILTER (model='prediction')-max(v) FILTER (model='iso'),6) AS delta FROM (SELECT model, unnest(['precision','recall','f1']) AS metric, unnest([precision,recall,f1]) AS v FROM m) GROUP BY 1", *SV, METRICS)
add("agg_ensemble_gain", lambda s, d: R(P.metrics(votes(s, d), "y", ["iso", "xgb", "rf", "prediction"]).agg((100 * (F.max(F.when(F.col("model") == "prediction", F.col("accuracy"))) - F.max(F.when(F.col("model") != "prediction", F.col("accuracy"))))).alias("gain"))), "SELECT round(100*(max(accuracy) FILTER (model='prediction')-max(accuracy) FILTER (model<>'prediction')),6) AS gain FROM m", *SV, METRICS)
add("filter_anomalous", lambda s, d: votes(s, d).where("prediction = 1").select("doc_id"), "SELECT doc_id FROM votes WHERE p=1", *SV)
add("win_split_rank", lambda s, d: W.stratified_split(A.flows(s, d).select("row_id", "IT_B_Label"), "IT_B_Label"), "SELECT row_id, IT_B_Label AS \"IT_B_Label\", r<=round(n*0.2) AS is_test FROM (SELECT row_id, IT_B_Label, row_number() OVER (PARTITION BY IT_B_Label ORDER BY md5('42:'||row_id), row_id) AS r, count(*) OVER (PARTITION BY IT_B_Label) AS n FROM flows)", "flows")
add("ml_split", lambda s, d: W.stratified_split(A.flows(s, d).select("row_id", "IT_B_Label"), "IT_B_Label").groupBy("IT_B_Label", "is_test").agg(F.count(F.lit(1)).alias("n")), "SELECT IT_B_Label AS \"IT_B_Label\", t AS is_test, CASE WHEN t THEN round(c*0.2)::BIGINT ELSE c-round(c*0.2)::BIGINT END AS n FROM (SELECT IT_B_Label, count(*) AS c FROM flows GROUP BY 1), (VALUES (true),(false)) v(t)", "flows")
add("sample_rows", lambda s, d: W.sample_rows(A.flows(s, d).select("row_id", "sPackets"), 100), "SELECT row_id, sPackets AS \"sPackets\" FROM flows ORDER BY md5('42:'||row_id), row_id, sPackets LIMIT 100", "flows")

# --- vulnerabilities ---
_KEYS = values_sql(CVE_KEYWORDS, "pattern, keyword", "keys")
_VEND = values_sql(VENDORS, "vendor, product", "vendors")
_CVES = "cves AS (SELECT cve_id, description[1:300] AS description, score AS cvss_score, CASE WHEN score IS NULL THEN 'UNKNOWN' WHEN score>=9 THEN 'CRITICAL' WHEN score>=7 THEN 'HIGH' WHEN score>=4 THEN 'MEDIUM' ELSE 'LOW' END AS severity, CASE WHEN score IS NULL THEN 'SL-1' WHEN score>=9 THEN 'SL-4' WHEN score>=7 THEN 'SL-3' WHEN score>=4 THEN 'SL-2' ELSE 'SL-1' END AS iec_sl, published FROM nvd)"
_HITS = "hits AS (SELECT pattern, cve_id, iec_sl, row_number() OVER (PARTITION BY pattern ORDER BY cve_id) AS turn FROM keys JOIN cves ON len(list_filter(string_split(lower(keyword),' '), lambda w: NOT contains(lower(description), w)))=0)"
add("cve_enrich", lambda s, d: E.cves_of(A.nvd(s, d)), "SELECT cve_id, description, cvss_score, severity, iec_sl, published FROM cves", "nvd", _CVES)
add("join_pattern_cve", lambda s, d: E.pattern_cves(summary(s, d), E.cves_of(A.nvd(s, d))), "SELECT pattern, coalesce(n,0) AS cves_found, top_cve, coalesce(sl,'SL-2') AS required_iec_sl FROM summary LEFT JOIN (SELECT pattern, count(*) AS n, min_by(cve_id, turn) AS top_cve, min_by(iec_sl, turn) AS sl FROM hits WHERE turn<=5 GROUP BY 1) USING (pattern)", *FDS, "nvd", _CVES, _KEYS, _HITS)
for _n in ("agg_vendor_cve", "cve_vendor_summary"):
    add(_n, lambda s, d: E.vendor_cves(E.cves_of(A.nvd(s, d))), "SELECT vendor, count(*) AS total, sum((severity='CRITICAL')::INT)::BIGINT AS critical, sum((severity='HIGH')::INT)::BIGINT AS high, max(iec_sl) AS max_sl FROM (SELECT DISTINCT vendor, cve_id, severity, iec_sl FROM vendors JOIN cves ON contains(lower(description), product)) GROUP BY 1", "nvd", _CVES, _VEND)
