"""The feature table: groups of columns derived from flows.

A group is a function of the flow columns present: a feature whose inputs are
missing is left out, decided when the plan is built. All groups of a version are
one ``select``, so the plan has a single projection over the scan.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip, filled, finite, over_at_least, over_one_more, safe_duration

LABELS = ("IT_B_Label", "IT_M_Label", "NST_B_Label", "NST_M_Label")
LEAKS = ("start", "end", "startOffset", "endOffset", "rPayloadSum")
#: Bytes of a method beyond which HotSpot leaves it uncompiled: a stage with such a one runs without whole-stage code, in small methods.
COMPILED = ("spark.sql.codegen.hugeMethodLimit", "8000")

STATISTICAL = [("src_bytes_max", "sBytesMax"), ("dst_bytes_max", "rBytesMax"), ("src_bytes_min", "sBytesMin"), ("dst_bytes_min", "rBytesMin"), ("src_bytes_avg", "sBytesAvg"), ("dst_bytes_avg", "rBytesAvg"), ("src_load", "sLoad"), ("dst_load", "rLoad"), ("src_payload_sum", "sPayloadSum"), ("src_payload_avg", "sPayloadAvg"), ("dst_payload_avg", "rPayloadAvg")]
PROTOCOL = [(f"{side}_{flag.lower()}_rate", f"{letter}{flag}Rate", 0.0) for side, letter in (("src", "s"), ("dst", "r")) for flag in ("Ack", "Syn", "Fin", "Rst", "Psh", "Urg")]
PROTOCOL += [("src_ttl", "sttl", 64.0), ("dst_ttl", "rttl", 64.0)]
PROTOCOL += [(f"{side}_{name}", f"{letter}{source}", 0.0) for name, source in (("win_size", "WinTCP"), ("fragment_rate", "FragmentRate"), ("ack_delay", "AckDelayAvg")) for side, letter in (("src", "s"), ("dst", "r"))]


def _have(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def network_basic(df: DataFrame) -> dict[str, Column]:
    out = {n: filled(c) for n, c in (("src_packets", "sPackets"), ("dst_packets", "rPackets"), ("src_bytes", "sBytesSum"), ("dst_bytes", "rBytesSum"), ("flow_duration", "duration")) if _have(df, c)}
    if {"src_packets", "dst_packets"} <= set(out):
        out |= {"total_packets": out["src_packets"] + out["dst_packets"], "packet_ratio": over_one_more(out["src_packets"], out["dst_packets"])}
    if {"src_bytes", "dst_bytes"} <= set(out):
        out |= {"total_bytes": out["src_bytes"] + out["dst_bytes"], "byte_ratio": over_one_more(out["src_bytes"], out["dst_bytes"])}
    if {"total_bytes", "total_packets"} <= set(out):
        out["bytes_per_packet"] = over_one_more(out["total_bytes"], out["total_packets"])
    return out


def timing(df: DataFrame) -> dict[str, Column]:
    out = {f"{side}_inter_packet_avg": filled(f"{letter}InterPacketAvg") for side, letter in (("src", "s"), ("dst", "r")) if _have(df, f"{letter}InterPacketAvg")}
    if _have(df, "duration"):
        d = safe_duration(filled("duration"))
        for side, letter in (("src", "s"), ("dst", "r")):
            for kind, source in (("packet_rate", "Packets"), ("byte_rate", "BytesSum")):
                if _have(df, f"{letter}{source}"):
                    out[f"{side}_{kind}"] = filled(f"{letter}{source}") / d
    return out


def statistical(df: DataFrame) -> dict[str, Column]:
    return {n: filled(c) for n, c in STATISTICAL if _have(df, c)}


def protocol(df: DataFrame) -> dict[str, Column]:
    return {n: filled(c, default) for n, c, default in PROTOCOL if _have(df, c)}


def bytes_per_packet_of(df: DataFrame) -> Column:
    return over_one_more(filled("sBytesSum"), filled("sPackets"))


def mean_packet_size(df: DataFrame) -> float:
    """The centre of packet_size_anomaly: a fitted parameter, one row for any input."""
    return df.agg(F.avg(bytes_per_packet_of(df)).alias("m")).first()["m"] or 0.0


def behavioral(df: DataFrame, mean_size: float | None = None) -> dict[str, Column]:
    """``mean_size`` is a fitted centre; without one it must be joined as column ``_mean_size`` (see :func:`with_mean_size`)."""
    out = {}
    if _have(df, "sSynRate", "sAckRate"):
        out["syn_ack_imbalance"] = filled("sSynRate") - filled("sAckRate")
    if _have(df, "sBytesSum", "sPackets"):
        out["packet_size_anomaly"] = F.abs(bytes_per_packet_of(df) - (F.lit(mean_size) if mean_size is not None else F.col("_mean_size")))
    if _have(df, "sRstRate", "rRstRate"):
        out["reset_rate_total"] = filled("sRstRate") + filled("rRstRate")
    if _have(df, "sPackets", "rPackets"):
        s, r = filled("sPackets"), filled("rPackets")
        out["traffic_symmetry"] = 1 - F.abs(s - r) / (s + r + 1)
    return out


def with_mean_size(df: DataFrame) -> DataFrame:
    """One-row aggregate, joined by broadcast: no unpartitioned window."""
    return df.crossJoin(F.broadcast(df.agg(F.avg(bytes_per_packet_of(df)).alias("_mean_size"))))


def engineered(df: DataFrame) -> dict[str, Column]:
    if not _have(df, "sBytesSum", "rBytesSum", "duration"):
        return {}
    d = safe_duration(filled("duration"))
    a, b = filled("sBytesSum") / d, filled("rBytesSum") / d
    return {"byte_rate_asymmetry": F.abs(a - b) / (a + b + 1)}


def network_advanced(df: DataFrame) -> dict[str, Column]:
    out = {}
    for side, letter in (("src", "s"), ("dst", "r")):
        if _have(df, f"{letter}BytesSum", f"{letter}Packets"):
            out[f"{side}_bytes_per_packet"] = over_one_more(filled(f"{letter}BytesSum"), filled(f"{letter}Packets"))
    if _have(df, "sBytesMax", "sBytesMin"):
        spread = filled("sBytesMax") - filled("sBytesMin")
        out["src_bytes_range"] = spread
        if _have(df, "sBytesAvg"):
            out["src_bytes_cv"] = over_one_more(spread, filled("sBytesAvg"))
    if _have(df, "sPackets", "rPackets", "duration"):
        out["total_packet_rate"] = (filled("sPackets") + filled("rPackets")) / safe_duration(filled("duration"))
    return out


def targeted(df: DataFrame) -> dict[str, Column]:
    d = safe_duration(filled("duration"))
    ipa, packets = filled("sInterPacketAvg"), filled("sPackets", 1.0)
    top = F.coalesce(F.col("sBytesMax"), F.lit(1.0)).cast("double")
    top = F.when(top == 0, 1.0).otherwise(top)
    average = filled("sBytesAvg")
    return {
        "inter_packet_timing_asymmetry": F.abs(ipa - filled("rInterPacketAvg")),
        "timing_regularity": F.least(1 / (F.abs(ipa - d / (packets + 1)) + 0.001), F.lit(1000.0)),
        "payload_size_consistency": filled("sPayloadAvg") / top,
        "scan_signature_score": F.least(filled("sPackets") / (filled("duration") + 0.001) / (average + 1), F.lit(1000.0)),
        "flow_burstiness": (filled("sBytesMax") - average) / (average + 1),
    }


GROUPS = {"network_basic": network_basic, "timing": timing, "statistical": statistical, "protocol": protocol, "behavioral": behavioral, "network_advanced": network_advanced, "engineered": engineered}
SESSION = ("src_unique_dst_count", "src_flow_count", "src_inter_flow_interval", "src_inter_flow_variance", "src_dst_flow_ratio", "src_payload_entropy")
V1 = ("network_basic", "timing", "statistical", "protocol", "behavioral", "engineered")
V2 = ("network_basic", "timing", "statistical", "protocol", "behavioral", "network_advanced", "engineered")


def group(df: DataFrame, name: str, keep: tuple = ("row_id",)) -> DataFrame:
    if name == "behavioral":
        df = with_mean_size(df)
    return df.select(*keep, *[c.alias(n) for n, c in GROUPS[name](df).items()])


def feature_table(df: DataFrame, version: int = 2, keep: tuple = ("row_id",), mean_size: float | None = None, sessions: bool = True) -> DataFrame:
    """All groups of a version in one select, sanitised; session features are added by key where flows have a source, else 0."""
    from .sessions import session_global

    df.sparkSession.conf.set(*COMPILED)
    base = df if mean_size is not None else with_mean_size(df)
    columns: dict[str, Column] = {}
    for name in V1 if version == 1 else V2:
        columns |= behavioral(base, mean_size) if name == "behavioral" else GROUPS[name](base)
    if sessions and _have(df, "sIPs", "rIPs") and ("timestamp" in df.columns or "start" in df.columns):
        base = session_global(base)
        columns |= {c: F.col(c) for c in SESSION}
    else:
        columns |= {c: F.lit(0.0) for c in SESSION}
    return base.select(*keep, *[finite(c).alias(n) for n, c in columns.items()])


def groups_json(df: DataFrame, version: int = 2) -> str:
    base = with_mean_size(df)
    found = {n: list(GROUPS[n](base)) for n in (V1 if version == 1 else V2)} | {"session": list(SESSION)}
    return json.dumps({n: {"count": len(c), "features": c} for n, c in found.items()})


def align(df: DataFrame, features: list[str], keep: tuple = ("row_id",)) -> DataFrame:
    """Columns in the order of a feature list; missing ones are 0."""
    return df.select(*keep, *[(filled(c) if c in df.columns else F.lit(0.0)).alias(c) for c in features])


def label_binary(df: DataFrame) -> Column:
    for name in ("IT_B_Label", "NST_B_Label"):
        if name in df.columns:
            return F.coalesce(F.col(name), F.lit(0)).cast("int")
    if "IT_M_Label" in df.columns:
        return F.when(F.coalesce("IT_M_Label", F.lit("Normal")) != "Normal", 1).otherwise(0)
    return F.lit(0)


def label_text_fix(label: Column, text: bool = True) -> Column:
    return F.when(F.lower(F.trim(label)) != "normal", 1).otherwise(0) if text else F.coalesce(label.cast("int"), F.lit(0))


def leak_guard(df: DataFrame, reject: bool = False) -> DataFrame:
    """Drop label and position columns; with ``reject`` labels are an error, as in a sink of features."""
    if reject and (found := sorted(set(LABELS) & set(df.columns))):
        raise ValueError(f"label columns among the features: {found}")
    return df.drop(*LABELS, *LEAKS)


def well_filled(df: DataFrame, least: float = 0.5) -> list[str]:
    """Numeric columns with more than ``least`` non-null values, from one aggregate."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in numeric]).first()
    return [c for c in numeric if row["_n"] and row[c] / row["_n"] > least]


def plc_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(w in c.lower() for w in ("tank", "valve", "conveyor", "bottle", "level", "flow"))]


def from_packet_flow(flows: DataFrame) -> DataFrame:
    """Features of flows assembled from packets (their own definitions of ratios, load and anomaly)."""
    c = F.col
    d = F.greatest(c("end") - c("start"), F.lit(0.001))
    fwd, bwd, fb, bb = (c(x).cast("double") for x in ("fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes"))
    total, size = fwd + bwd, fb + bb
    ttl = lambda x: F.when(F.coalesce(c(x), F.lit(0)) == 0, 64).otherwise(c(x)).cast("double")
    cv = lambda sd, mean: F.when(mean > 0, sd / mean).otherwise(0.0)
    rate = lambda x, n: c(x) / F.greatest(c(n).cast("double"), F.lit(1.0))
    iat_cv = cv(F.coalesce("iat_std", F.lit(0.0)), F.coalesce("iat_mean", F.lit(0.0)))
    out = {
        "src_packets": fwd, "dst_packets": bwd, "src_bytes": fb, "dst_bytes": bb, "flow_duration": d, "total_packets": total, "total_bytes": size,
        "packet_ratio": over_at_least(fwd, bwd), "byte_ratio": over_at_least(fb, bb), "bytes_per_packet": over_at_least(size, total),
        "src_inter_packet_avg": F.coalesce("iat_mean", F.lit(0.0)), "dst_inter_packet_avg": F.coalesce("iat_mean", F.lit(0.0)), "inter_packet_timing_asymmetry": F.lit(0.0),
        "src_packet_rate": fwd / d, "dst_packet_rate": bwd / d, "src_byte_rate": fb / d, "dst_byte_rate": bb / d, "src_load": fb * 8 / d, "dst_load": bb * 8 / d,
        "packet_size_anomaly": F.abs(over_at_least(size, total) - 500), "traffic_symmetry": 1 - F.abs(fwd - bwd) / F.greatest(total, F.lit(1.0)),
        "src_ttl": ttl("fwd_ttl"), "dst_ttl": ttl("bwd_ttl"), "src_win_size": F.coalesce("fwd_win", F.lit(0)).cast("double"), "dst_win_size": F.coalesce("bwd_win", F.lit(0)).cast("double"),
        "timing_regularity": clip(1 - iat_cv, 0.0, 1.0), "flow_burstiness": iat_cv,
        "payload_size_consistency": F.when(total > 1, clip(1 - cv(c("size_std"), c("size_mean")), 0.0, 1.0)).otherwise(0.0),
        "scan_signature_score": fwd / F.greatest(total, F.lit(1.0)) * (1 - F.least(bwd / F.greatest(fwd, F.lit(1.0)), F.lit(1.0))),
    }
    for side, letter in (("src", "fwd"), ("dst", "bwd")):
        for flag in ("psh", "urg", "syn", "ack", "fin", "rst"):
            out[f"{side}_{flag}_rate"] = rate(f"{letter}_{flag}", f"{letter}_packets")
        for what in ("min", "max", "avg"):
            out[f"{side}_bytes_{what}"] = F.coalesce(c(f"{letter}_size_{what}"), F.lit(0)).cast("double")
    out["syn_ack_imbalance"] = out["src_syn_rate"] - out["src_ack_rate"]
    out["reset_rate_total"] = out["src_rst_rate"] + out["dst_rst_rate"]
    return flows.select("src_ip", "dst_ip", "src_port", "dst_port", *[finite(x).alias(n) for n, x in out.items()])


def from_request(req: DataFrame, features: list[str] | None = None, keep: tuple = ("row_id",)) -> DataFrame:
    """Features of single-request records; unknown features are 0, load isn't in bits."""
    c = F.col
    d = F.greatest(c("duration"), F.lit(0.001))
    fwd, bwd, fb, bb = (c(x).cast("double") for x in ("fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes"))
    total = fwd + bwd
    out = {
        "src_packets": fwd, "dst_packets": bwd, "src_bytes": fb, "dst_bytes": bb, "flow_duration": c("duration"), "total_packets": total, "packet_ratio": over_at_least(fwd, bwd), "total_bytes": fb + bb,
        "byte_ratio": over_at_least(fb, bb), "bytes_per_packet": over_at_least(fb + bb, total), "src_inter_packet_avg": c("iat_mean"), "src_packet_rate": fwd / d, "dst_packet_rate": bwd / d, "src_load": fb / d, "dst_load": bb / d,
        "syn_ack_imbalance": F.abs(c("fwd_psh") - c("bwd_psh")) / F.greatest(total, F.lit(1.0)), "timing_regularity": 1 / (1 + c("iat_std")), "flow_burstiness": c("iat_std") / F.greatest(c("iat_mean"), F.lit(0.001)),
    }
    made = req.select(*keep, *[finite(x).alias(n) for n, x in out.items()])
    return align(made, features, keep) if features else made
