"""Attack-pattern detectors over the feature table.

A detector is a record of Column expressions, so users add patterns of their
own. ``detect`` evaluates all of them in one pass over the features: matching
patterns become an array that is exploded, not a union of scans.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.knowledge import PATTERNS, THRESHOLDS, WRITE_FUNCTIONS, patterns
from ..functions.scalar import confidence, hex_label


@dataclass(frozen=True)
class Detector:
    name: str
    severity: str
    required: tuple[str, ...]
    predicate: Callable[[dict], Column]
    confidence: Callable[[dict], Column]
    source: str = "flow_features"


def _c(name: str) -> Column:
    return F.col(name)


_SEVERITY = {p[0]: p[1] for p in PATTERNS}
_RULES = {
    "modbus_flooding": (("src_packet_rate", "total_packets"), lambda t: (_c("src_packet_rate") > t["flood_rate"]) & (_c("total_packets") > t["flood_packets"]), lambda t: confidence(_c("src_packet_rate"), t["flood_rate"], 3 * t["flood_rate"])),
    "plc_scanning": (("packet_ratio", "dst_packets", "byte_ratio"), lambda t: (_c("packet_ratio") < t["scan_packet_ratio"]) & (_c("dst_packets") <= t["scan_dst_packets"]) & (_c("byte_ratio") < t["scan_byte_ratio"]), lambda t: confidence(1 / F.greatest(_c("packet_ratio"), F.lit(1e-6)), 1 / t["scan_packet_ratio"], 10 / t["scan_packet_ratio"])),
    "unauthorized_write": (("src_psh_rate", "src_packet_rate", "src_rst_rate"), lambda t: (_c("src_psh_rate") > t["write_psh"]) & (_c("src_packet_rate") > t["write_rate"]) & (_c("src_rst_rate") > 0), lambda t: confidence(_c("src_psh_rate"), t["write_psh"], 1.0)),
    "protocol_fuzzing": (("packet_size_anomaly", "src_urg_rate", "bytes_per_packet"), lambda t: (_c("packet_size_anomaly") > t["fuzz_size"]) & ((_c("src_urg_rate") > t["fuzz_urg"]) | (_c("bytes_per_packet") < t["fuzz_bytes"])), lambda t: confidence(_c("packet_size_anomaly"), t["fuzz_size"], t["fuzz_size"] + 500)),
    "man_in_the_middle": (("traffic_symmetry", "byte_ratio", "src_ttl"), lambda t: (_c("traffic_symmetry") > t["mitm_symmetry"]) & _c("byte_ratio").between(t["mitm_low"], t["mitm_high"]) & (_c("src_ttl") == t["mitm_ttl"]), lambda t: confidence(_c("traffic_symmetry"), t["mitm_symmetry"], 1.0)),
    "command_injection": (("src_psh_rate", "dst_psh_rate", "src_packet_rate"), lambda t: (_c("src_psh_rate") > t["inject_src_psh"]) & (_c("dst_psh_rate") < t["inject_dst_psh"]) & (_c("src_packet_rate") > t["inject_rate"]), lambda t: confidence(_c("src_psh_rate") - _c("dst_psh_rate"), t["inject_src_psh"], 1.0)),
    "time_based_attack": (("src_inter_packet_avg", "dst_inter_packet_avg", "total_packets", "src_packet_rate"), lambda t: (_c("src_inter_packet_avg") > 0) & (_c("src_inter_packet_avg") < t["time_iat"]) & (_c("total_packets") > t["time_packets"]) & (_c("dst_inter_packet_avg") / F.greatest(_c("src_inter_packet_avg"), F.lit(1e-9))).between(t["time_low"], t["time_high"]) & (_c("src_packet_rate") < t["flood_rate"]) & (_c("src_packet_rate") < t["time_rate"]), lambda t: confidence(t["time_iat"] - _c("src_inter_packet_avg"), 0.0, t["time_iat"])),
    "replay_attack": (("byte_ratio", "packet_ratio", "traffic_symmetry"), lambda t: _c("byte_ratio").between(t["replay_low"], t["replay_high"]) & _c("packet_ratio").between(t["replay_low"], t["replay_high"]) & (_c("traffic_symmetry") > t["replay_symmetry"]), lambda t: confidence(_c("traffic_symmetry"), t["replay_symmetry"], 1.0)),
    "credential_stuffing": (("syn_ack_imbalance", "total_packets", "src_fin_rate", "src_syn_rate"), lambda t: (_c("syn_ack_imbalance") > t["cred_imbalance"]) & (_c("total_packets") < t["cred_packets"]) & (_c("src_fin_rate") > t["cred_fin"]) & (_c("src_syn_rate") > t["cred_syn"]), lambda t: confidence(_c("syn_ack_imbalance"), t["cred_imbalance"], 1.0)),
    "firmware_modification": (("total_bytes", "bytes_per_packet", "packet_ratio"), lambda t: (_c("total_bytes") > t["firmware_bytes"]) & (_c("bytes_per_packet") > t["firmware_per_packet"]) & (_c("packet_ratio") < t["firmware_ratio"]), lambda t: confidence(_c("total_bytes"), t["firmware_bytes"], 10 * t["firmware_bytes"])),
}
DETECTORS = [Detector(n, _SEVERITY[n], *_RULES[n]) for n, *_ in PATTERNS]
DETECTION = "row_id long, pattern string, severity string, detection_source string, confidence double, details map<string,double>"


def _usable(features: DataFrame, detectors: list[Detector] | None) -> list[Detector]:
    held = []
    for d in DETECTORS if detectors is None else detectors:
        if missing := set(d.required) - set(features.columns):
            warnings.warn(f"{d.name} skipped, no {sorted(missing)}", stacklevel=3)
        else:
            held.append(d)
    return held


def marks(features: DataFrame, thresholds: dict | None = None, detectors: list[Detector] | None = None) -> tuple[Column, list[str]]:
    """The patterns that match a row as bits of a long, and the pattern of each bit; for uses that need no more of a detection."""
    t, held = THRESHOLDS | (thresholds or {}), _usable(features, detectors)
    if len(held) > 63:
        raise ValueError(f"{len(held)} detectors, a long has bits for 63")
    bits = [F.when(d.predicate(t), F.lit(1 << k)).otherwise(0).cast("long") for k, d in enumerate(held)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long")), [d.name for d in held]


def detect(features: DataFrame, thresholds: dict | None = None, detectors: list[Detector] | None = None) -> DataFrame:
    """One row for each flow and pattern that matches. Detectors whose columns are missing are skipped with a warning."""
    t, found = THRESHOLDS | (thresholds or {}), []
    for d in _usable(features, detectors):
        details = F.create_map(*[x for c in d.required for x in (F.lit(c), _c(c).cast("double"))])
        found.append(F.when(d.predicate(t), F.struct(F.lit(d.name).alias("pattern"), F.lit(d.severity).alias("severity"), F.lit(d.source).alias("detection_source"), d.confidence(t).alias("confidence"), details.alias("details"))))
    if not found:
        return features.sparkSession.createDataFrame([], DETECTION)
    return features.select("row_id", F.explode(F.array_compact(F.array(*found))).alias("d")).select("row_id", "d.*")


def detect_one(features: DataFrame, name: str, thresholds: dict | None = None) -> DataFrame:
    return detect(features, thresholds, [d for d in DETECTORS if d.name == name])


def write_dpi(events: DataFrame) -> DataFrame:
    """Modbus write commands among inspection events."""
    hit = events.where((F.col("protocol") == "Modbus/TCP") & F.col("function_code").isin(WRITE_FUNCTIONS))
    worst = F.when((F.col("function_code") == 16) | (F.col("severity") == "CRITICAL"), "CRITICAL").otherwise("HIGH")
    return hit.select("pkt_id", F.lit("unauthorized_write").alias("pattern"), worst.alias("severity"), F.lit(0.95).alias("confidence"), F.lit("modbus_dpi").alias("detection_source"), "transaction_id", "unit_id", "function_code", hex_label(F.col("function_code")).alias("function_hex"))


def modbus_write_dpi(events: DataFrame) -> DataFrame:
    hit = events.where((F.col("protocol") == "Modbus/TCP") & F.col("function_code").isin(WRITE_FUNCTIONS))
    bulk = F.col("function_code").isin(15, 16)
    return hit.select("pkt_id", F.lit("modbus_write_dpi").alias("pattern"), F.when(bulk | (F.col("severity") == "CRITICAL"), "CRITICAL").otherwise("HIGH").alias("severity"), F.lit(0.95).alias("confidence"), "transaction_id", "function_code", bulk.alias("is_bulk_write"))


def novel_dpi(found: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``found`` whose transaction isn't in ``known``; a null transaction is never known."""
    return found.join(known.select("transaction_id").distinct(), "transaction_id", "left_anti")


def dpi_confirm(detections: DataFrame, dpi: DataFrame) -> DataFrame:
    """If any inspected write has a unit, all writes found in flow features are confirmed by both, with the first such event."""
    first = dpi.where("unit_id is not null").agg(F.min(F.struct("pkt_id", "unit_id", "function_code")).alias("event"))
    write = (F.col("pattern") == "unauthorized_write") & F.col("event").isNotNull()
    return detections.crossJoin(F.broadcast(first)).withColumn("detection_source", F.when(write, "both").otherwise(F.col("detection_source"))).withColumn("event", F.when(write, F.col("event")))


def by_pattern(detections: DataFrame) -> DataFrame:
    dim = patterns(detections.sparkSession).select("pattern")
    counts = detections.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(dim).join(counts, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n"))


def by_severity(detections: DataFrame) -> DataFrame:
    dim = detections.sparkSession.createDataFrame([("CRITICAL",), ("HIGH",), ("MEDIUM",), ("LOW",)], "severity string")
    counts = detections.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(dim).join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))
