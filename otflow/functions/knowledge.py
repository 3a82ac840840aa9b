"""Static tables of the security domain, as Python rows and as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: attack patterns in detection order (pattern, severity, name, technique) ---
PATTERNS = [
    ("modbus_flooding", "HIGH", "Modbus Traffic Flooding", "T0823"),
    ("plc_scanning", "CRITICAL", "PLC Network Scanning", "T0846"),
    ("unauthorized_write", "CRITICAL", "Unauthorized PLC Write Command", "T0836"),
    ("protocol_fuzzing", "HIGH", "Protocol Fuzzing / Malformed Packets", "T0851"),
    ("man_in_the_middle", "CRITICAL", "Man-in-the-Middle Attack", "T0830"),
    ("command_injection", "CRITICAL", "Command Injection", "T0871"),
    ("time_based_attack", "CRITICAL", "Time-Based Logic Attack", "T0889"),
    ("replay_attack", "HIGH", "Replay Attack", "T0843"),
    ("credential_stuffing", "HIGH", "Credential Stuffing", "T0859"),
    ("firmware_modification", "CRITICAL", "Firmware Modification", "T0857"),
]

# fixed values: thresholds of the detectors
THRESHOLDS = {
    "flood_rate": 50_000.0, "flood_packets": 10_000.0,
    "scan_packet_ratio": 0.05, "scan_dst_packets": 3.0, "scan_byte_ratio": 0.05,
    "write_psh": 0.4, "write_rate": 50.0,
    "fuzz_size": 300.0, "fuzz_urg": 0.01, "fuzz_bytes": 25.0,
    "mitm_symmetry": 0.95, "mitm_low": 0.85, "mitm_high": 1.15, "mitm_ttl": 128.0,
    "inject_src_psh": 0.5, "inject_dst_psh": 0.1, "inject_rate": 15.0,
    "time_iat": 0.002, "time_packets": 100.0, "time_low": 0.8, "time_high": 1.2, "time_rate": 500.0,
    "replay_low": 0.995, "replay_high": 1.005, "replay_symmetry": 0.98,
    "cred_imbalance": 0.3, "cred_packets": 15.0, "cred_fin": 0.1, "cred_syn": 0.3,
    "firmware_bytes": 100_000.0, "firmware_per_packet": 70.0, "firmware_ratio": 0.15,
}

# fixed values: exporters' technique of a pattern (pattern, technique, name, tactic)
MITRE = [
    ("modbus_flooding", "T0814", "Denial of Control", "Inhibit Response Function"),
    ("plc_scanning", "T0846", "Remote System Discovery", "Discovery"),
    ("unauthorized_write", "T0855", "Unauthorized Command Message", "Impair Process Control"),
    ("man_in_the_middle", "T0830", "Man in the Middle", "Collection"),
    ("replay_attack", "T0843", "Program Download", "Lateral Movement"),
    ("command_injection", "T0855", "Unauthorized Command Message", "Impair Process Control"),
]

# fixed values: IEC 62443 requirement that a pattern violates
IEC_VIOLATIONS = [
    ("modbus_flooding", "SR 7.1", "Denial of Service Protection", "SL-2"),
    ("plc_scanning", "SR 1.1", "Human User Identification & Auth", "SL-1"),
    ("unauthorized_write", "SR 2.1", "Authorization Enforcement", "SL-2"),
    ("man_in_the_middle", "SR 4.1", "Information Confidentiality", "SL-2"),
    ("replay_attack", "SR 3.3", "Security Functionality Verification", "SL-2"),
]

#: Controls by requirement, worded here after the public titles of IEC 62443-3-3 system requirements and NIST SP 800-82.
CONTROLS = {
    "SR 1.2": "Let a device speak on the control network only after it has proved its identity",
    "SR 2.1": "Tie each write to a role, and refuse those of all other roles",
    "SR 2.8": "Record who sent which command, when, and what came of it",
    "SR 3.1": "Authenticate messages on the way, so that changed ones are refused",
    "SR 3.4": "Compare programs and set points with an approved state and raise differences",
    "SR 3.8": "Bind messages to a session, and refuse those that belong to an old one",
    "SR 5.1": "Divide the network into zones by function and criticality",
    "SR 5.2": "Deny what crosses a zone boundary unless a conduit is documented for it",
    "SR 6.2": "Watch traffic against its usual level and alert operators",
    "SR 7.1": "Keep the control loop running under load: cap what a peer may send",
    "SR 7.6": "Switch off ports and services that the process doesn't need",
}
#: What each pattern calls for.
_CALLS_FOR = {
    "modbus_flooding": ("SR 7.1", "SR 6.2", "SR 5.2"),
    "plc_scanning": ("SR 7.6", "SR 5.1", "SR 6.2"),
    "unauthorized_write": ("SR 2.1", "SR 2.8", "SR 3.4"),
    "man_in_the_middle": ("SR 3.1", "SR 1.2", "SR 5.1"),
    "replay_attack": ("SR 3.8", "SR 3.1", "SR 2.8"),
    "command_injection": ("SR 2.1", "SR 5.2", "SR 3.4"),
}
MITIGATIONS = {pattern: [f"{c}: {CONTROLS[c]}" for c in controls] for pattern, controls in _CALLS_FOR.items()}
DEFAULT_MITIGATION = "SR 6.1: Review the recorded events and decide on a response"

# fixed values: rule ids, class types, priorities
RULES = [
    ("modbus_flooding", 9000001, "attempted-dos", 1),
    ("plc_scanning", 9000002, "network-scan", 2),
    ("unauthorized_write", 9000003, "policy-violation", 1),
    ("man_in_the_middle", 9000004, "bad-unknown", 1),
    ("replay_attack", 9000005, "bad-unknown", 2),
    ("command_injection", 9000006, "policy-violation", 1),
]

# fixed values: search words for CVEs of a pattern
CVE_KEYWORDS = [
    ("modbus_flooding", "Modbus ICS"),
    ("plc_scanning", "Siemens S7 SCADA"),
    ("unauthorized_write", "Modbus unauthorized"),
    ("protocol_fuzzing", "industrial protocol"),
    ("man_in_the_middle", "SCADA MITM"),
    ("command_injection", "ICS remote code execution"),
    ("replay_attack", "SCADA replay"),
]

# fixed values: product words of vendors
VENDORS = [
    ("schneider_electric", "modicon"), ("schneider_electric", "ecostruxure"), ("schneider_electric", "wonderware"), ("schneider_electric", "clearscada"),
    ("yokogawa", "centum"), ("yokogawa", "exaquantum"), ("yokogawa", "stardom"),
    ("siemens", "s7-300"), ("siemens", "s7-400"), ("siemens", "s7-1200"), ("siemens", "s7-1500"), ("siemens", "simatic"),
    ("rockwell", "logix"), ("rockwell", "allen-bradley"), ("rockwell", "factorytalk"),
    ("abb", "ac800m"), ("abb", "symphony"),
]

# fixed values: ports, functions, registers
DPI_PORTS = [(502, "Modbus/TCP"), (20000, "DNP3"), (44818, "EtherNet/IP"), (2222, "EtherNet/IP"), (102, "S7comm (Siemens)"), (4840, "OPC UA"), (47808, "BACnet"), (1911, "Niagara Fox"), (789, "Red Lion Crimson")]
FLOW_PORTS = [(502, "Modbus/TCP"), (20000, "DNP3"), (44818, "EtherNet/IP"), (102, "S7comm"), (4840, "OPC UA"), (47808, "BACnet")]
ICS_PORTS = [502, 20000, 44818, 102, 4840]
MODBUS_FUNCTIONS = [(1, "Read Coils"), (2, "Read Discrete Inputs"), (3, "Read Holding Registers"), (4, "Read Input Registers"), (5, "Write Single Coil"), (6, "Write Single Register"), (15, "Write Multiple Coils"), (16, "Write Multiple Registers"), (20, "Read File Record"), (21, "Write File Record"), (22, "Mask Write Register"), (23, "Read/Write Multiple Registers")]
WRITE_FUNCTIONS, READ_FUNCTIONS = [5, 6, 15, 16, 21, 22], [1, 2, 3, 4, 20]
CRITICAL_REGISTERS = [(0, 100, "System Configuration"), (100, 200, "Safety Interlocks"), (200, 300, "Process Control"), (1000, 2000, "Alarm Settings")]
SEVERITIES = [("CRITICAL", 4), ("HIGH", 3), ("MEDIUM", 2), ("LOW", 1)]
ZONES = [(0, "Physical process"), (1, "Basic control"), (2, "Supervisory control"), (3, "Operations"), (4, "Enterprise")]


def rows(spark: SparkSession, data: list, schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def patterns(spark: SparkSession) -> DataFrame:
    return rows(spark, [(i, *p) for i, p in enumerate(PATTERNS)], "ord int, pattern string, severity string, name string, technique string")


def mitre(spark: SparkSession) -> DataFrame:
    return rows(spark, [(i, *p) for i, p in enumerate(MITRE)], "ord int, pattern string, technique_id string, technique_name string, tactic string")


def values_sql(data: list, columns: str, name: str) -> str:
    """The same rows as a common table expression."""
    quote = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in data)})"
