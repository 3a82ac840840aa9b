"""Deep packet inspection and rule evaluation over packets: projections and predicates on payload bytes, no shuffle but the rules' windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.knowledge import CRITICAL_REGISTERS, DPI_PORTS, MODBUS_FUNCTIONS, READ_FUNCTIONS, WRITE_FUNCTIONS, rows
from ..functions.scalar import byte_at, hex_label, u16be, u16le


def tcp(packets: DataFrame) -> DataFrame:
    return packets.where("proto = 6")


#: Protocols without a decoder.
PLAIN = ("BACnet", "Niagara Fox", "Red Lion Crimson")


def route(packets: DataFrame) -> DataFrame:
    """TCP packets to a known port, with the protocol's name; protocols without a decoder are MEDIUM at once."""
    dim = F.broadcast(rows(packets.sparkSession, DPI_PORTS, "dst_port int, protocol string"))
    plain = F.col("protocol").isin(*PLAIN)
    return tcp(packets).join(dim, "dst_port").withColumn("severity", F.when(plain, "MEDIUM")).withColumn("alert", F.when(plain, F.concat("protocol", F.lit(" detected on port "), F.col("dst_port").cast("string"))))


def is_critical(address: Column) -> Column:
    out = F.lit(False)
    for low, high, _ in CRITICAL_REGISTERS:
        out = out | ((address >= low) & (address < high))
    return F.coalesce(out, F.lit(False))


def modbus(packets: DataFrame) -> DataFrame:
    p, n = F.col("payload"), F.length("payload")
    held = tcp(packets).where("dst_port = 502 and length(payload) >= 8").select(
        "pkt_id", "src_ip", "dst_ip", u16be(p, 0).alias("transaction_id"), u16be(p, 2).alias("protocol_id"), byte_at(p, 6).alias("unit_id"), byte_at(p, 7).alias("function_code"),
        u16be(p, 8).alias("address"), u16be(p, 10).alias("value"), byte_at(p, 12).alias("byte_count"), (n - 8).alias("left"),
    )
    fc, bad, critical = F.col("function_code"), F.col("protocol_id") != 0, is_critical(F.col("address"))
    read, write = (fc == 3) & (F.col("left") >= 4), (fc == 6) & (F.col("left") >= 4)
    many = (fc == 16) & (F.col("left") >= 5)
    name = F.element_at(F.create_map(*[x for k, v in MODBUS_FUNCTIONS for x in (F.lit(k), F.lit(v))]), fc)
    severity = F.when(bad, "CRITICAL").when(name.isNull(), "CRITICAL").when(read & critical, "HIGH").when(write & critical, "CRITICAL").when(write, "HIGH").when(many, "CRITICAL").otherwise("LOW")
    text = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i.cast("string") for i in x])
    a, v = F.col("address"), F.col("value")
    alert = (
        F.when(bad, F.format_string("Invalid Modbus protocol ID: 0x%04X (should be 0x0000)", F.col("protocol_id")))
        .when(name.isNull(), F.format_string("Unknown Modbus function code: 0x%02X", fc))
        .when(read & critical, text("Read access to critical registers: ", a, "-", a + v))
        .when(write & critical, text("CRITICAL: Write to protected register ", a))
        .when(write, text("Modbus WRITE to register ", a, " = ", v))
        .when(many, text("Multiple register write: ", v, " registers starting at ", a))
    )
    hide = lambda c: F.when(~bad, c)
    return held.select(
        "pkt_id", F.lit("Modbus/TCP").alias("protocol"), severity.alias("severity"), alert.alias("alert"), "transaction_id", hide(F.col("unit_id")).alias("unit_id"), hide(fc).alias("function_code"),
        hide(F.coalesce(name, F.format_string("Unknown (0x%02X)", fc))).alias("function_name"), hide(fc.isin(WRITE_FUNCTIONS)).alias("is_write"), hide(fc.isin(READ_FUNCTIONS)).alias("is_read"),
        F.when(~bad & (read | write | many), a).alias("address"), F.when(~bad & (read | write | many), v).alias("value"), F.when(~bad & many, F.col("byte_count")).alias("byte_count"), bad.alias("is_malformed"), (~bad & name.isNull()).alias("suspicious"),
    )


def dnp3(packets: DataFrame) -> DataFrame:
    p = F.col("payload")
    held = tcp(packets).where("dst_port = 20000 and length(payload) >= 10").where((byte_at(p, 0) == 5) & (byte_at(p, 1) == 0x64))
    to, by = u16le(p, 4), u16le(p, 6)
    return held.select("pkt_id", F.lit("DNP3").alias("protocol"), F.when((to > 65000) | (by > 65000), "CRITICAL").otherwise("HIGH").alias("severity"), to.alias("destination_address"), by.alias("source_address"), byte_at(p, 2).alias("frame_length"), byte_at(p, 3).alias("control"))


#: fixed values: encapsulation commands
ENIP_COMMANDS = [(0x0004, "ListServices"), (0x0063, "ListIdentity"), (0x0064, "ListInterfaces"), (0x0065, "RegisterSession"), (0x0066, "UnRegisterSession"), (0x006F, "SendRRData"), (0x0070, "SendUnitData")]


def ethernetip(packets: DataFrame) -> DataFrame:
    p = F.col("payload")
    code = F.when(F.length(p) >= 24, u16le(p, 0))
    name = F.element_at(F.create_map(*[x for k, v in ENIP_COMMANDS for x in (F.lit(k), F.lit(v))]), code)
    command = F.when(code.isNotNull(), F.coalesce(name, F.lit("Unknown")))
    return tcp(packets).where("dst_port in (44818, 2222)").select("pkt_id", F.lit("EtherNet/IP").alias("protocol"), F.when(command.isin("SendRRData", "SendUnitData"), "HIGH").otherwise("MEDIUM").alias("severity"), command.alias("command"))


def s7comm(packets: DataFrame) -> DataFrame:
    p = F.col("payload")
    framed = (F.length(p) >= 4) & (byte_at(p, 0) == 3)
    return tcp(packets).where("dst_port = 102").select("pkt_id", F.lit("S7comm").alias("protocol"), F.when(framed, "CRITICAL").otherwise("HIGH").alias("severity"), F.when(framed, u16be(p, 2)).alias("tpkt_length"))


def opcua(packets: DataFrame) -> DataFrame:
    return tcp(packets).where("dst_port = 4840").select("pkt_id", F.lit("OPC UA").alias("protocol"), F.lit("MEDIUM").alias("severity"))


def event_of(port: Column, payload: Column) -> Column:
    """(protocol, severity) of a packet from its port and payload, null where no decoder takes it.

    The payload's first bytes are taken once, as numbers, and bound by a lambda: written out, the decoders' conditions
    would repeat their extraction hundreds of times and outgrow what a generated method can hold."""
    head = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.conv(F.hex(F.substring(payload, i, F.lit(1))), 16, 10).cast("int"))

    def judged(x: Column) -> Column:
        b, n, code = (lambda i: F.get(x["b"], i)), x["n"], F.get(x["b"], 7)
        be, le = (lambda i: b(i) * 256 + b(i + 1)), (lambda i: b(i + 1) * 256 + b(i))
        known, enough, critical = code.isin([k for k, _ in MODBUS_FUNCTIONS]), n >= 12, is_critical(be(8))
        strange = F.coalesce(be(2) != 0, F.lit(False)) | ~known
        on_modbus = F.when(strange | ((code == 16) & (n >= 13)) | ((code == 6) & enough & critical), "CRITICAL").when(((code == 3) & enough & critical) | ((code == 6) & enough), "HIGH").otherwise("LOW")
        command = F.when(n >= 24, le(0))
        event = lambda p, s: F.struct(F.lit(p).alias("protocol"), s.alias("severity"))
        out = (
            F.when((x["port"] == 502) & (n >= 8), event("Modbus/TCP", on_modbus))
            .when((x["port"] == 20000) & (n >= 10) & (b(0) == 5) & (b(1) == 0x64), event("DNP3", F.when((le(4) > 65000) | (le(6) > 65000), "CRITICAL").otherwise("HIGH")))
            .when(x["port"].isin(44818, 2222), event("EtherNet/IP", F.when(command.isin([c for c, name in ENIP_COMMANDS if name.startswith("Send")]), "HIGH").otherwise("MEDIUM")))
            .when(x["port"] == 102, event("S7comm", F.when((n >= 4) & (b(0) == 3), "CRITICAL").otherwise("HIGH")))
            .when(x["port"] == 4840, event("OPC UA", F.lit("MEDIUM")))
        )
        for p, name in DPI_PORTS:
            if name in PLAIN:
                out = out.when(x["port"] == p, event(name, F.lit("MEDIUM")))
        return out

    return F.get(F.transform(F.array(F.struct(port.alias("port"), F.coalesce(F.length(payload), F.lit(0)).alias("n"), head.alias("b"))), judged), 0)


def events(packets: DataFrame) -> DataFrame:
    """All inspection events with what they share, in one pass over the packets."""
    return tcp(packets).select("pkt_id", event_of(F.col("dst_port"), F.col("payload")).alias("event")).where("event is not null").select("pkt_id", "event.protocol", "event.severity")


def alerts(found: DataFrame) -> DataFrame:
    return found.where(F.col("severity").isin("HIGH", "CRITICAL"))


def statistics(packets: DataFrame) -> DataFrame:
    """Packets and alerts by protocol; malformed Modbus isn't counted."""
    whole = modbus(packets).where("not is_malformed").select("protocol", "severity")
    for f in (dnp3, ethernetip, s7comm, opcua):
        whole = whole.unionByName(f(packets).select("protocol", "severity"))
    return whole.groupBy("protocol").agg(F.count(F.lit(1)).alias("packets"), F.sum(F.when(F.col("severity").isin("HIGH", "CRITICAL"), 1).otherwise(0)).alias("alerts"))


def critical_register(addresses: DataFrame) -> DataFrame:
    """Range join of ``address`` with the four register ranges (a fixed table)."""
    dim = F.broadcast(rows(addresses.sparkSession, CRITICAL_REGISTERS, "low int, high int, description string"))
    return addresses.join(dim, (F.col("address") >= F.col("low")) & (F.col("address") < F.col("high")), "left").drop("low", "high")


def _modbus_fc(packets: DataFrame) -> DataFrame:
    p = F.col("payload")
    return tcp(packets).where("dst_port = 502 and length(payload) >= 8").where(u16be(p, 2) == 0).withColumn("fc", byte_at(p, 7))


def rule_threshold(packets: DataFrame, function: int, count: int, seconds: int) -> DataFrame:
    """Sources with at least ``count`` requests of a function in a tumbling window."""
    hit = _modbus_fc(packets).where(F.col("fc") == function)
    window = F.window(F.timestamp_seconds("ts"), f"{seconds} seconds")
    return hit.groupBy("src_ip", window.alias("w")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count).select("src_ip", F.unix_seconds("w.start").alias("window_start"), "n")


def rule_flooding(packets: DataFrame, count: int = 100, seconds: int = 1) -> DataFrame:
    return rule_threshold(packets, 1, count, seconds)


def rule_scanning(packets: DataFrame, count: int = 50, seconds: int = 10) -> DataFrame:
    return rule_threshold(packets, 1, count, seconds)


def rule_replay(packets: DataFrame, count: int = 20, seconds: int = 1) -> DataFrame:
    return rule_threshold(packets, 3, count, seconds)


def rule_unauthorized_write(packets: DataFrame) -> DataFrame:
    return _modbus_fc(packets).where("fc in (6, 16)").select("pkt_id", "src_ip", "dst_ip", "fc")


def rule_mitm(packets: DataFrame) -> DataFrame:
    return tcp(packets).where("dst_port = 502 and ttl = 128").select("pkt_id", "src_ip", "dst_ip")


def functions_of(events_: DataFrame) -> DataFrame:
    return events_.withColumn("function_hex", hex_label(F.col("function_code")))
