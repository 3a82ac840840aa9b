"""Packets to bidirectional flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import has_flag
from .ordered import SLICE_ROWS, numeric, placed, sliced

KEYS = ["end_a", "end_b", "proto"]
FLAGS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32}


def keyed(packets: DataFrame) -> DataFrame:
    """With the flow's key: the 5-tuple, its two ends in one order whatever the direction."""
    a, b = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")), F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    return packets.withColumns({"end_a": F.least(a, b), "end_b": F.greatest(a, b), "own_end": a})


def iat(packets: DataFrame, rows: int = SLICE_ROWS) -> DataFrame:
    """Time since the packet before in the same flow; null for the first. Flows of more than ``rows`` packets are cut into slices."""
    held = keyed(packets)
    cut = sliced(held.withColumn("_at", placed(F.col("ts"))), KEYS, "_at", numeric(held, "pkt_id"), rows)
    out = cut.led(["ts", "pkt_id"], 1).withColumn("iat", F.col("ts") - F.lag("ts").over(cut.window("ts", "pkt_id")))
    return out.where(~F.col("_copy")).drop("_at", "_slice", "_copy")


def assemble(packets: DataFrame, rows: int = SLICE_ROWS) -> DataFrame:
    """One row a flow. Forward is the direction of the first packet (ties by pkt_id).

    Both directions are summed up by end, in parts that merge in any order, and named once the first packet is known: no
    window but that of the gaps, so one long flow is spread."""
    held = iat(packets, rows)
    place = F.struct("ts", "pkt_id")
    out, names = [], []
    for end, mine in (("a", F.col("own_end") == F.col("end_a")), ("b", F.col("own_end") != F.col("end_a"))):
        own = lambda c, mine=mine: F.when(mine, c)
        sums = {"packets": F.count(own(F.lit(1))), "bytes": F.coalesce(F.sum(own(F.col("length"))), F.lit(0))}
        sums |= {f"size_{k}": f(own(F.col("length"))) for k, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("std", F.stddev_pop))}
        sums |= {n: F.min_by(own(F.col(c)), own(place)) for n, c in (("ttl", "ttl"), ("win", "tcp_window"))}
        sums |= {flag: F.count(own(F.when(has_flag(F.col("tcp_flags"), bit), 1))) for flag, bit in FLAGS.items()}
        names = list(sums)
        out += [c.alias(f"{end}_{n}") for n, c in sums.items()]
    whole = [F.min_by("own_end", place).alias("head"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.avg("iat").alias("iat_mean"), F.stddev_pop("iat").alias("iat_std"), F.avg("length").alias("size_mean"), F.stddev_pop("length").alias("size_std")]
    done = held.groupBy(*KEYS).agg(*whole, *out)
    a_leads = F.col("head") == F.col("end_a")
    tail = F.when(a_leads, F.col("end_b")).otherwise(F.col("end_a"))
    named = [F.when(a_leads, F.col(f"{x}_{n}")).otherwise(F.col(f"{y}_{n}")).alias(f"{way}_{n}") for way, x, y in (("fwd", "a", "b"), ("bwd", "b", "a")) for n in names]
    return done.withColumn("tail", tail).select(F.col("head.ip").alias("src_ip"), F.col("tail.ip").alias("dst_ip"), F.col("head.port").alias("src_port"), F.col("tail.port").alias("dst_port"), "proto", "start", "end", "iat_mean", "iat_std", "size_mean", "size_std", *named)
