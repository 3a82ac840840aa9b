"""Packets of classic capture files of any size, read in byte ranges.

A capture has no marks between packets. Each range looks for its first packet: the
first place from which a run of plausible headers goes on, which payloads may imitate.
So the ranges are linked first: a job follows the headers through every range and gives
where the chain left it; a range whose start isn't where the chain before it ended is
followed anew from there, until all fit. Only then are packets decoded, each range from
its exact start, so a cut file gives the packets, and the numbers, of the whole file.
The driver holds four numbers a range (``RANGE`` bytes).

A truncated file gives the packets before the cut. Files are opened by their URI with
Arrow's file systems; where there is none for it, Spark reads each file as one cell.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKETS = "pkt_id long, ts double, src_ip string, dst_ip string, proto int, src_port int, dst_port int, ttl int, length int, tcp_flags int, tcp_window int, payload binary, file string"
RANGE = 64 << 20
#: Tasks at most for ranges that are followed anew.
TASKS = 1000
#: Headers that must be plausible in a row, and the longest packet that is.
RUN, LONGEST = 24, 262_144
# fixed values: the magic numbers of the format, by byte order and unit of the fraction
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}
#: Where the chain of a file that is no capture goes.
_NOWHERE = 1 << 62
_NUMBERS = ("src_port", "dst_port", "tcp_flags", "tcp_window", "proto", "ttl", "length")


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


class Capture:
    """A capture's bytes through a sliding buffer. ``order`` is None if it is none."""

    def __init__(self, source, size: int, block: int = 1 << 20):
        self.source, self.size, self.block, self.first, self.held = source, size, block, 0, b""
        self.order, self.unit = MAGIC.get(self.bytes(0, 4), (None, 1.0)) if size >= 24 else (None, 1.0)

    @classmethod
    def open(cls, path: str) -> Capture:
        system, name = fs.FileSystem.from_uri(_uri(path))
        return cls(system.open_input_file(name), system.get_file_info(name).size)

    def bytes(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at``, fewer at the end."""
        if at < self.first or at + n > self.first + len(self.held):
            self.source.seek(at)
            self.first, self.held = at, self.source.read(max(n, self.block))
        return self.held[at - self.first : at - self.first + n]

    def header(self, at: int) -> tuple[int, int, int, int] | None:
        """Seconds, fraction, kept and full length of the packet at ``at``; None where no whole packet is left."""
        head = self.bytes(at, 16)
        if len(head) < 16:
            return None
        out = struct.unpack(self.order + "IIII", head)
        return out if at + 16 + out[2] <= self.size else None

    def starts(self, at: int) -> bool:
        """Whether a run of plausible headers begins at ``at``, or goes on to the end."""
        for _ in range(RUN):
            head = self.bytes(at, 16)
            if len(head) < 16:
                return True
            _, fraction, kept, full = struct.unpack(self.order + "IIII", head)
            if fraction >= self.unit or kept > min(full, LONGEST) or full > 1 << 24:
                return False
            at += 16 + kept
            if at >= self.size:
                return True
        return True

    def find(self, first: int, last: int) -> int:
        """The first place in [first, last) that looks like a packet's; ``last`` if none does."""
        return next((at for at in range(max(first, 24), min(last, self.size)) if self.starts(at)), last)

    def follow(self, start: int, last: int) -> tuple[int, int]:
        """Where the chain from ``start`` leaves a range that ends at ``last``, and how many of its packets are decoded."""
        n = 0
        while start < last:
            head = self.header(start)
            if head is None:
                return max(last, self.size), n
            n += self.decoded(start, head[2])
            start += 16 + head[2]
        return start, n

    def decoded(self, at: int, kept: int) -> bool:
        """Whether a frame is IPv4 with a whole header."""
        return kept >= 34 and self.bytes(at + 16, 14)[12:14] == b"\x08\x00"

    def packets(self, start: int, last: int):
        while start < last and (head := self.header(start)):
            seconds, fraction, kept, full = head
            if self.decoded(start, kept):
                yield (seconds + fraction / self.unit, *_frame(self.bytes(start + 16, kept), full))
            start += 16 + kept


def _frame(frame: bytes, length: int) -> tuple:
    """Addresses, protocol, ports, time to live, length, flags, window and payload of an IPv4 frame."""
    ip = frame[14:]
    head, proto = (ip[0] & 15) * 4, ip[9]
    l4 = ip[head : struct.unpack(">H", ip[2:4])[0]]
    ports, flags, window, payload = (None, None), None, None, b""
    if proto == 6 and len(l4) >= 20:
        ports, flags, window, payload = struct.unpack(">HH", l4[:4]), l4[13], struct.unpack(">H", l4[14:16])[0], l4[(l4[12] >> 4) * 4 :]
    elif proto == 17 and len(l4) >= 8:
        ports, payload = struct.unpack(">HH", l4[:4]), l4[8:]
    return ".".join(map(str, ip[12:16])), ".".join(map(str, ip[16:20])), proto, *ports, ip[8], length, flags, window, payload


def _frames(found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=[c.split()[0] for c in PACKETS.split(", ")]).astype(dict.fromkeys(_NUMBERS, "Int32"))


def _link(frames):
    for frame in frames:
        out = []
        for file, first, last, start in frame[["file", "first", "last", "start"]].itertuples(index=False):
            capture = Capture.open(file)
            if capture.order is None:
                out.append((file, first, last, last, _NOWHERE, 0))
                continue
            begin = int(start) if start >= 0 else capture.find(int(first), int(last))
            end, n = capture.follow(begin, int(last))
            out.append((file, first, last, begin, end, n))
        yield pd.DataFrame(out, columns=["file", "first", "last", "start", "stop", "n"])


def linked(spark: SparkSession, ranges: DataFrame) -> list[tuple]:
    """(file, start, stop, number of the first packet) of all ranges, whose starts are exact."""
    schema = "file string, first long, last long, start long, stop long, n long"
    known: dict[tuple, list] = {}
    todo = ranges.withColumn("start", F.when(F.col("first") == 0, 24).otherwise(-1).cast("long"))
    while True:  # a round mends all ranges behind right ones, mostly all there are
        for r in todo.mapInPandas(_link, schema).collect():
            known[r["file"], r["first"]] = [r["last"], r["start"], r["stop"], r["n"]]
        out, again, file, at, number = [], [], None, 0, 0
        for (name, first), (last, start, stop, n) in sorted(known.items()):
            if name != file:
                file, at, number = name, _NOWHERE if stop == _NOWHERE else start, 0
            want = at
            if want >= last:  # a packet covers the whole range
                start, stop, n = want, want, 0
            elif start != want:
                again.append((name, first, last, want))
            out.append((name, start, stop, number))
            at, number = stop, number + n
        if not again:
            return [r for r in out if r[1] < r[2]]
        todo = spark.createDataFrame(again, "file string, first long, last long, start long").repartition(min(len(again), TASKS), "file", "first")


def _decode(frames):
    for frame in frames:
        for file, start, stop, number in frame[["file", "start", "stop", "number"]].itertuples(index=False):
            found = []
            for k, packet in enumerate(Capture.open(file).packets(int(start), int(stop))):
                found.append((int(number) + k, *packet, file))
                if len(found) == 4096:
                    yield _frames(found)
                    found = []
            if found:
                yield _frames(found)


def _whole(frames):
    """Captures that Spark has read as cells."""
    from io import BytesIO

    for frame in frames:
        for file, content in zip(frame["path"], frame["content"], strict=True):
            capture = Capture(BytesIO(content), len(content))
            if capture.order:
                yield _frames([(k, *p, file) for k, p in enumerate(capture.packets(24, len(content)))])


def captures(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """Packets of the capture files at ``path``, in tasks of ``size`` bytes. ``pkt_id`` numbers the packets of a file from 0."""
    files = spark.read.format("binaryFile").load(path)
    one = files.select("path").limit(1).collect()
    try:
        for r in one:
            fs.FileSystem.from_uri(_uri(r["path"]))
    except (ValueError, OSError, NotImplementedError):
        return files.select("path", "content").mapInPandas(_whole, PACKETS)
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long")))
    ranges = files.select(F.col("path").alias("file"), "length", first.alias("first")).select("file", "first", F.least(F.col("first") + size, F.col("length")).alias("last"))
    parts = linked(spark, ranges.repartition("file", "first"))
    if not parts:
        return spark.createDataFrame([], PACKETS)
    todo = spark.createDataFrame(parts, "file string, start long, stop long, number long")
    return todo.repartition(len(parts), "file", "start").mapInPandas(_decode, PACKETS)
