"""Captures in byte ranges give the packets of the whole file."""

import random
import struct

import pytest

from otflow.sources import captures as C


def frame(draw, payload, order="<", kind=b"\x08\x00"):
    proto = draw.choice([6, 17, 1])
    l4 = {6: struct.pack(">HHIIBBHHH", 1000, 502, 1, 1, 0x50, 24, 512, 0, 0), 17: struct.pack(">HHHH", 53, 53, 8 + len(payload), 0), 1: b"\x08\x00"}[proto] + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(l4), 1, 0, draw.randrange(1, 255), proto, 0, bytes([10, 0, 0, draw.randrange(9)]), bytes([10, 0, 1, 2])) + l4
    eth = bytes(12) + kind + ip
    return struct.pack(order + "IIII", 1_700_000_000 + draw.randrange(99), draw.randrange(10**6), len(eth), len(eth) + draw.randrange(3)) + eth


def capture(seed, n=60, magic=b"\xd4\xc3\xb2\xa1"):
    draw = random.Random(seed)
    order = C.MAGIC[magic][0]
    out = magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, 1)
    for k in range(n):
        nested = b"".join(frame(draw, b"x" * draw.randrange(30), order) for _ in range(draw.randrange(4)))  # looks like packets, up to its packet's end
        out += frame(draw, draw.choice([b"", bytes(draw.randrange(400)), nested, nested]), order, b"\x86\xdd" if k % 11 == 5 else b"\x08\x00")
    return out


@pytest.mark.parametrize(("magic", "size"), [(m, n) for m, n in zip(C.MAGIC, (400, 900, 2500, 6000), strict=True)])
def test_ranges_give_the_packets_of_the_file(spark, tmp_path, monkeypatch, magic, size):
    monkeypatch.setattr(C, "RUN", 2)  # so that nested packets deceive
    whole = capture(1, magic=magic)
    for name, data in {"a": whole, "cut": whole[:-9], "header": whole[:24], "short": whole[:10], "none": b"no capture" * 90, "empty": b""}.items():
        (tmp_path / f"{name}.pcap").write_bytes(data)
    rows = lambda size: sorted(tuple(r) for r in C.captures(spark, f"file://{tmp_path}", size).collect())
    want = rows(1 << 20)
    assert rows(size) == want
    numbers = [r[0] for r in want if r[-1].endswith("/a.pcap")]
    assert numbers == list(range(60 - 5)) and len(want) == 55 + 54


def test_links_are_mended():
    """Without the links, some ranges would start inside a packet."""
    import io

    data = capture(2)
    wrong = 0
    true, at = set(), 24
    while at < len(data):
        true.add(at)
        at += 16 + struct.unpack("<I", data[at + 8 : at + 12])[0]
    reader = C.Capture(io.BytesIO(data), len(data), 64)
    for first in range(97, len(data), 97):
        found = reader.find(first, first + 97)
        wrong += found < first + 97 and found not in true
    assert wrong


def test_no_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "empty.pcap").write_bytes(b"")
    assert C.captures(spark, f"file://{tmp_path}/x").collect() == []
