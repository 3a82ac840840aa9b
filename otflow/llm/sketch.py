"""Count-min sketches over hashes, built in partitions and merged by key.

A sketch has two rows of 2**bits cells that count to two. A partition sends its
cells as sorted 16-bit offsets by block of 2**15 cells, so the exchange carries
about four bytes a hash; a block is merged wherever it lands. The merged sketch
keeps one bit a cell: whether the cell was hit twice. A hash that occurs twice
always has both its bits set; others rarely. ``bits`` grows with the input up to
``MAX_BITS``, which bounds what is broadcast to 2 * 2**MAX_BITS / 8 bytes
(128 MB); beyond that more hashes pass and the exact step does more work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

MAX_BITS = 29
BLOCK_BITS = 15
SCHEMA = "block int, cells binary"
_SALTS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
FLUSH = 1 << 22


def bits_for(hashes: float) -> int:
    return int(min(MAX_BITS, max(BLOCK_BITS, np.ceil(np.log2(max(1.0, 2.0 * hashes))))))


def _cells(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(hashes ^ salt) >> np.uint64(64 - bits)) + np.uint64(row << bits) for row, salt in enumerate(_SALTS)]


class LocalSketch:
    """One partition's part. ``rows`` gives what was added so far and starts anew."""

    def __init__(self, bits: int):
        self.bits, self.held, self.n = bits, [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.held += _cells(hashes, self.bits)
        self.n += len(hashes)

    def rows(self, twice: bool = False):
        if not self.n:
            return
        cells = np.sort(np.concatenate(self.held))
        self.held, self.n = [], 0
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        many = np.ones(len(first), np.uint64) if twice else (np.diff(np.concatenate([first, [len(cells)]])) > 1).astype(np.uint64)
        cells = cells[first]
        packed = (((cells & np.uint64((1 << BLOCK_BITS) - 1)) << np.uint64(1)) | many).astype("<u2")
        blocks = (cells >> np.uint64(BLOCK_BITS)).astype(np.int32)
        cut = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
        offsets = np.concatenate([cut, [len(cells)]]).astype(np.int32) * 2
        data = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
        yield pa.RecordBatch.from_arrays([pa.array(blocks[cut]), data], names=["block", "cells"])


def _merge(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            packed = np.frombuffer(cells.as_buffer(), "<u2")
            counts = held.setdefault(block, np.zeros(1 << BLOCK_BITS, np.uint8))
            at = packed >> 1
            counts[at] = np.minimum(counts[at] + 1 + (packed & 1).astype(np.uint8), 2)
    out = [(b, np.packbits(c == 2, bitorder="little").tobytes()) for b, c in held.items() if (c == 2).any()]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["block", "cells"])


def merged(parts: DataFrame, bits: int):
    """Broadcast of the merged sketch: a bit for each cell hit twice, at most 2 * 2**MAX_BITS bits."""
    whole = np.zeros(2 << bits >> 3, np.uint8)
    width = 1 << BLOCK_BITS >> 3
    for block, data in parts.repartition(F.col("block")).mapInArrow(_merge, SCHEMA).toLocalIterator():
        whole[block * width : (block + 1) * width] = np.frombuffer(data, np.uint8)
    return parts.sparkSession.sparkContext.broadcast(whole)


def repeated(whole: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may occur twice or more; none that does is missed."""
    out = np.ones(len(hashes), bool)
    for cells in _cells(hashes, bits):
        out &= (whole[(cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out
