"""What the operators share: table access, lineage cuts and the text kernel.

The text kernel works on Arrow string columns without building Python strings:
it views the UTF-8 bytes as a numpy array, finds words and takes polynomial
hashes of any byte or word range from prefix sums: fast ones modulo 2**64
(:class:`RangeHash`) where equal hashes only mean "look closer", and fingerprints
modulo 2**61 - 1 with bases drawn anew for each query (:class:`Fingerprint`)
where they stand for equal content. Two given strings of n units share a
fingerprint with a probability of n / 2**61 over the draw, whatever they hold.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import secrets
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy step works on; longer texts form a step of their own.
STEP_BYTES = 1 << 18


def tidy(run):
    """A task's function over batches that gives freed memory back to the system at its end: Python workers are used again by later stages."""

    def tidied(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no malloc_trim
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``). There is no other: a machine's own folder isn't shared."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return held


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts the
    lineage, survives lost executors, and keeps only the columns a reader asks for."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(column: pa.Array, step: int = STEP_BYTES):
    """(first row, last row, bytes, offsets) pieces of a string column of about ``step`` bytes each.

    ``offsets`` counts from the first byte of the piece; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + step, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def odd_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class RangeHash:
    """Polynomial hashes modulo 2**64 of ranges, O(1) each, from prefix sums.

    The same content has the same hash wherever it starts. Power tables are kept and grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.zeros(0, np.uint64)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        if len(self.up) < n + 1:
            self.up, self.down = odd_powers(self.base, n + 1), odd_powers(self.inverse, n + 1)
        out = np.empty(n + 1, np.uint64)
        out[0] = 0
        np.cumsum(values * self.up[:n], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start])


_PRIME, _LOW31, _LOW30 = np.uint64((1 << 61) - 1), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_31, _30, _61, _1 = (np.uint64(n) for n in (31, 30, 61, 1))
#: Values that are multiplied at a time, so that what lies between stays in the cache.
_LANE = 1 << 15


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> _61)
    return np.where(x >= _PRIME, x - _PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, from halves of 31 bits."""
    out = np.empty(len(a), np.uint64)
    for k in range(0, len(a), _LANE):
        x, y = a[k : k + _LANE], b[k : k + _LANE]
        x0, x1, y0, y1 = x & _LOW31, x >> _31, y & _LOW31, y >> _31
        mid = x1 * y0 + x0 * y1
        out[k : k + _LANE] = _mod(((x1 * y1) << _1) + (mid >> _30) + ((mid & _LOW30) << _31) + x0 * y0)
    return out


def _running(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2, ... values modulo 2**61 - 1."""
    out = np.zeros(len(x) + 1, np.uint64)
    high = _mod(np.cumsum(x >> _31))
    out[1:] = _mod(_mod(np.cumsum(x & _LOW31)) + (high >> _30) + ((high & _LOW30) << _31))
    return out


class Fingerprint:
    """Like :class:`RangeHash`, modulo 2**61 - 1. Values are below 2**61 - 1; bytes are taken as 1 to 256."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, (1 << 61) - 1)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        while len(self.up) < n:
            have = len(self.up)
            for name, base in (("up", self.base), ("down", self.inverse)):
                own = getattr(self, name)
                setattr(self, name, np.concatenate([own, times(own, np.full(have, pow(base, have, (1 << 61) - 1), np.uint64))]))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        if values.dtype == np.uint8:
            values = values.astype(np.uint64) + _1
        self._powers(len(values) + 1)
        return _running(times(values, self.up[: len(values)]))

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return times(_mod(prefix[end] + _PRIME - prefix[start]), self.down[start])


def fresh_bases(n: int) -> list[int]:
    """Bases of fingerprints for one query; tasks get them with their code, so that repeated tasks have the same."""
    return [secrets.randbelow((1 << 61) - (1 << 32)) + (1 << 31) for _ in range(n)]


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (sizes[0] of them), first[1], ..."""
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def only(data: np.ndarray, offsets: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some texts one after the other, and by text (of all) how far its bytes moved."""
    shift = np.zeros(len(offsets) - 1, np.int64)
    if len(texts) == len(shift):
        return data, shift
    sizes = offsets[texts + 1] - offsets[texts]
    shift[texts] = np.cumsum(sizes) - sizes - offsets[texts]
    return data[ranges(offsets[texts], sizes)], shift


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_table(seed: int) -> np.ndarray:
    return mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(seed))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Random value of each byte, one table for each of two independent hashes.
BYTE_VALUES = (_byte_table(0x9E3779B97F4A7C15), _byte_table(0xD1B54A32D192ED03))
BASES = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)


def word_bounds(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of a piece, and the index of the first word of each text."""
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    solid = ~space
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = True
        before[1:] = space[:-1]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = True
        after[:-1] = space[1:]
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ascii_lower(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return np.where(upper, data + np.uint8(32), data)
