"""Sweeps over sorted flows: what lies in a window around each, without lists.

Windows are ranges of places in time order. Counts, spans and gaps come from prefix
sums; distinct destinations and histograms from ranks: :class:`Ranks` counts how many
values of a range are small, or finds its k-th smallest, in one step a bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .features import SESSION

BINS = 10


class Ranks:
    """Wavelet matrix over ranks: for each bit, how many zeros lie before each place."""

    def __init__(self, ranks: np.ndarray):
        self.bits, self.zeros = max(1, int(ranks.max(initial=0)).bit_length()), []
        now = ranks.astype(np.int64)
        for bit in reversed(range(self.bits)):
            zero = (now >> bit) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]).astype(np.int32))
            now = np.concatenate([now[zero], now[~zero]])

    def _down(self, level: int, low: np.ndarray, high: np.ndarray, right: np.ndarray):
        zeros = self.zeros[level]
        a, z, all_ = zeros[low], zeros[high], zeros[-1]
        return np.where(right, all_ + low - a, a), np.where(right, all_ + high - z, z), z - a

    def less(self, low: np.ndarray, high: np.ndarray, than: np.ndarray) -> np.ndarray:
        """How many ranks in [low, high) are below ``than``."""
        out = np.where(than >> self.bits > 0, high - low, 0)
        for level in range(self.bits):
            right = (than >> (self.bits - 1 - level)) & 1 == 1
            low, high, zeros = self._down(level, low, high, right)
            out += np.where(right & (than >> self.bits == 0), zeros, 0)
        return out

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest rank, from 0, in [low, high)."""
        out, k = np.zeros(len(low), np.int64), k.copy()
        for level in range(self.bits):
            zeros = self.zeros[level][high] - self.zeros[level][low]
            right = k >= zeros
            k -= np.where(right, zeros, 0)
            out = out << 1 | right
            low, high, _ = self._down(level, low, high, right)
        return out


def _entropy(payload: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Entropy in bits of ``BINS`` equal bins between the least and largest of the positive values in each [low, high)."""
    some = payload > 0
    before = np.concatenate([[0], np.cumsum(some)])
    low, high = before[low], before[high]
    out = np.zeros(len(low))
    values, ranks = np.unique(payload[some], return_inverse=True)
    at = np.flatnonzero(high - low > 1)
    if not len(at):
        return out
    tree, low, high = Ranks(ranks), low[at], high[at]
    n = high - low
    least, most = (values[tree.kth(low, high, k)] for k in (np.zeros(len(at), np.int64), n - 1))
    wide = most > least
    at, low, high, n, least, most = (x[wide] for x in (at, low, high, n, least, most))

    def bin_of(rank: np.ndarray) -> np.ndarray:
        return np.floor((values[np.clip(rank, 0, len(values) - 1)] - least) / (most - least) * BINS)

    below, total = np.zeros(len(at), np.int64), np.zeros(len(at))
    for k in range(1, BINS + 1):
        if k < BINS:
            edge = np.searchsorted(values, least + (most - least) * (k / BINS))
            for step in (-1, 1):  # the first rank whose bin is k or more, as rounding has it
                while True:
                    move = (edge > 0) & (bin_of(edge - 1) >= k) if step < 0 else (edge < len(values)) & (bin_of(edge) < k)
                    if not move.any():
                        break
                    edge = edge + np.where(move, step, 0)
            upto = tree.less(low, high, edge)
        else:
            upto = n
        share = (upto - below) / n
        total -= np.where(share > 0, share * np.log2(np.where(share > 0, share, 1)), 0)
        below = upto
    out[at] = total
    return out


def windows(group: np.ndarray, start: np.ndarray, dst: np.ndarray, payload: np.ndarray, own: np.ndarray, seconds: float) -> np.ndarray:
    """The session columns of the ``own`` flows, each within its group; flows are in order of ``group`` and ``start``."""
    here, mine = start[own], group[own]
    # times by rank, so that group and time are one number and bounds are compared as they are
    times, rank = np.unique(np.concatenate([start, here - seconds, here + seconds]), return_inverse=True)
    at = lambda g, r: g * len(times) + r
    n, m = len(start), len(here)
    place = at(group, rank[:n])
    low, high = np.searchsorted(place, at(mine, rank[n : n + m])), np.searchsorted(place, at(mine, rank[n + m :]), side="right")
    n = high - low
    gaps = np.where(group[1:] == group[:-1], np.diff(start), 0.0)
    squares = np.concatenate([[0.0], np.cumsum(gaps * gaps)])
    steps = np.maximum(n - 1, 1)
    mean = (start[high - 1] - start[low]) / steps
    spread = np.maximum((squares[high - 1] - squares[low]) / steps - mean * mean, 0)
    # a destination counts at the first place of the window: where the same one before lies outside
    order = np.argsort(dst, kind="stable")
    same = np.concatenate([[False], dst[order][1:] == dst[order][:-1]])
    before = np.zeros(len(dst), np.int64)
    before[order] = np.where(same, np.concatenate([[0], order[:-1]]) + 1, 0)
    distinct = Ranks(before).less(low, high, low + 1)
    return np.stack([distinct, n, np.where(n > 1, mean, 0), np.where(n > 1, spread, 0), n / np.maximum(distinct, 1), _entropy(payload, low, high)])


def _swept(frame: pa.Table, seconds: float) -> pa.RecordBatch | None:
    part, bucket, start, dst, payload, own = (frame.column(c).to_numpy() for c in ("_part", "_bucket", "start", "dst", "payload", "own"))
    if not own.any():
        return None
    fresh = (part[1:] != part[:-1]) | (bucket[1:] != bucket[:-1])
    columns = windows(np.concatenate([[0], np.cumsum(fresh)]), start, dst, payload, own, seconds)
    ids = frame.column("row_id").filter(pa.array(own)).combine_chunks()
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in columns)], names=["row_id", *_ORDER])


def session_sweep(near: DataFrame, seconds: float) -> DataFrame:
    """row_id and the session columns of ``own`` flows, by ``_part`` and ``_bucket``, whose groups hold all flows within
    ``seconds`` of those. Many small groups are swept at once, a large one in whole. Destinations (``dst``) are 64-bit hashes."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part, bucket = batch.column("_part").to_numpy(), batch.column("_bucket").to_numpy()
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (bucket[1:] != bucket[:-1])) + 1
            if held and (held[-1].column("_part")[-1].as_py(), held[-1].column("_bucket")[-1].as_py()) != (part[0], bucket[0]):
                cuts = np.concatenate([[0], cuts])
            if len(cuts):  # all groups but the last are whole
                done = pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))])
                held = []
                if out := _swept(done, seconds):
                    yield out
                batch = batch.slice(int(cuts[-1]))
            held.append(batch)
        if held and (out := _swept(pa.Table.from_batches(held), seconds)):
            yield out

    ordered = near.repartition("_part", "_bucket").sortWithinPartitions("_part", "_bucket", "start")
    kind = dict(near.dtypes)["row_id"]
    return ordered.mapInArrow(run, f"row_id {kind}, " + ", ".join(f"{c} double" for c in _ORDER)).select("row_id", *SESSION)


_ORDER = ["src_unique_dst_count", "src_flow_count", "src_inter_flow_interval", "src_inter_flow_variance", "src_dst_flow_ratio", "src_payload_entropy"]
