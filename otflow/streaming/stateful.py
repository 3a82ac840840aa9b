"""Stateful processors: chains, centred session windows and flows of live rows.

They use ``transformWithStateInPandas``, which needs the RocksDB state store
(``STATE_STORE`` as ``spark.sql.streaming.stateStore.providerClass``). Sessions and flows
wait for the watermark, so that rows are taken in order of time whatever the order
they come in, and results equal those of the batch operators. Rows behind the
watermark are dropped by Spark, which counts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalar import filled
from ..operators.features import SESSION
from ..operators.packets import FLAGS, keyed
from ..operators.sweep import windows

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rows(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    held = [f for f in frames if len(f)]
    return pd.concat(held, ignore_index=True) if held else pd.DataFrame()


class Previous(StatefulProcessor):
    """The state before each row of a source: one value a source, which goes ``ttl`` ms after the source's last row."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "state string", self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        frame = _rows(rows).sort_values(["ts", "row_id"], kind="stable")
        before = self.last.get()[0] if self.last.exists() else None
        states = frame["state"].tolist()
        self.last.update((states[-1],))
        yield pd.DataFrame({"row_id": frame["row_id"].to_numpy(), "src_ip": key[0], "prev": [before, *states[:-1]], "cur": states})

    def close(self) -> None:
        pass


class CentredWindow(StatefulProcessor):
    """Session columns of each flow of a source once the watermark has passed its window's end.

    State: the flows that a window still to come may hold, none older than two windows before the watermark."""

    def __init__(self, seconds: float):
        self.seconds, self.span = seconds, round(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flows = handle.getListState("flows", "row_id long, at long, dst long, payload double, waits boolean")

    def _next(self, held: pd.DataFrame) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        waiting = held.loc[held["waits"], "at"]
        if len(waiting):
            self.handle.registerTimer(int(-(-(waiting.min() + self.span) // 1000)))

    def handleInputRows(self, key, rows, timerValues):
        new = [(int(a), int(b), int(c), float(d), True) for a, b, c, d in _rows(rows)[["row_id", "at", "dst", "payload"]].itertuples(index=False)]
        for r in new:
            self.flows.appendValue(r)
        self._next(pd.DataFrame(list(self.flows.get()), columns=_HELD))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = pd.DataFrame(list(self.flows.get()), columns=_HELD).sort_values("at", kind="stable", ignore_index=True)
        closed = (held["waits"] & (held["at"] + self.span <= mark)).to_numpy(bool)
        if closed.any():
            found = windows(np.zeros(len(held), np.int64), held["at"].to_numpy(np.int64) / 1e6, held["dst"].to_numpy(np.int64), held["payload"].to_numpy(float), closed, self.seconds)
            yield pd.DataFrame({"row_id": held["row_id"].to_numpy()[closed], "sIPs": key[0]} | dict(zip(SESSION_ORDER, found, strict=True)))[["row_id", "sIPs", *SESSION]]
            held.loc[closed, "waits"] = False
        waiting = held.loc[held["waits"], "at"]
        held = held[held["at"] >= min(waiting.min() if len(waiting) else mark, mark) - self.span]
        if len(held):
            self.flows.put([(int(a), int(b), int(c), float(d), bool(e)) for a, b, c, d, e in held.itertuples(index=False)])
        else:
            self.flows.clear()
        self._next(held)

    def close(self) -> None:
        pass


_HELD = ["row_id", "at", "dst", "payload", "waits"]
SESSION_ORDER = ["src_unique_dst_count", "src_flow_count", "src_inter_flow_interval", "src_inter_flow_variance", "src_dst_flow_ratio", "src_payload_entropy"]

# a flow's state: what came from one of its ends, and all; parts in order of time merge to the whole
_END = {"packets": "long", "bytes": "long", "squares": "double", "least": "long", "most": "long", "ttl": "int", "win": "int"} | dict.fromkeys(FLAGS, "long")
_FLOW = {"head_a": "boolean", "start": "long", "end": "long", "gaps": "double", "gap_squares": "double", "closing": "boolean"} | {f"{e}_{n}": k for e in "ab" for n, k in _END.items()}
_SUMS = ("packets", "bytes", "squares", *FLAGS)
_PACKET = {"pkt_id": "long", "at": "long", "from_a": "boolean", "length": "int", "ttl": "int", "win": "int", "flags": "int"}
_OUT = "src_ip string, dst_ip string, src_port int, dst_port int, proto int, start double, end double, iat_mean double, iat_std double, size_mean double, size_std double"
_OUT += "".join(f", {w}_packets long, {w}_bytes long, {w}_size_min int, {w}_size_max int, {w}_size_avg double, {w}_size_std double, {w}_ttl int, {w}_win int" + "".join(f", {w}_{f} long" for f in FLAGS) for w in ("fwd", "bwd"))


def summed(packets: pd.DataFrame) -> dict:
    """State of consecutive packets of a flow, in order."""
    gaps = np.diff(packets["at"].to_numpy(np.int64)) / 1e6
    out = {"head_a": bool(packets["from_a"].iloc[0]), "start": int(packets["at"].iloc[0]), "end": int(packets["at"].iloc[-1]), "gaps": float(gaps.sum()), "gap_squares": float((gaps * gaps).sum()), "closing": bool((packets["flags"].to_numpy(np.int64) & (FLAGS["fin"] | FLAGS["rst"])).any())}
    for end, own in (("a", packets[packets["from_a"]]), ("b", packets[~packets["from_a"]])):
        size, flags = own["length"].to_numpy(np.int64), own["flags"].to_numpy(np.int64)
        values = {"packets": len(own), "bytes": int(size.sum()), "squares": float((size.astype(float) ** 2).sum())}
        values |= {"least": int(size.min()), "most": int(size.max()), "ttl": own["ttl"].iloc[0], "win": own["win"].iloc[0]} if len(own) else dict.fromkeys(("least", "most", "ttl", "win"))
        out |= {f"{end}_{n}": v for n, v in (values | {f: int((flags & bit > 0).sum()) for f, bit in FLAGS.items()}).items()}
    return out


def merged(first: dict, then: dict) -> dict:
    """The state of a flow whose packets of ``then`` follow those of ``first``."""
    gap = (then["start"] - first["end"]) / 1e6
    out = {"head_a": first["head_a"], "start": first["start"], "end": then["end"], "gaps": first["gaps"] + gap + then["gaps"], "gap_squares": first["gap_squares"] + gap * gap + then["gap_squares"], "closing": first["closing"] or then["closing"]}
    for e in "ab":
        out |= {f"{e}_{n}": first[f"{e}_{n}"] + then[f"{e}_{n}"] for n in _SUMS}
        for n, pick in (("least", min), ("most", max), ("ttl", lambda x: x[0]), ("win", lambda x: x[0])):
            both = [s[f"{e}_{n}"] for s in (first, then) if s[f"{e}_packets"]]
            out[f"{e}_{n}"] = pick(both) if both else None
    return out


def _deviation(n: int, total: float, squares: float) -> float | None:
    return float(np.sqrt(max(squares / n - (total / n) ** 2, 0))) if n else None


def finished(key: tuple, s: dict) -> dict:
    """A closed flow as a row of the batch operator."""
    (a_ip, a_port), (b_ip, b_port), proto = (key[0], key[1]), (key[2], key[3]), key[4]
    source, target = ((a_ip, a_port), (b_ip, b_port)) if s["head_a"] else ((b_ip, b_port), (a_ip, a_port))
    n = s["a_packets"] + s["b_packets"]
    total, squares = s["a_bytes"] + s["b_bytes"], s["a_squares"] + s["b_squares"]
    out = {"src_ip": source[0], "dst_ip": target[0], "src_port": source[1], "dst_port": target[1], "proto": proto, "start": s["start"] / 1e6, "end": s["end"] / 1e6}
    out |= {"iat_mean": s["gaps"] / (n - 1) if n > 1 else None, "iat_std": _deviation(n - 1, s["gaps"], s["gap_squares"]), "size_mean": total / n, "size_std": _deviation(n, total, squares)}
    for way, e in (("fwd", "a" if s["head_a"] else "b"), ("bwd", "b" if s["head_a"] else "a")):
        m, size = s[f"{e}_packets"], s[f"{e}_bytes"]
        out |= {f"{way}_packets": m, f"{way}_bytes": size, f"{way}_size_min": s[f"{e}_least"], f"{way}_size_max": s[f"{e}_most"], f"{way}_size_avg": size / m if m else None, f"{way}_size_std": _deviation(m, size, s[f"{e}_squares"]), f"{way}_ttl": s[f"{e}_ttl"], f"{way}_win": s[f"{e}_win"]}
        out |= {f"{way}_{f}": s[f"{e}_{f}"] for f in FLAGS}
    return out


class Flow(StatefulProcessor):
    """A flow between two ends. It ends ``idle`` seconds after its last packet, or ``linger`` seconds after it if one had FIN or RST.

    State: the packets that the watermark hasn't passed, and the sums of those before."""

    def __init__(self, idle: float, linger: float):
        self.idle, self.linger = round(idle * 1_000_000), round(linger * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{n} {k}" for n, k in _PACKET.items()))
        self.flow = handle.getValueState("flow", ", ".join(f"{n} {k}" for n, k in _FLOW.items()))

    def _ends(self, flow: dict) -> int:
        return flow["end"] + (self.linger if flow["closing"] else self.idle)

    def _next(self, flow: dict | None, waiting: pd.DataFrame) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        at = ([int(waiting["at"].min())] if len(waiting) else []) + ([self._ends(flow) + 1] if flow else [])
        if at:
            self.handle.registerTimer(-(-min(at) // 1000))

    def _state(self) -> tuple[dict | None, pd.DataFrame]:
        flow = dict(zip(_FLOW, self.flow.get(), strict=True)) if self.flow.exists() else None
        return flow, pd.DataFrame(list(self.waiting.get()), columns=list(_PACKET))

    def handleInputRows(self, key, rows, timerValues):
        for r in _rows(rows)[list(_PACKET)].itertuples(index=False):
            self.waiting.appendValue(tuple(None if pd.isna(x) else bool(x) if n == "from_a" else int(x) for n, x in zip(_PACKET, r, strict=True)))
        self._next(*self._state())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        flow, waiting = self._state()
        waiting = waiting.sort_values(["at", "pkt_id"], kind="stable", ignore_index=True)
        passed = int((waiting["at"] <= mark).sum())
        done, first = [], 0
        flags, at = waiting["flags"].fillna(0).to_numpy(np.int64), waiting["at"].to_numpy(np.int64)
        while first < passed:
            if flow and at[first] > self._ends(flow):
                done.append(flow)
                flow = None
            # on to the next gap that ends the flow; FIN or RST shortens what it takes
            closing = np.logical_or.accumulate(np.concatenate([[bool(flow and flow["closing"])], flags[first:passed] & (FLAGS["fin"] | FLAGS["rst"]) > 0]))[1:]
            over = np.flatnonzero(np.diff(at[first:passed]) > np.where(closing[:-1], self.linger, self.idle))
            last = first + int(over[0]) + 1 if len(over) else passed
            part = summed(waiting.iloc[first:last])
            flow = merged(flow, part) if flow else part
            first = last
        if flow and self._ends(flow) < mark:
            done.append(flow)
            flow = None
        rest = waiting.iloc[passed:]
        if flow:
            self.flow.update(tuple(None if flow[n] is None or pd.isna(flow[n]) else {"long": int, "int": int, "double": float, "boolean": bool}[k](flow[n]) for n, k in _FLOW.items()))
        else:
            self.flow.clear()
        if len(rest):
            self.waiting.put([tuple(None if pd.isna(x) else bool(x) if n == "from_a" else int(x) for n, x in zip(_PACKET, r, strict=True)) for r in rest.itertuples(index=False)])
        else:
            self.waiting.clear()
        self._next(flow, rest)
        if done:
            out = pd.DataFrame([finished(key, f) for f in done])
            yield out.astype({c.split()[0]: "Int64" if c.split()[1] == "long" else "Int32" for c in _OUT.split(", ") if c.split()[1] in ("long", "int")})

    def close(self) -> None:
        pass


def previous_stream(flows: DataFrame, ttl_seconds: float = 3600) -> DataFrame:
    """row_id, src_ip, prev, cur for flows with ``state``; each batch in order of ts."""
    held = flows.select("src_ip", "row_id", "ts", "state")
    return held.groupBy("src_ip").transformWithStateInPandas(Previous(round(ttl_seconds * 1000)), "row_id long, src_ip string, prev string, cur string", "append", "ProcessingTime")


def centred_stream(flows: DataFrame, seconds: float, watermark: str) -> DataFrame:
    """row_id, sIPs and the session columns of flows with event time ``ts``, once each window is whole."""
    payload = filled("sPayloadAvg") if "sPayloadAvg" in flows.columns else F.lit(0.0)
    held = flows.select(F.coalesce("sIPs", F.lit("unknown")).alias("sIPs"), "row_id", "ts", F.unix_micros("ts").alias("at"), F.xxhash64(F.coalesce("rIPs", F.lit("unknown"))).alias("dst"), payload.alias("payload"))
    schema = "row_id long, sIPs string, " + ", ".join(f"{c} double" for c in SESSION)
    return held.withWatermark("ts", watermark).groupBy("sIPs").transformWithStateInPandas(CentredWindow(seconds), schema, "append", "EventTime")


def flow_stream(packets: DataFrame, idle: float, linger: float, watermark: str) -> DataFrame:
    """Closed flows, as the batch operator has them, of packets with event time ``ts``."""
    ends = keyed(packets)
    held = ends.select(F.col("end_a.ip").alias("a_ip"), F.col("end_a.port").alias("a_port"), F.col("end_b.ip").alias("b_ip"), F.col("end_b.port").alias("b_port"), "proto", "ts", "pkt_id", F.unix_micros("ts").alias("at"), (F.col("own_end") == F.col("end_a")).alias("from_a"), F.coalesce("length", F.lit(0)).alias("length"), "ttl", F.col("tcp_window").alias("win"), F.coalesce("tcp_flags", F.lit(0)).alias("flags"))
    return held.withWatermark("ts", watermark).groupBy("a_ip", "a_port", "b_ip", "b_port", "proto").transformWithStateInPandas(Flow(idle, linger), _OUT, "append", "EventTime")
