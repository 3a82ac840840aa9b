"""Random forests and boosted trees, grown from counts of bins.

Features are cut at quantiles into at most ``BINS`` bins. Rows of the same bins and label are one cell with their count
(:func:`cells`): a draw of its rows is one of their sum's distribution. Cells are one byte a feature and label; they are
written once, ``ROWS`` packed together with a number that their draws come from (one by one, handing them to Python costs
more than counting them).

A forest's upper levels are passes over the cells, of all trees at once: a task adds up rows and labels by node, feature
and bin, tasks by node pick each node's cut, and only cuts reach the driver. At most ``NODES`` nodes are counted in a pass,
so that a task holds arrays of a fixed size, whatever the rows. A node of at most ``LOCAL`` cells has them sent to a task
that grows all below it. Boosting has few nodes a level: tasks' counts are added up, a level a job, over cells held in
memory (or on disk) with what the trees so far give them.

Labels are 0 and 1. Missing values lie behind all cuts.
"""

from __future__ import annotations

import base64
import io
import json
import zlib
from dataclasses import dataclass, field
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import written

BINS, NODES, ROWS = 32, 4096, 1 << 15
#: Cells of a node from which all below it grows in one task, cells that a task deals out to nodes at once, bytes dealt to a part.
LOCAL, DEALT, PART = 1 << 17, 1 << 19, 1 << 25
#: Features packed into a whole number, 5 bits each; the first has the label above them.
PER, LABEL = 12, 60
#: Boosting: after how many rounds cells are written anew with what the trees so far give them, and from how many parts
#: their counts aren't added up by the driver alone.
ROUNDS, PARTS = 50, 64
#: Draws of boosting start here, so that they aren't those of a forest on the same rows.
OTHER = 1 << 20
#: Values of a Poisson(1) variable by 16 bits.
POISSON = np.searchsorted(np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 12)])) * (1 << 16), np.arange(1 << 16) + 0.5).astype(np.uint8)
BINNED = "x binary, y binary, n binary, draw long, f binary"


def quantile_cuts(df: DataFrame, features: list[str], grid: int = 500) -> list[np.ndarray]:
    """Cuts of each feature: all values of a fine grid of quantiles where there are few, else evenly many of them."""
    shares = F.array(*[F.lit(k / grid) for k in range(grid)])
    plain = [F.when(~F.isnan(c), F.col(c)) for c in features]
    found = df.select(*[F.col(c).cast("double") for c in features]).agg(*[F.percentile_approx(x, shares, 2 * grid).alias(c) for c, x in zip(features, plain, strict=True)]).first()
    out = []
    for values in found:
        values = np.array(values or [], float)
        held = np.unique(values)
        out.append(held if len(held) < BINS else np.unique(values[[grid * k // (BINS - 1) for k in range(BINS - 1)]]))
    return out


def bins_of(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """(rows, features): how many cuts are below each value."""
    return np.column_stack([np.searchsorted(c, x[:, f], side="left").astype(np.uint8) for f, c in enumerate(cuts)])


def _floats(columns) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])


def _packed(x: np.ndarray, y: np.ndarray, n: np.ndarray, number: int, score: np.ndarray) -> pa.RecordBatch:
    each = (x.tobytes(), pa.binary()), (y.astype(np.uint8).tobytes(), pa.binary()), (n.astype(np.int64).tobytes(), pa.binary()), (number, pa.int64()), (score.tobytes(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in each], names=["x", "y", "n", "draw", "f"])


def _opened(x, y, n, number, score, width: int) -> tuple:
    """Bins (features, cells), labels, rows, number and scores (none at first) of the cells packed together."""
    return np.frombuffer(x, np.uint8).reshape(width, -1), np.frombuffer(y, np.uint8).astype(float), np.frombuffer(n, np.int64), number, np.frombuffer(score)


def _unpacked(batches, width: int):
    for batch in batches:
        for x, y, n, number, score in zip(*[batch.column(k) for k in range(3)], batch.column(3).to_pylist(), batch.column(4), strict=True):
            yield _opened(x.as_buffer(), y.as_buffer(), n.as_buffer(), number, score.as_buffer(), width)


def _number(seed: int, packs: int) -> int:
    return int(np.random.default_rng([seed, TaskContext.get().partitionId(), packs]).integers(1 << 62))


def binned(df: DataFrame, features: list[str], label: str, cuts: list[np.ndarray], seed: int) -> DataFrame:
    """Rows of bins and labels, packed."""

    def run(batches):
        held, n, packs = [], 0, 0

        def pack():
            table = pa.Table.from_batches(held)
            return _packed(np.ascontiguousarray(bins_of(_floats(table.columns[1:]), cuts).T), _floats(table.columns[:1])[:, 0], np.ones(n), _number(seed, packs), np.zeros(0))

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                yield pack()
                held, n, packs = [], 0, packs + 1
        if n:
            yield pack()

    rows = df.select(F.col(label).cast("double").alias("y"), *[F.col(c).cast("double") for c in features])
    tasks = df.sparkSession.sparkContext.defaultParallelism
    rows = rows if 2 * df.rdd.getNumPartitions() > tasks else rows.repartition(tasks)
    return rows.mapInArrow(run, BINNED)


def words_of(x: np.ndarray) -> list[np.ndarray]:
    """Bins (features, rows) as whole numbers of ``PER`` features each."""
    return [sum(x[f].astype(np.int64) << 5 * (f - k) for f in range(k, min(k + PER, len(x)))) for k in range(0, len(x), PER)]


def bins_in(words: list, width: int) -> np.ndarray:
    return np.stack([(np.asarray(words[f // PER]) >> 5 * (f % PER) & BINS - 1).astype(np.uint8) for f in range(width)])


def _word_names(width: int) -> list[str]:
    return [f"_word{k}" for k in range(-(-width // PER))]


def cells(cuts: list[np.ndarray], rows: DataFrame, seed: int = 42) -> tuple[list, DataFrame]:
    """Cuts and written cells of the rows that :func:`prepared` gave: each once, with the count of its rows."""
    width, names = len(cuts), _word_names(len(cuts))

    def counted(packs):
        words = words_of(np.concatenate([x for x, *_ in packs], axis=1))
        words[0] |= np.concatenate([y for _, y, *_ in packs]).astype(np.int64) << LABEL
        order = np.lexsort(words)
        words = [w[order] for w in words]
        first = np.flatnonzero(np.concatenate([[True], np.any([w[1:] != w[:-1] for w in words], axis=0)]))
        n = np.diff([*first, len(order)])
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (*[w[first] for w in words], n)], names=[*names, "n"])

    def keyed(batches):
        held, many = [], 0
        for pack in _unpacked(batches, width):
            held.append(pack)
            many += len(pack[1])
            if many >= 2 * DEALT:
                yield counted(held)
                held, many = [], 0
        if held:
            yield counted(held)

    def run(batches):
        packs, held = 0, []

        def pack(table):
            words = [c.to_numpy() for c in table.columns[:-1]]
            return _packed(bins_in(words, width), words[0] >> LABEL, table.columns[-1].to_numpy(), _number(seed, packs), np.zeros(0))

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= ROWS:
                table = pa.Table.from_batches(held)
                yield pack(table[:ROWS])
                held, packs = table[ROWS:].to_batches(), packs + 1
        if any(b.num_rows for b in held):
            yield pack(pa.Table.from_batches(held))

    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    longs = ", ".join(f"{n} long" for n in names)
    keys = rows.mapInArrow(keyed, f"{longs}, n long").repartition(tasks, *names)
    return cuts, written(keys.groupBy(*names).agg(F.sum("n").alias("n")).sortWithinPartitions(*names).mapInArrow(run, BINNED))


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def draws(number: int, n: int, t: int) -> np.ndarray:
    """16 bits for each of ``n`` rows packed together, and tree."""
    z = _mixed(np.arange(n, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64((number + 0x9E3779B97F4A7C15 * (t // 4 + 1)) % (1 << 64)))
    return ((z >> np.uint64(16 * (t % 4))) & np.uint64(0xFFFF)).astype(np.int64)


def times(n: np.ndarray, number: int, t: int) -> np.ndarray:
    """How often a tree of a forest sees the rows of cells of ``n`` rows: a Poisson(1) draw for each row."""
    out = POISSON.take(draws(number, len(n), t)).astype(np.int64)
    more = np.flatnonzero(n > 1)
    out[more] = np.random.default_rng([number, t]).poisson(n[more])
    return out


def chosen(n: np.ndarray, number: int, t: int, share: float) -> np.ndarray:
    """How many rows of cells of ``n`` rows a round of boosting sees: each with probability ``share``."""
    out = (draws(number, len(n), OTHER + t) < share * (1 << 16)).astype(np.int64)
    more = np.flatnonzero(n > 1)
    out[more] = np.random.default_rng([number, OTHER + t]).binomial(n[more], share)
    return out


def subsets_of(seed: int, t: np.ndarray, node: np.ndarray, width: int, size: int) -> np.ndarray:
    """``size`` features of each node, drawn by tree and node, in order."""
    own = _mixed((np.asarray(t, np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)) + np.asarray(node, np.uint64) * np.uint64(0xD1342543DE82EF95)
    z = _mixed(_mixed(own)[:, None] + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.sort(np.argsort(z, axis=1)[:, :size], axis=1)


def _descend(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row ``depth`` levels below the root; what reaches a leaf goes on to its left."""
    n = x.shape[1]
    at, flat, own = np.zeros(n, np.int64), x.ravel(), np.arange(n)
    place = np.maximum(feature, 0).astype(np.int64) * n
    for _ in range(depth):
        right = flat.take(place.take(at) + own) > cut.take(at)
        at <<= 1
        at += 1
        at += right
    return at


@dataclass
class Trees:
    """Trees as heaps: node i has the children 2 i + 1 and 2 i + 2; leaves have feature -1, and hand their value on."""

    features: list[str]
    name: str
    cuts: list
    depth: int
    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    value: list = field(default_factory=list)
    weight: list = field(default_factory=list)
    gains: list = field(default_factory=list)

    def sums(self, x: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """Weighted sums of the trees from ``first`` to before ``last``."""
        out = np.zeros(x.shape[1])
        for t in range(first, len(self.feature) if last is None else last):
            out += self.weight[t] * self.value[t].take(_descend(x, self.feature[t], self.cut[t], self.depth))
        return out

    def transform(self, df: DataFrame, source: DataFrame | None = None) -> DataFrame:
        """``df`` with the class (``name``) and its probability (``name_p``). Rows of the same bins are scored once. ``source``:
        what ``df`` was made from, with the same rows of features."""
        sc, width, names = df.sparkSession.sparkContext, len(self.features), _word_names(len(self.features))
        edges, held = [np.asarray(c) for c in self.cuts], sc.broadcast(self)  # at most trees x nodes

        @F.pandas_udf(", ".join(f"{n} long" for n in names))
        def place(*columns: pd.Series) -> pd.DataFrame:
            x = bins_of(np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns]), edges)
            return pd.DataFrame(dict(zip(names, words_of(x.T), strict=True)))

        @F.pandas_udf("double")
        def probability(*words: pd.Series) -> pd.Series:
            model = held.value
            s = model.sums(bins_in(words, width))
            return pd.Series(s if model.name == "rf" else 1 / (1 + np.exp(-2 * s)))

        p = f"{self.name}_p"
        word = place(*[F.col(c).cast("double") for c in self.features])
        rows = df.withColumn("_word", word).select(*df.columns, *[F.col(f"_word.{n}") for n in names])
        found = (df if source is None else source).select(word.alias("_word")).select("_word.*").distinct().withColumn(p, probability(*names))
        return rows.join(found, names).drop(*names).withColumn(self.name, (F.col(p) > 0.5).cast("double"))

    def importances(self) -> np.ndarray:
        """Gains by feature, each tree's adding up to one, averaged and made to add up to one."""
        each = [np.array(g) / sum(g) for g in self.gains if sum(g) > 0]
        total = np.sum(each, axis=0) if each else np.zeros(len(self.features))
        return total / max(total.sum(), 1e-300)

    def save(self, spark, path: str) -> None:
        data = {k: [np.asarray(x).tolist() for x in v] if k in ("cuts", "gains") else v for k, v in vars(self).items() if k not in ("feature", "cut", "value")}
        np.savez_compressed(held := io.BytesIO(), **{k: np.array(getattr(self, k)) for k in ("feature", "cut", "value")})
        data["arrays"] = base64.b64encode(held.getvalue()).decode()
        spark.createDataFrame([(json.dumps(data),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark, path: str) -> Trees:
        data = json.loads(spark.read.text(path).first()["value"])
        with np.load(io.BytesIO(base64.b64decode(data.pop("arrays")))) as held:
            arrays = {k: list(held[k]) for k in held.files}
        return Trees(**data | arrays)


def _planted(model: Trees, trees: int, kind=float) -> None:
    """Adds ``trees`` leaves, as wide as trees of the model's depth."""
    size = (2 << model.depth) - 1
    for _ in range(trees):
        model.feature.append(np.full(size, -1, np.int16))
        model.cut.append(np.full(size, BINS, np.uint8))
        model.value.append(np.zeros(size, kind))
        model.gains.append([0.0] * len(model.features))


def _below(node: int, depth: int):
    """First and last (exclusive) node of each level from ``node`` down to ``depth``."""
    low, high = node, node + 1
    while low < (2 << depth) - 1:
        yield low, high
        low, high = 2 * low + 1, 2 * high + 1


def _divided(model: Trees, t: int, node: int, feature: int, cut: int, gain: float, left: float, right: float) -> None:
    """A cut of ``node``, whose children have the values ``left`` and ``right``."""
    model.feature[t][node], model.cut[t][node] = feature, cut
    model.gains[t][feature] += gain
    for child, value in ((2 * node + 1, left), (2 * node + 2, right)):
        for low, high in _below(child, model.depth):
            model.value[t][low:high] = value


def _sums(x: np.ndarray, rows: np.ndarray, slot: np.ndarray, many: int, subsets: np.ndarray, columns: list) -> np.ndarray:
    """(nodes, features, bins, columns): sums of ``columns`` (none: counts) over ``rows`` by their node (``slot``)."""
    s, n, flat = subsets.shape[1], x.shape[1], x.ravel()
    keys = np.concatenate([(slot * s + k) * BINS + flat.take(subsets[:, k].take(slot) * n + rows) for k in range(s)])
    return np.stack([np.bincount(keys, None if c is None else np.tile(c, s), many * s * BINS) for c in columns], axis=-1).reshape(many, s, BINS, -1)


def _best(each: np.ndarray, subsets: np.ndarray) -> tuple:
    """Best cut of each node, from its sums (rows, labels and others): feature, cut, gain, sums of all and of the left."""
    total = each[:, 0].sum(axis=1)
    left = np.cumsum(each, axis=2)[:, :, :-1]
    right = total[:, None, None, :2] - left[..., :2]
    fair = (left[..., 0] > 0.5) & (right[..., 0] > 0.5)  # whole numbers
    gain = left[..., 1] ** 2 / np.maximum(left[..., 0], 1) + right[..., 1] ** 2 / np.maximum(right[..., 0], 1) - (total[:, 1] ** 2 / np.maximum(total[:, 0], 1))[:, None, None]
    gain = np.where(fair, gain, -1.0).reshape(len(each), -1)
    at, own = gain.argmax(axis=1), np.arange(len(each))
    k, cut = np.divmod(at, BINS - 1)
    return subsets[own, k], cut, gain[own, at], total, left[own, k, cut]


def _counted(held, width: int, depth: int, trees: list, slots: list, subsets: np.ndarray):
    """Arrow rows (slot; rows, labels and cells by feature and bin) of a task."""
    s = subsets.shape[1]

    def run(batches):
        upper, total = held.value, np.zeros((len(subsets), s, BINS, 3))
        for x, y, n, number, _ in _unpacked(batches, width):
            for t, aims in zip(trees, slots, strict=True):
                own = aims[aims >= 0]
                low, many = int(own[0]), len(own)
                weight = times(n, number, t)
                at = _descend(x, *upper[t], depth) - ((1 << depth) - 1) if depth else np.zeros(len(y), np.int64)
                slot = aims.take(at)
                rows = np.flatnonzero((slot >= 0) & (weight > 0))
                slot, weight = slot[rows] - low, weight[rows]
                total[low : low + many] += _sums(x, rows, slot, many, subsets[low : low + many], [weight, weight * y[rows], None])
        some = np.flatnonzero(total[..., 0].any(axis=(1, 2)))
        for k in range(0, len(some), 512):
            part = some[k : k + 512]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([total[i].tobytes() for i in part], pa.binary())], names=["slot", "sums"])

    return run


def _picked(subsets: np.ndarray):
    """Best cut of each slot, from the sums of all tasks."""

    def run(batches):
        held: dict = {}
        for batch in batches:
            for slot, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(sums.as_buffer())
                held[slot] = held[slot] + own if slot in held else own
        if held:
            slots = np.array(list(held), np.int32)
            feature, cut, gain, total, left = _best(np.stack(list(held.values())).reshape(len(held), subsets.shape[1], BINS, 3), subsets[slots])
            kinds = [pa.int32()] * 3 + [pa.float64()] * 7
            found = (slots, feature, cut, gain, *total.T, *left.T)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(found, kinds, strict=True)], names=["slot", "feature", "cut", "gain", "n", "s", "cells", "left_n", "left_s", "left_cells"])

    return run


def _grown_above(rows: DataFrame, model: Trees, subset: int, seed: int) -> tuple[int, dict]:
    """Grows nodes of more than ``LOCAL`` cells, level by level. Levels grown, and by tree the nodes to grow on from."""
    spark, width, trees = rows.sparkSession, len(model.features), range(len(model.feature))
    tasks = spark.sparkContext.defaultParallelism
    every = rows.agg(F.sum(F.length("y"))).first()[0] or 0
    wide, rest = {t: [0] for t in trees if every > LOCAL}, {t: [0] if 0 < every <= LOCAL else [] for t in trees}
    depth = 0
    while depth < model.depth and any(wide.values()):
        todo, after = [(t, node) for t in wide for node in wide[t]], {t: [] for t in wide}
        for k in range(0, len(todo), NODES):
            some = todo[k : k + NODES]
            subsets = subsets_of(seed, *np.array(some).T, width, subset)
            slots: dict = {}
            for slot, (t, node) in enumerate(some):
                slots.setdefault(t, np.full(1 << depth, -1))[node - (1 << depth) + 1] = slot
            held = spark.sparkContext.broadcast({t: (model.feature[t][: (1 << depth) - 1], model.cut[t][: (1 << depth) - 1]) for t in slots})
            found = rows.mapInArrow(_counted(held, width, depth, list(slots), list(slots.values()), subsets), "slot int, sums binary")
            found = found.repartition(tasks, "slot").mapInArrow(_picked(subsets), "slot int, feature int, cut int, gain double, n double, s double, cells double, left_n double, left_s double, left_cells double")
            for r in found.collect():  # at most NODES
                t, node = some[r["slot"]]
                if depth == 0:
                    model.value[t][:] = r["s"] / r["n"]
                if r["gain"] <= 1e-9 * max(1.0, r["n"]):
                    continue
                _divided(model, t, node, r["feature"], r["cut"], r["gain"], r["left_s"] / r["left_n"], (r["s"] - r["left_s"]) / (r["n"] - r["left_n"]))
                for child, many in ((2 * node + 1, r["left_cells"]), (2 * node + 2, r["cells"] - r["left_cells"])):
                    (after if many > LOCAL else rest)[t].append(child)
            held.destroy()
        wide, depth = {t: sorted(a) for t, a in after.items() if a}, depth + 1
    rest = {t: [node for node in nodes if node == 0 or (node + 1).bit_length() <= model.depth] for t, nodes in rest.items()}
    return depth, {t: nodes for t, nodes in rest.items() if nodes}


def _dealt_out(held, width: int, depth: int):
    """Arrow rows (tree, node, its cells) of a task's cells, for the nodes that trees grow on from."""
    upper, aims = held

    def dealt(packs):
        x, y = np.concatenate([p[0] for p in packs], axis=1), np.concatenate([p[1] for p in packs]).astype(np.uint8)
        for t, (feature, cut) in upper.value.items():
            node = aims.value[t].take(_descend(x, feature, cut, depth) - ((1 << depth) - 1) if depth else np.zeros(len(y), np.int64))
            weight = np.concatenate([times(n, number, t) for _, _, n, number, _ in packs])
            rows = np.flatnonzero((node >= 0) & (weight > 0))
            if not len(rows):
                continue
            rows = rows[np.argsort(node[rows], kind="stable")]
            node, weight = node[rows], weight[rows].astype(np.min_scalar_type(int(weight.max())))
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            each = [slice(a, b) for a, b in zip(first, [*first[1:], len(rows)], strict=True)]
            kinds = [np.full(len(each), t, np.int32), node[first].astype(np.int32), *[pa.array([v.tobytes() for v in part], pa.binary()) for part in ([x[:, rows[a]] for a in each], [weight[a] for a in each], [y[rows[a]] for a in each])]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in kinds], names=["tree", "node", "x", "n", "y"])

    def run(batches):
        waiting, many = [], 0
        for pack in _unpacked(batches, width):
            waiting.append(pack)
            many += len(pack[1])
            if many >= DEALT:
                yield from dealt(waiting)
                waiting, many = [], 0
        if waiting:
            yield from dealt(waiting)

    return run


def _subtree(x: np.ndarray, weight: np.ndarray, y: np.ndarray, t: int, node: int, depth: int, subset: int, seed: int) -> tuple:
    """All that grows below ``node``: features, cuts and values as a heap, and gains by feature."""
    width, n = x.shape
    levels = depth + 1 - (node + 1).bit_length()
    size = (2 << levels) - 1
    feature, cut, value, gains = np.full(size, -1, np.int16), np.full(size, BINS, np.uint8), np.zeros(size), np.zeros(width)
    target, rows, slot, todo = weight * y, np.arange(n), np.zeros(n, np.int64), np.zeros(1, np.int64)
    value[0] = target.sum() / weight.sum()
    for level in range(levels):
        subsets = subsets_of(seed, np.full(len(todo), t), (node << level) + todo, width, subset)  # numbers in the whole tree
        best, edge, gain, total, left = _best(_sums(x, rows, slot, len(todo), subsets, [weight[rows], target[rows]]), subsets)
        split = gain > 1e-9 * np.maximum(1.0, total[:, 0])
        own, children = todo[split], np.flatnonzero(split)
        if not len(own):
            break
        feature[own], cut[own] = best[split], edge[split]
        gains += np.bincount(best[split], gain[split], width)
        value[2 * own + 1] = left[split, 1] / left[split, 0]
        value[2 * own + 2] = (total[split, 1] - left[split, 1]) / (total[split, 0] - left[split, 0])
        next_ = np.full(len(todo), -1)
        next_[children] = 2 * np.arange(len(own))
        rows, slot = rows[split[slot]], slot[split[slot]]
        slot = next_[slot] + (x.ravel().take(best[slot] * n + rows) > edge[slot])
        todo = np.column_stack([2 * own + 1, 2 * own + 2]).ravel()
    for level in range(levels):
        leaf = np.arange((1 << level) - 1, (2 << level) - 1)
        leaf = leaf[feature[leaf] < 0]
        value[2 * leaf + 1] = value[2 * leaf + 2] = value[leaf]
    return feature, cut, value, gains


def _grown_below(width: int, depth: int, subset: int, seed: int):
    """Arrow rows (tree, node, what grows below it) from the cells dealt out, sorted by tree and node."""

    def grown(key, parts):
        many = [len(y) for *_, y in parts]
        x = np.concatenate([np.frombuffer(x, np.uint8).reshape(width, -1) for x, _, _ in parts], axis=1)
        weight = np.concatenate([np.frombuffer(w, f"u{len(w) // m}").astype(float) for (_, w, _), m in zip(parts, many, strict=True)])
        y = np.concatenate([np.frombuffer(y, np.uint8) for *_, y in parts])
        feature, cut, value, gains = _subtree(x, weight, y, *key, depth, subset, seed)
        packed = zlib.compress(feature.tobytes() + cut.tobytes() + value.astype(np.float32).tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([packed], pa.binary()), pa.array([gains.tolist()])], names=["tree", "node", "below", "gains"])

    def run(batches):
        key, parts = None, []
        for batch in batches:
            for t, node, *part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *[batch.column(k) for k in (2, 3, 4)], strict=True):
                if (t, node) != key and parts:
                    yield grown(key, parts)
                    parts = []
                key = (t, node)
                parts.append([v.as_buffer() for v in part])
        if parts:
            yield grown(key, parts)

    return run


def _grow(rows: DataFrame, model: Trees, subset: int, seed: int) -> None:
    """Grows the trees of a forest."""
    sc, width = rows.sparkSession.sparkContext, len(model.features)
    depth, rest = _grown_above(rows, model, subset, seed)
    aims = {}
    for t, nodes in rest.items():
        aims[t] = np.full(1 << depth, -1)
        for node in nodes:
            *_, (low, _) = _below(node, depth)
            aims[t][low - (1 << depth) + 1] = node  # the leftmost below it
    if not aims:
        return
    size = (1 << depth) - 1
    held = sc.broadcast({t: (model.feature[t][:size], model.cut[t][:size]) for t in aims}), sc.broadcast(aims)
    every = rows.agg(F.sum(F.length("y"))).first()[0]
    parts = max(sc.defaultParallelism, len(aims) * every * (width + 2) // PART)
    cells = rows.mapInArrow(_dealt_out(held, width, depth), "tree int, node int, x binary, n binary, y binary").repartition(parts, "tree", "node").sortWithinPartitions("tree", "node")
    for r in cells.mapInArrow(_grown_below(width, model.depth, subset, seed), "tree int, node int, below binary, gains array<double>").collect():  # trees x nodes
        t, node, data = r["tree"], r["node"], zlib.decompress(r["below"])
        n = len(data) // 7
        own = np.frombuffer(data, np.int16, n), np.frombuffer(data, np.uint8, n, 2 * n), np.frombuffer(data[3 * n :], np.float32)
        for level, (low, high) in enumerate(_below(node, model.depth)):
            for array, part in zip((model.feature[t], model.cut[t], model.value[t]), own, strict=True):
                array[low:high] = part[(1 << level) - 1 : (2 << level) - 1]
        model.gains[t] = [a + b for a, b in zip(model.gains[t], r["gains"], strict=True)]
    for h in held:
        h.destroy()


def prepared(df: DataFrame, features: list[str], label: str = "label", seed: int = 42) -> tuple[list, DataFrame]:
    """Cuts and rows of bins."""
    cuts = quantile_cuts(df, features)
    return cuts, binned(df, features, label, cuts, seed)


def fit_forest(df: DataFrame, features: list[str], label: str = "label", trees: int = 200, depth: int = 15, seed: int = 42, held: tuple | None = None) -> Trees:
    """Each tree sees a row as often as a Poisson(1) draw, and each node the square root of the features. ``held``: what
    :func:`cells` gave for ``df``, which several models may share."""
    cuts, rows = held or cells(*prepared(df, features, label, seed))
    model = Trees(features, "rf", cuts, depth, weight=[1 / trees] * trees)
    _planted(model, trees, np.float32)
    _grow(rows, model, int(np.ceil(np.sqrt(len(features)))), seed)
    return model


def _turned(t: int, share: float, tree: tuple | None):
    """Cells of a round: what the tree before it gives is added to scores, rows are drawn, and the slopes of the loss added up
    over those drawn (in the first round labels as signs)."""

    def run(part):
        for x, y, n, number, score, *_ in part:
            sign = 2.0 * y - 1
            if tree is not None:
                step, value, feature, cut, depth = tree
                score = score + step * value.take(_descend(x, feature, cut, depth))
                sign = 4 * sign / (1 + np.exp(2 * sign * score))
            weight = chosen(n, number, t, share)
            yield x, y, n, number, score, weight.astype(np.min_scalar_type(int(weight.max(initial=0)))), weight * sign

    return run


def _slopes(feature: np.ndarray, cut: np.ndarray, depth: int, slots: np.ndarray, many: int):
    """Sums of a task over the ``many`` nodes of a level: rows drawn and slopes, by feature and bin."""

    def run(part):
        total = 0.0
        for x, *_, weight, target in part:
            drawn, size = weight.astype(float), (many + 1) * BINS  # the last are rows that reached a leaf
            slot = slots.take(_descend(x, feature, cut, depth) - ((1 << depth) - 1)) * BINS
            sums = [np.bincount(slot + bins, column, size).reshape(many + 1, BINS) for bins in x for column in (drawn, target)]
            total = total + np.stack(sums, axis=1)[:many].reshape(many, len(x), 2, BINS)
        yield total

    return run


def _held(rows: DataFrame, width: int) -> RDD:
    """Bins, labels, rows, number and scores of cells packed together."""

    def run(part):
        for r in part:
            x, y, n, number, score = _opened(*r, width)
            yield x, y.astype(np.uint8), n.astype(np.min_scalar_type(int(n.max()))), number, score if len(score) else np.zeros(len(y))

    return rows.rdd.mapPartitions(run)


def _saved(packs: RDD, spark) -> DataFrame:
    """Written: what the scores come from is no longer needed."""
    return written(spark.createDataFrame(packs.map(lambda p: (p[0].tobytes(), p[1].tobytes(), p[2].astype(np.int64).tobytes(), p[3], p[4].tobytes())), BINNED))


def fit_boosted(df: DataFrame, features: list[str], label: str = "label", rounds: int = 200, depth: int = 6, step: float = 0.1, share: float = 0.8, seed: int = 42, held: tuple | None = None) -> Trees:
    """Trees of the slopes of the logistic loss; a round sees ``share`` of the rows, a node ``share`` of the features.
    ``held``: what :func:`cells` gave for ``df``, which several models may share."""
    cuts, rows = held or cells(*prepared(df, features, label, seed))
    model, width = Trees(features, "xgb", cuts, depth), len(features)
    spark, packs, last = rows.sparkSession, _held(rows, width), None
    for t in range(rounds):
        if t and t % ROUNDS == 0:
            packs = _held(_saved(packs, spark), width)
        packs = packs.mapPartitions(_turned(t, share, None if t == 0 else (model.weight[-1], model.value[-1], model.feature[-1], model.cut[-1], depth))).persist(StorageLevel.MEMORY_AND_DISK)
        model.weight.append(1.0 if t == 0 else step)
        _planted(model, 1)
        nodes = np.zeros(1, np.int64)
        for level in range(depth):
            slots = np.full(1 << level, len(nodes))
            slots[nodes - (1 << level) + 1] = np.arange(len(nodes))
            subsets = subsets_of(seed, np.full(len(nodes), OTHER + t), nodes, width, int(np.ceil(share * width)))
            each = packs.mapPartitions(_slopes(model.feature[t], model.cut[t], level, slots, len(nodes)))
            each = sum(each.collect()) if each.getNumPartitions() <= PARTS else each.treeReduce(add)
            each = np.moveaxis(each, 2, 3)[np.arange(len(nodes))[:, None], subsets]
            feature, cut, gain, total, left = _best(each, subsets)
            if level == 0:
                model.value[t][:] = total[0, 1] / max(total[0, 0], 1.0)
            split = np.flatnonzero(gain > 1e-9 * np.maximum(1.0, total[:, 0]))
            for k in split.tolist():
                _divided(model, t, int(nodes[k]), int(feature[k]), int(cut[k]), float(gain[k]), left[k, 1] / left[k, 0], (total[k, 1] - left[k, 1]) / (total[k, 0] - left[k, 0]))
            if last is not None:
                last.unpersist()
                last = None
            nodes = np.column_stack([2 * nodes[split] + 1, 2 * nodes[split] + 2]).ravel()
            if not len(nodes):
                break
        last = packs
    if last is not None:
        last.unpersist()
    return model
