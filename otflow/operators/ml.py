"""Models: scaling, isolation forest, boosted trees, random forest, ensemble, explanation.

The forest is a custom estimator: trees grow in parallel on small hash samples
and are scored from flat arrays of a fixed size (trees x nodes). Rows between the
same cuts of every tree are one cell (:class:`Cells`): they have the same path in
each tree, so a cell is scored and explained once, and its rows are joined with
the result. Supervised trees grow from counts of bins (:mod:`.trees`). Everything
else is column arithmetic.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import SLICE_ROWS
from .profile import cumulative, ensemble_vote, metrics
from .trees import Trees, cells, fit_boosted, fit_forest, prepared

WEIGHTS = {"iso": 0.40, "xgb": 0.35, "rf": 0.25}
#: Codes of a group of leaves that share a table, and cells explained at once.
CODES, CELLS = 512, 100_000


def scale_parameters(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, std) with the population deviation; 0 counts as 1."""
    each = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c)).alias("std")) for c in columns]
    return df.agg(F.array(*each).alias("each")).select(F.inline("each"))


def scale(df: DataFrame, parameters: DataFrame, keep: tuple = ("row_id",)) -> DataFrame:
    """z-scores; the parameters are one row a feature of the plan."""
    p = {r["feature"]: (r["mean"], r["std"]) for r in parameters.collect()}
    return df.select(*keep, *[((F.col(c) - m) / s).alias(c) for c, (m, s) in p.items()])


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a tree of n points."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes (feature, cut, left, right, size) of one tree; leaves have feature -1."""
    depth = int(np.ceil(np.log2(max(2, len(x)))))
    nodes: list = [None]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, d = todo.pop()
        own = x[rows]
        wide = np.flatnonzero(own.max(axis=0) > own.min(axis=0)) if len(rows) > 1 else []
        if d >= depth or not len(wide):
            nodes[at] = (-1, 0.0, -1, -1, len(rows))
            continue
        f = int(rng.choice(wide))
        cut = float(rng.uniform(own[:, f].min(), own[:, f].max()))
        left = own[:, f] < cut
        nodes[at] = (f, cut, len(nodes), len(nodes) + 1, len(rows))
        nodes += [None, None]
        todo += [(nodes[at][2], rows[left], d + 1), (nodes[at][3], rows[~left], d + 1)]
    return nodes


class Cells:
    """Places between the cuts of a forest: for each feature how many of its cuts are at most a row's value, packed into
    whole numbers. All rows of a cell go the same way at every cut."""

    def __init__(self, trees: list, n_features: int):
        self.cuts = [np.unique([cut for tree in trees for feature, cut, *_ in tree if feature == f]) for f in range(n_features)]
        self.at, word, used = [], 0, 0
        for c in self.cuts:
            bits = max(1, len(c).bit_length())
            word, used = (word + 1, 0) if used + bits > 62 else (word, used)
            self.at.append((word, used, (1 << bits) - 1))
            used += bits
        self.names = [f"_cell{w}" for w in range(word + 1)]

    def pack(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.names), len(x)), np.int64)
        for f, (word, shift, _) in enumerate(self.at):
            out[word] |= np.searchsorted(self.cuts[f], x[:, f], side="right").astype(np.int64) << shift
        return out

    def values(self, words: list) -> np.ndarray:
        """A row of each cell: the cuts below it."""
        return np.column_stack([np.concatenate([[-np.inf], self.cuts[f]])[(np.asarray(words[word]) >> shift) & mask] for f, (word, shift, mask) in enumerate(self.at)])


def _walk(tree: tuple) -> tuple:
    """A tree for rows that all take as many steps: feature, cut, each node's next by (2 node + left), a leaf's being itself,
    path length at a leaf, and steps."""
    feature, cut, left, right, size = tree
    inner, depth = feature >= 0, np.zeros(len(feature), int)
    for i in np.flatnonzero(inner):  # parents come first
        depth[[left[i], right[i]]] = depth[i] + 1
    own = np.arange(len(feature))
    next_ = np.column_stack([np.where(inner, right, own), np.where(inner, left, own)]).ravel()
    return np.maximum(feature, 0), cut.astype(float), next_, depth + np.array([expected_path(s) for s in size]), int(depth.max())


@dataclass
class IsolationForest:
    features: list[str]
    trees: list
    psi: int
    threshold: float = 0.0

    def arrays(self) -> list[tuple]:
        return [tuple(np.array(c) for c in zip(*t, strict=True)) for t in self.trees]

    def placed(self, df: DataFrame, cells: Cells) -> DataFrame:
        """``df`` with the numbers of each row's cell."""
        held = df.sparkSession.sparkContext.broadcast(cells)  # at most trees x psi cuts

        @F.pandas_udf(", ".join(f"{n} long" for n in cells.names))
        def place(*columns: pd.Series) -> pd.DataFrame:
            x = np.column_stack([c.to_numpy(dtype=float, na_value=0.0) for c in columns])
            return pd.DataFrame(dict(zip(held.value.names, held.value.pack(x), strict=True)))

        at = df.withColumn("_cell", place(*[F.col(c) for c in self.features]))
        return at.select(*df.columns, *[F.col(f"_cell.{n}") for n in cells.names])

    def scored(self, each: DataFrame, cells: Cells) -> DataFrame:
        """Cells with ``iso_score``."""
        held = each.sparkSession.sparkContext.broadcast((cells, [_walk(tree) for tree in self.arrays()]))  # at most trees x 2 psi nodes
        base, n = expected_path(self.psi), len(self.trees)

        @F.pandas_udf("double")
        def path(*words: pd.Series) -> pd.Series:
            cells, trees = held.value
            x = np.ascontiguousarray(cells.values(list(words)).T)
            total, flat, own = np.zeros(x.shape[1]), x.ravel(), np.arange(x.shape[1])
            for feature, cut, next_, length, depth in trees:
                at, place = np.zeros(len(own), np.int64), feature * len(own)
                for _ in range(depth):
                    left = flat.take(place.take(at) + own) < cut.take(at)
                    at <<= 1
                    at += left
                    at = next_.take(at)
                total += length.take(at)
            return pd.Series(-(2.0 ** (-(total / n) / max(base, 1e-9))))

        return each.withColumn("iso_score", path(*[F.col(c) for c in cells.names]))

    def by_cell(self, df: DataFrame, found) -> DataFrame:
        """``df`` with the columns that ``found`` (of the table of cells, and :class:`Cells`) adds to each cell."""
        cells = Cells(self.trees, len(self.features))
        rows = self.placed(df, cells)
        return rows.join(found(rows.select(*cells.names).distinct(), cells), cells.names).drop(*cells.names)

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``iso_score`` (-2 ** (-mean path / expected path)) and ``iso`` (1: below the threshold)."""
        return self.by_cell(df, self.scored).withColumn("iso", F.when(F.col("iso_score") < self.threshold, 1).otherwise(0))

    def quantile(self, df: DataFrame, share: float) -> float:
        """The least score that at least ``share`` of the rows do not exceed, from counts of distinct scores."""
        cells = Cells(self.trees, len(self.features))
        counted = self.placed(df, cells).groupBy(*cells.names).agg(F.count(F.lit(1)).alias("n"))
        counts = self.scored(counted, cells).groupBy("iso_score").agg(F.sum("n").alias("n")).persist()
        total = counts.agg(F.sum("n")).first()[0] or 0
        found = cumulative(counts, [], "iso_score", ["n"]).where(F.col("running_n") >= share * total).agg(F.min("iso_score")).first()[0]
        counts.unpersist()
        return found or 0.0

    def save(self, df_session, path: str) -> None:
        data = [(json.dumps({"features": self.features, "psi": self.psi, "threshold": self.threshold, "trees": self.trees}),)]
        df_session.createDataFrame(data, "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark, path: str) -> IsolationForest:
        return IsolationForest(**json.loads(spark.read.text(path).first()["value"]))


def fit_isolation_forest(df: DataFrame, features: list[str], trees: int = 200, psi: int = 256, contamination: float = 0.1, seed: int = 42) -> IsolationForest:
    """Each row joins few trees by hash; a tree grows on its ``psi`` rows of smallest hash."""
    n = df.count()
    per_row = max(1, int(np.ceil(2.0 * trees * psi / max(1, n))))
    share = min(1.0, 2.0 * trees * psi / max(1, n * per_row))
    drawn = df.select("row_id", *features).withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(min(per_row, trees)))))
    h = F.xxhash64(F.lit(seed), "row_id", "_c")
    drawn = drawn.withColumn("_h", h).where((F.pmod("_h", F.lit(1 << 20)) / (1 << 20)) < share)
    drawn = drawn.withColumn("tree", F.pmod(F.pmod(F.shiftright("_h", 24), F.lit(trees)) + F.col("_c"), F.lit(trees)).cast("int"))
    few = drawn.withColumn("_r", F.row_number().over(Window.partitionBy("tree").orderBy("_h", "row_id"))).where(F.col("_r") <= psi)

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        tree = int(frame["tree"].iloc[0])
        nodes = _grow(frame[features].to_numpy(dtype=float), np.random.default_rng([seed, tree]))
        return pd.DataFrame({"tree": [tree], "nodes": [json.dumps(nodes)]})

    grown = few.select("tree", *features).groupBy("tree").applyInPandas(grow, "tree int, nodes string").orderBy("tree").collect()
    model = IsolationForest(features, [json.loads(r["nodes"]) for r in grown], min(psi, n))
    model.threshold = model.quantile(df, contamination)
    return model


def dealt(df: DataFrame, features: list[str], label: str, rows: int = SLICE_ROWS) -> DataFrame:
    """Label and features, where needed dealt anew over parts of at most about ``rows`` rows, for learners that hold a part in a
    task (those of :mod:`.trees` don't). Parts are sorted, so that draws of rows can be repeated."""
    held = df.select(label, *features)
    have, want = held.rdd.getNumPartitions(), -(-held.count() // rows)
    return held if have >= want else held.repartition(want).sortWithinPartitions(label, *features)


@dataclass
class Ensemble:
    features: list[str]
    parameters: DataFrame
    forest: IsolationForest
    boosted: Trees | None = None
    trees: Trees | None = None

    def save(self, path: str) -> None:
        """Scaler, forest and the members that are there, each under ``path``; what was there before is replaced."""
        spark = self.parameters.sparkSession
        self.parameters.coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")  # one row a feature
        self.forest.save(spark, f"{path}/forest")
        have = [n for n in ("boosted", "trees") if getattr(self, n) is not None]
        for name in have:
            getattr(self, name).save(spark, f"{path}/{name}")
        spark.createDataFrame([(json.dumps({"features": self.features, "members": have}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/ensemble")

    @staticmethod
    def load(spark, path: str) -> Ensemble:
        held = json.loads(spark.read.text(f"{path}/ensemble").first()["value"])
        members = {n: Trees.load(spark, f"{path}/{n}") for n in held["members"]}
        return Ensemble(held["features"], spark.read.parquet(f"{path}/scaler"), IsolationForest.load(spark, f"{path}/forest"), **members)

    def weights(self) -> dict[str, float]:
        have = {"iso": True, "xgb": self.boosted is not None, "rf": self.trees is not None}
        total = sum(WEIGHTS[k] for k, v in have.items() if v)
        return {k: WEIGHTS[k] / total for k, v in have.items() if v}

    def predict(self, df: DataFrame, keep: tuple = ("row_id",)) -> DataFrame:
        """Votes, probabilities and score of each row; ``agree`` where all members vote alike."""
        scaled = scale(df, self.parameters, keep)
        out = self.forest.score(scaled)
        names = ["iso"]
        for name, model in (("xgb", self.boosted), ("rf", self.trees)):
            if model is not None:
                out = model.transform(out, scaled).withColumn(name, F.col(name).cast("int"))
                names.append(name)
        agree = F.size(F.array_distinct(F.array(*names))) == 1
        return ensemble_vote(out, self.weights()).withColumn("agree", agree)


def fit_ensemble(df: DataFrame, features: list[str], label: str = "label", keep: tuple = ("row_id",), forest: dict | None = None, boosted: dict | None = None, trees: dict | None = None) -> Ensemble:
    """All members on scaled features; without two classes only the isolation forest."""
    parameters = scale_parameters(df, features)
    scaled = scale(df, parameters, (*keep, *([label] if label in df.columns else [])))
    model = Ensemble(features, parameters, fit_isolation_forest(scaled, features, **(forest or {})))
    if label in df.columns and df.agg(F.count_distinct(label).alias("n")).first()["n"] > 1:
        held = cells(*prepared(scaled, features, label))
        model.boosted, model.trees = fit_boosted(scaled, features, label, held=held, **(boosted or {})), fit_forest(scaled, features, label, held=held, **(trees or {}))
    return model


def importance(model: Trees, features: list[str], df: DataFrame, k: int = 15) -> DataFrame:
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, model.importances(), strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(k)


def _paths(tree: tuple) -> list[tuple[float, list[tuple[int, float, list[tuple[int, bool]]]]]]:
    """Leaves of a tree: path length, and for each feature on the way its share of the training rows and its turns (node, left)."""
    feature, _, left, right, size = tree
    out, todo = [], [(0, 0, {})]
    while todo:
        at, depth, way = todo.pop()
        if feature[at] < 0:
            out.append((depth + expected_path(size[at]), [(f, z, turns) for f, (z, turns) in way.items()]))
            continue
        for child, goes_left in ((left[at], True), (right[at], False)):
            z, turns = way.get(feature[at], (1.0, []))
            todo.append((child, depth + 1, way | {feature[at]: (z * size[child] / max(size[at], 1), [*turns, (at, goes_left)])}))
    return out


def path_contributions(trees: list, x: np.ndarray) -> np.ndarray:
    """Shapley values of the mean path length, by row and feature, where an unknown feature's turns are taken by shares of
    the training rows.

    A leaf's part of a coalition's value is a product over the features on its way: whether the row goes that way (o) for
    known ones, the share (z) for others. A feature's Shapley value is then (o - z) times the integral over t in [0, 1] of
    the product of z (1 - t) + o t over the others, a polynomial that Gauss-Legendre nodes integrate exactly."""
    out = np.zeros(x.shape)
    for tree in trees:
        cuts = [np.unique(tree[1][tree[0] == f]) for f in range(x.shape[1])]
        at = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]
        for digits, table in _tables(tree, cuts):
            code = sum(digit[at[f]] for f, digit in digits.items())
            if digits:
                out += table[code]
    return out / max(len(trees), 1)


def _tables(tree: tuple, cuts: list):
    """Groups of leaves with the sum of their values: for each feature a digit by the number of cuts passed, and a table by
    the sum of the digits. Between the ends of its leaves' ranges a feature changes nothing, so that few codes tell all rows."""
    index = [{v: k for k, v in enumerate(c.tolist())} for c in cuts]
    group, ends = [], {}
    for length, way in _paths(tree):
        ranged, more = [], {}
        for f, z, turns in way:
            at = [(index[f][float(tree[1][node])], goes_left) for node, goes_left in turns]
            low = max((k + 1 for k, goes_left in at if not goes_left), default=0)
            high = min((k for k, goes_left in at if goes_left), default=len(cuts[f]))
            ranged.append((f, z, low, high))
            more[f] = ends.get(f, set()) | ({low, high + 1} - {0, len(cuts[f]) + 1})
        size = np.prod([float(len(e) + 1) for e in (ends | more).values()])
        if group and size > CODES:
            yield _table(group, ends, cuts)
            group, ends, more = [], {}, {f: {low, high + 1} - {0, len(cuts[f]) + 1} for f, _, low, high in ranged}
        group.append((length, ranged))
        ends |= more
    yield _table(group, ends, cuts)


def _table(group: list, ends: dict, cuts: list) -> tuple[dict, np.ndarray]:
    digits, first, size = {}, {}, 1
    for f, e in ends.items():
        starts = np.array([0, *sorted(e)])
        digits[f] = (np.searchsorted(starts, np.arange(len(cuts[f]) + 1), side="right") - 1) * size
        first[f] = (starts, size)
        size *= len(starts)
    codes, table = np.arange(size), np.zeros((size, len(cuts)))
    place = {f: starts[codes // step % len(starts)] for f, (starts, step) in first.items()}
    for length, ranged in group:
        if ranged:
            pattern = sum(((place[f] >= low) & (place[f] <= high)).astype(np.int64) << j for j, (f, _, low, high) in enumerate(ranged))
            table[:, [f for f, *_ in ranged]] += _leaf_values(np.array([z for _, z, _, _ in ranged]), length)[pattern]
    return digits, table


@lru_cache
def _nodes(n: int) -> tuple[np.ndarray, np.ndarray]:
    t, weight = np.polynomial.legendre.leggauss(n)
    return (t + 1) / 2, weight / 2


def _leaf_values(z: np.ndarray, length: float) -> np.ndarray:
    """Shapley values of a leaf's features for all patterns of taken ones, by pattern and feature."""
    m = len(z)
    takes = np.arange(1 << m)[:, None] >> np.arange(m) & 1
    t, weight = _nodes(m // 2 + 1)
    factors = z[:, None] * (1 - t) + takes[:, :, None] * t  # pattern, feature, node
    ones = np.ones_like(factors[:, :1])
    before = np.cumprod(np.concatenate([ones, factors[:, :-1]], axis=1), axis=1)
    after = np.cumprod(np.concatenate([ones, factors[:, :0:-1]], axis=1), axis=1)[:, ::-1]
    return length * (takes - z) * (before * after @ weight)


def _explained(model: IsolationForest):
    """Adds ``contributions`` to cells."""
    trees, base = model.arrays(), max(expected_path(model.psi), 1e-9)

    def of(each: DataFrame, cells: Cells) -> DataFrame:
        held = each.sparkSession.sparkContext.broadcast((cells, trees))
        names = each.columns

        def explained(frame: pd.DataFrame) -> pd.DataFrame:
            cells, trees = held.value
            x = cells.values([frame[n].to_numpy() for n in cells.names])
            return frame.assign(contributions=list(path_contributions(trees, x) / base))

        def run(frames):
            waiting = []
            for frame in frames:
                waiting.append(frame)
                if sum(map(len, waiting)) >= CELLS:
                    yield explained(pd.concat(waiting))
                    waiting = []
            if waiting:
                yield explained(pd.concat(waiting))

        kinds = dict(each.dtypes)
        return each.mapInPandas(run, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", contributions array<double>")

    return of


def contributions(model: IsolationForest, df: DataFrame) -> DataFrame:
    """``df`` with ``contributions``: for each feature of the forest, its part of the row's mean path length, in units of
    the expected one. They add up to the path less its mean over the training rows; below 0 is toward anomaly."""
    return model.by_cell(df, _explained(model))


def _ranked(model: IsolationForest, top: int):
    """Adds ``_top`` to cells: their ``top`` features by magnitude, ranked."""

    def of(each: DataFrame, cells: Cells) -> DataFrame:
        named = F.transform("contributions", lambda c, j: F.struct((-F.abs(c)).alias("size"), F.get(F.array(*[F.lit(n) for n in model.features]), j).alias("feature"), c.alias("contribution")))
        total = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + F.abs(c))
        held = _explained(model)(each, cells).select(*each.columns, total.alias("_total"), F.slice(F.array_sort(named), 1, top).alias("_top"))
        share = lambda x: F.coalesce(100 * F.try_divide(F.abs(x), F.col("_total")), F.lit(0.0))
        toward = lambda x: F.when(x < 0, "toward anomaly").otherwise("toward normal")
        one = lambda x, j: F.struct(x["feature"], x["contribution"], share(x["contribution"]).alias("percent"), (j + 1).alias("rank"), toward(x["contribution"]).alias("direction"))
        return held.select(*each.columns, F.transform("_top", one).alias("_top"))

    return of


def explain(model: IsolationForest, rows: DataFrame, top: int = 5, keep: tuple = ("row_id",)) -> DataFrame:
    """The ``top`` features of each row by magnitude: feature, contribution, percent, rank and direction. Ranked by cell."""
    return model.by_cell(rows.select(*keep, *[c for c in model.features if c not in keep]), _ranked(model, top)).select(*keep, F.inline("_top"))


def global_attribution(contributions: DataFrame, by: tuple = ()) -> DataFrame:
    """Mean magnitude of each feature, for each class with ``by``; the contributions must not be cut to the top ones."""
    return contributions.groupBy("feature", *by).agg(F.avg(F.abs("contribution")).alias("mean_abs"))


def attribution(model: IsolationForest, df: DataFrame, by: tuple = ()) -> DataFrame:
    """As :func:`global_attribution` of all features of all rows, from the rows of each cell and class: rows aren't expanded."""
    cells = Cells(model.trees, len(model.features))
    counted = model.placed(df, cells).groupBy(*cells.names, *by).agg(F.count(F.lit(1)).alias("_n"))
    found = _explained(model)(counted, cells).select(*by, "_n", F.posexplode("contributions").alias("_at", "_one"))
    sums = found.groupBy("_at", *by).agg((F.sum(F.abs("_one") * F.col("_n")) / F.sum("_n")).alias("mean_abs"))
    return sums.select(F.get(F.array(*[F.lit(n) for n in model.features]), F.col("_at")).alias("feature"), *by, "mean_abs")


def true_positives(predictions: DataFrame, label: str = "label", n: int = 5) -> DataFrame:
    """row_id and confidence of the first ``n`` true positives."""
    return predictions.where((F.col(label) == 1) & (F.col("prediction") == 1)).orderBy("row_id").limit(n).select("row_id", "confidence")


def audit_report(predictions: DataFrame, model: Ensemble, scaled: DataFrame, label: str = "label", n: int = 5, top: int = 10) -> DataFrame:
    """First true positives with confidence and contributions; ``row_id`` must tell rows apart."""
    hit = true_positives(predictions, label, n)
    rows = scaled.join(F.broadcast(hit.select("row_id")), "row_id", "left_semi")
    return explain(model.forest, rows, top).join(F.broadcast(hit), "row_id")


def evaluate(predictions: DataFrame, label: str = "label") -> DataFrame:
    names = [c for c in ("iso", "xgb", "rf", "prediction") if c in predictions.columns]
    return metrics(predictions, label, names)


def ablation(df: DataFrame, base: list[str], more: list[str], label: str = "label", trees: int = 20, depth: int = 5) -> DataFrame:
    """The same forest on two feature sets: metrics and their difference."""
    train, test = df.where("not is_test"), df.where("is_test")
    found = []
    for name, features in (("baseline", base), ("variant", base + more)):
        out = fit_forest(train, features, label, trees, depth).transform(test).withColumn("rf", F.col("rf").cast("int"))
        found.append(metrics(out, label, ["rf"]).unpivot([], ["precision", "recall", "f1"], "metric", name))
    return found[0].join(found[1], "metric").withColumn("delta", F.col("variant") - F.col("baseline"))


def score_requests(model: Ensemble, features: DataFrame) -> DataFrame:
    """Valid requests scored, with the signed score, severity of their zone and the action. ``features`` has each request
    as the struct ``request``, which passes through the model, so that nothing is joined back on a key."""
    from ..functions.scalar import recommended_action, zone_of_port, zone_severity
    from .enrich import validate

    scored = model.predict(features, ("request",)).select("request.*", "ensemble_score", "prediction", "confidence")
    held = validate(scored).where("valid")
    signed: Column = F.when(F.col("prediction") == 1, F.col("confidence")).otherwise(-F.col("confidence"))
    held = held.withColumn("signed_score", signed).withColumns({"zone": zone_of_port(F.col("dst_port")), "zone_severity": zone_severity(F.col("dst_port"), F.col("signed_score"))})
    return held.withColumn("action", recommended_action(F.col("zone_severity"), F.col("prediction") == 1))
