"""Profiling and evaluation: distributions, describe, metrics, ROC, sweeps, drift. All are aggregates with map-side combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import clip


def cumulative(counts: DataFrame, keys: list[str], value: str, sums: list[str], parts: int = 64, descending: bool = False) -> DataFrame:
    """``counts`` (one row for each of ``keys`` and ``value``) with running sums of ``sums`` in the order of the value.

    A key's values are cut into ``parts`` ranges at approximate quantiles; a range is summed in one task, and starts from
    the sums of the ranges before it, so that no task holds all values of a key. The ends only share out the work:
    sums are exact wherever they lie."""
    number = F.col(value).cast("double")
    ends = counts.groupBy(*keys).agg(F.percentile_approx(number, [i / parts for i in range(1, parts)], 1_000).alias("_ends"))
    of = F.size(F.filter(F.coalesce("_ends", F.array().cast("array<double>")), lambda e: e < number))
    # ``ends`` has one row a key
    held = counts.join(F.broadcast(ends), keys) if keys else counts.crossJoin(F.broadcast(ends))
    held = held.withColumn("_part", of).drop("_ends")
    order = (lambda c: F.desc(c)) if descending else F.col
    totals = held.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_all_{c}") for c in sums])
    before = Window.partitionBy(*keys).orderBy(order("_part")).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_part", *[F.coalesce(F.sum(f"_all_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums])
    inside = Window.partitionBy(*keys, "_part").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = held.withColumns({f"running_{c}": F.sum(c).over(inside) for c in sums})
    # ``parts`` rows a key
    out = running.join(F.broadcast(starts), [*keys, "_part"])
    return out.withColumns({f"running_{c}": F.col(f"running_{c}") + F.col(f"_before_{c}") for c in sums}).drop("_part", *[f"_before_{c}" for c in sums])


def quantiles(long: DataFrame, shares: dict[str, float], key: str = "feature", value: str = "value") -> DataFrame:
    """Quantiles (linear between neighbours) of each key, exact, from counts of distinct values."""
    counts = long.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(key).agg(F.sum("n").alias("_n"))
    held = cumulative(counts, [key], value, ["n"]).join(F.broadcast(totals), key)  # one row a key

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("running_n") > rank, F.col(value)))

    place = lambda q: (F.col("_n") - 1) * q
    ends = held.groupBy(key, "_n").agg(*[at(F.floor(place(q))).alias(f"_low_{n}") for n, q in shares.items()], *[at(F.ceil(place(q))).alias(f"_high_{n}") for n, q in shares.items()])
    between = lambda n, q: F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * (place(q) - F.floor(place(q)))
    return ends.select(key, *[between(n, q).alias(n) for n, q in shares.items()])


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(F.col(label).cast("string").alias("value"), "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def value_counts(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std (sample), min, quartiles (linear) and max, one row a column."""
    long = df.unpivot([], columns, "feature", "value")
    plain = long.groupBy("feature").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    found = quantiles(long, {f"p{q}": q / 100 for q in (25, 50, 75)})
    return plain.join(F.broadcast(found), "feature", "left").select("feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max")  # one row a feature


def class_comparison(df: DataFrame, columns: list[str], label: Column) -> DataFrame:
    long = df.withColumn("_y", label).unpivot(["_y"], columns, "feature", "value")
    mean = lambda y: F.avg(F.when(F.col("_y") == y, F.col("value")))
    return long.groupBy("feature").agg(mean(0).alias("normal_mean"), mean(1).alias("attack_mean"), (mean(1) - mean(0)).alias("difference"))


def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])
    return one.unpivot(["_n"], columns, "column", "missing").where("missing > 0").select("column", "missing", (100.0 * F.col("missing") / F.col("_n")).alias("percent"))


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson coefficients of all pairs of a fixed list of columns, one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], [f"`{a}|{b}`" for a, b in pairs], "pair", "r")
    name = F.split("pair", r"\|")
    return long.select(name[0].alias("a"), name[1].alias("b"), "r")


def dataset_summary(df: DataFrame) -> DataFrame:
    kinds = df.groupBy("IT_M_Label").agg(F.count(F.lit(1)).alias("n"))
    labels = kinds.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("IT_M_Label", "n"))))).alias("labels"))
    return df.agg(F.count(F.lit(1)).alias("total"), F.sum("IT_B_Label").alias("attacks"), F.count_distinct("sIPs").alias("sources"), F.count_distinct("rIPs").alias("destinations")).crossJoin(labels)


def discriminability(df: DataFrame, columns: list[str], label: Column, k: int = 20) -> DataFrame:
    long = df.withColumn("_y", label).unpivot(["_y"], columns, "feature", "value")
    mean = lambda y: F.avg(F.when(F.col("_y") == y, F.col("value")))
    std = F.stddev_samp("value")
    return long.groupBy("feature").agg((F.abs(mean(1) - mean(0)) / F.when((std == 0) | std.isNull(), 1.0).otherwise(std)).alias("score")).orderBy(F.desc("score"), "feature").limit(k)


def feature_ratio(df: DataFrame, columns: list[str], label: Column) -> DataFrame:
    held = class_comparison(df, columns, label)
    ratio = F.col("attack_mean") / (F.col("normal_mean") + 1e-6)
    return held.select("feature", ratio.alias("ratio"), (F.abs(ratio - 1) > 0.3).alias("discriminative"))


def class_histogram(df: DataFrame, column: str, label: Column, bins: int = 50) -> DataFrame:
    ends = quantiles(df.select(F.lit(column).alias("feature"), F.col(column).alias("value")), {"low": 0.01, "high": 0.99}).drop("feature")
    held = df.select(label.alias("y"), F.col(column).alias("x")).where("x is not null").crossJoin(F.broadcast(ends))
    x = F.least(F.greatest("x", "low"), F.col("high"))
    index = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.floor((x - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1)))
    return held.groupBy("y", index.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    hit = lambda t, p: F.sum(F.when((F.col(truth) == t) & (F.col(predicted) == p), 1).otherwise(0))
    one = df.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fn"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    return one.select("tp", "fp", "tn", "fn", share("fp", "tn").alias("fpr"), share("fn", "tp").alias("fnr"))


def _ratios(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = zero(F.try_divide(tp, tp + fp)), zero(F.try_divide(tp, tp + fn))
    return p, r, zero(F.try_divide(2 * p * r, p + r))


def metrics(df: DataFrame, truth: str, predictions: list[str]) -> DataFrame:
    """Accuracy, precision, recall and F1 of several predictions, one pass."""
    long = df.unpivot([truth], predictions, "model", "pred")
    c = long.groupBy("model").agg(*[F.sum(F.when((F.col(truth) == t) & (F.col("pred") == p), 1).otherwise(0)).alias(n) for n, t, p in (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0))])
    p, r, f1 = _ratios(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("model", ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))).alias("accuracy"), p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    pairs = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    ours = pairs.select(F.explode(F.array_distinct(F.array(F.struct(F.col(truth).alias("class"), F.when(F.col(truth) == F.col(predicted), "tp").otherwise("fn").alias("kind")), F.struct(F.col(predicted).alias("class"), F.when(F.col(truth) == F.col(predicted), "tp").otherwise("fp").alias("kind"))))).alias("x"), "n")
    c = ours.groupBy("x.class").agg(*[F.sum(F.when(F.col("x.kind") == k, F.col("n")).otherwise(0)).alias(k) for k in ("tp", "fp", "fn")])
    p, r, f1 = _ratios(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("class", p.alias("precision"), r.alias("recall"), f1.alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def roc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Points by falling threshold: one row for each distinct score."""
    return _roc(df, truth, score).select("threshold", "tpr", "fpr")


def _roc(df: DataFrame, truth: str, score: str) -> DataFrame:
    counts = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(truth).alias("p"), F.sum(1 - F.col(truth)).alias("n"))
    total = counts.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    held = cumulative(counts, [], "threshold", ["p", "n"], descending=True).crossJoin(F.broadcast(total))
    return held.withColumns({"tpr": F.col("running_p") / F.col("all_p"), "fpr": F.col("running_n") / F.col("all_n"), "t0": (F.col("running_p") - F.col("p")) / F.col("all_p"), "f0": (F.col("running_n") - F.col("n")) / F.col("all_n")})


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area of the trapezia between a point and the one before, which is the point without its own rows."""
    return _roc(df, truth, score).agg(F.sum((F.col("fpr") - F.col("f0")) * (F.col("tpr") + F.col("t0")) / 2).alias("auc"))


def attack_recall(df: DataFrame, kind: str, predicted: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("total"), F.sum(predicted).alias("caught"), F.avg(predicted).alias("recall"))


def threshold_sweep(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Precision, recall, F1 and F2 at 0.20, 0.25, ..., 0.60 from counts of distinct scores."""
    few = df.groupBy(score, truth).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.createDataFrame([(round(0.2 + 0.05 * i, 2),) for i in range(9)], "threshold double")
    hit = F.col(score) >= F.col("threshold")
    c = few.crossJoin(F.broadcast(grid)).groupBy("threshold").agg(*[F.sum(F.when((F.col(truth) == t) & (hit == p), F.col("n")).otherwise(0)).alias(k) for k, t, p in (("tp", 1, True), ("fp", 0, True), ("fn", 1, False))])
    p, r, f1 = _ratios(F.col("tp"), F.col("fp"), F.col("fn"))
    f2 = F.coalesce(F.try_divide(5 * p * r, 4 * p + r), F.lit(0.0))
    return c.select("threshold", p.alias("precision"), r.alias("recall"), f1.alias("f1"), f2.alias("f2"))


def best_thresholds(sweep: DataFrame) -> DataFrame:
    best = lambda c, ok=None: F.max_by("threshold", F.struct(F.when(ok, F.col(c)) if ok is not None else F.col(c), -F.col("threshold")))
    return sweep.agg(best("f1").alias("best_f1"), best("f2").alias("best_f2"), best("f1", F.abs(F.col("precision") - F.col("recall")) < 0.10).alias("best_balanced"))


def model_comparison(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Metrics of two models side by side, difference and winner."""
    long = scores.unpivot(["model"], ["accuracy", "precision", "recall", "f1"], "metric", "value")
    c = long.groupBy("metric").agg(F.max(F.when(F.col("model") == a, F.col("value"))).alias("a"), F.max(F.when(F.col("model") == b, F.col("value"))).alias("b"))
    return c.select("metric", "a", "b", (F.col("a") - F.col("b")).alias("difference"), F.when(F.col("a") > F.col("b"), a).when(F.col("a") < F.col("b"), b).otherwise("tie").alias("winner"))


def metric_delta(base: DataFrame, variant: DataFrame) -> DataFrame:
    long = lambda m, n: m.unpivot([], ["precision", "recall", "f1"], "metric", n)
    return long(base, "baseline").join(long(variant, "variant"), "metric").withColumn("delta", F.col("variant") - F.col("baseline"))


def ks_drift(base: DataFrame, now: DataFrame, columns: list[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of each feature, from cumulative counts of distinct values."""
    side = lambda df, name: df.unpivot([], columns, "feature", "value").where("value is not null").withColumn("side", F.lit(name))
    counts = side(base, 0).unionByName(side(now, 1)).groupBy("feature", "value").agg(F.sum(1 - F.col("side")).alias("a"), F.sum("side").alias("b"))
    totals = counts.groupBy("feature").agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    held = cumulative(counts, ["feature"], "value", ["a", "b"]).join(F.broadcast(totals), "feature")  # one row a feature
    return held.groupBy("feature").agg(F.max(F.abs(F.col("running_a") / F.col("all_a") - F.col("running_b") / F.col("all_b"))).alias("ks"))


def clipped(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.withColumn(column, clip(F.col(column), low, high))


def ensemble_vote(df: DataFrame, votes: dict[str, float], threshold: float = 0.25) -> DataFrame:
    """Weighted sum of hard votes; weights are renormalised over the members given."""
    total = sum(votes.values())
    s = sum((F.col(c) * (w / total) for c, w in votes.items()), F.lit(0.0))
    return df.withColumn("ensemble_score", s).withColumn("prediction", F.when(F.col("ensemble_score") >= threshold, 1).otherwise(0)).withColumn("confidence", F.abs(F.col("ensemble_score") - 0.5) * 2)
