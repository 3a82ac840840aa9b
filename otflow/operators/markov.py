"""Markov-chain sequence anomalies: states, fit, probability, score, flag and summary.

Chains are sparse tables: transitions (chain, prev, cur, n), exits (chain, prev,
n) and sizes (chain, k). The chain ``*`` is global and follows the input order
whatever the source. Heavy sources, and the table as a whole, are cut into slices of
about ``SLICE_ROWS`` rows in time order, each led in by the row before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import sigmoid
from .ordered import SLICE_ROWS, numeric, placed, sliced

GLOBAL, ALPHA, LEAST_FLOWS = "*", 0.1, 5


def first_of(df: DataFrame, names: list[str], default=None) -> Column:
    held = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*held, F.lit(default)) if held else F.lit(default)


def state_of(df: DataFrame) -> Column:
    src, dst = first_of(df, ["src_port", "sport"], 0), first_of(df, ["dst_port", "dport"], 0)
    proto = F.lower(first_of(df, ["protocol", "proto"], "tcp").cast("string"))
    kind = F.when(F.contains(proto, F.lit("tcp")), "tcp").when(F.contains(proto, F.lit("udp")), "udp").otherwise("other")
    port = F.when(dst.isin(502, 20000, 44818, 2404), dst.cast("string")).otherwise("other")
    fc = first_of(df, ["modbus_function_code", "fc"], 0)
    return F.concat_ws("|", F.when(src >= 49152, "ephemeral").otherwise("well-known"), port, kind, fc.cast("int").cast("string"))


def with_state(df: DataFrame) -> DataFrame:
    return df.withColumn("state", state_of(df))


def _stepped(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """With the state before, in (ts, row_id) order."""
    cut = sliced(df.withColumn("_at", placed(F.col("ts"))), keys, "_at", numeric(df, "row_id"), rows)
    led = cut.led(["ts", "row_id"], 1).withColumn("prev", F.lag("state").over(cut.window("ts", "row_id")))
    return led.where(~F.col("_copy")).drop("_at", "_slice", "_copy")


def with_previous(df: DataFrame, rows: int = SLICE_ROWS) -> DataFrame:
    return _stepped(df, ["src_ip"], rows)


def global_transitions(df: DataFrame, rows: int = SLICE_ROWS) -> DataFrame:
    """(prev, cur) of consecutive rows of the whole table in (ts, row_id) order."""
    return _stepped(df.select("ts", "row_id", "state"), [], rows).where("prev is not null").select("prev", F.col("state").alias("cur"))


def fit(df: DataFrame) -> dict[str, DataFrame]:
    """Transitions, exits and sizes of the global chain and of each source with enough rows. No rows are an error."""
    held = with_state(df)
    if held.isEmpty():
        raise ValueError("a chain needs at least one row")
    own = with_previous(held)
    enough = held.groupBy("src_ip").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("state").alias("k")).where(F.col("rows") >= LEAST_FLOWS)
    each = own.where("prev is not null").join(enough.select("src_ip"), "src_ip", "left_semi").groupBy(F.col("src_ip").alias("chain"), "prev", F.col("state").alias("cur")).agg(F.count(F.lit(1)).alias("n"))
    whole = global_transitions(held).groupBy(F.lit(GLOBAL).alias("chain"), "prev", "cur").agg(F.count(F.lit(1)).alias("n"))
    transitions = whole.unionByName(each)
    sizes = held.select(F.lit(GLOBAL).alias("chain"), "state").distinct().groupBy("chain").agg(F.count(F.lit(1)).alias("k")).unionByName(enough.select(F.col("src_ip").alias("chain"), "k"))
    states = held.select(F.lit(GLOBAL).alias("chain"), "state").unionByName(held.join(enough.select("src_ip"), "src_ip", "left_semi").select(F.col("src_ip").alias("chain"), "state")).distinct()
    return {"transitions": transitions, "exits": transitions.groupBy("chain", "prev").agg(F.sum("n").alias("out")), "sizes": sizes, "states": states}


def probabilities(rows: DataFrame, model: dict[str, DataFrame], alpha: float = ALPHA) -> DataFrame:
    """``rows`` (with chain, prev, cur) with ``p``: smoothed where both states are known to the chain, 1 / (k + 1) else."""
    states = model["states"]
    known = lambda c: states.select(F.col("chain"), F.col("state").alias(c), F.lit(True).alias(f"{c}_known"))
    held = rows.join(model["transitions"], ["chain", "prev", "cur"], "left").join(model["exits"], ["chain", "prev"], "left").join(model["sizes"], "chain", "left").join(known("prev"), ["chain", "prev"], "left").join(known("cur"), ["chain", "cur"], "left")
    both = F.col("prev_known").isNotNull() & F.col("cur_known").isNotNull()
    p = F.when(both, (F.coalesce("n", F.lit(0)) + alpha) / (F.coalesce("out", F.lit(0)) + alpha * F.col("k"))).otherwise(1 / (F.col("k") + 1))
    return held.withColumn("p", p).drop("n", "out", "k", "prev_known", "cur_known")


def scored(steps: DataFrame, model: dict[str, DataFrame], alpha: float = ALPHA) -> DataFrame:
    """``steps`` (with src_ip, prev and cur) with chain, p and transition_anomaly_score, by the source's own chain where it has one; also for streams."""
    own = model["sizes"].where(F.col("chain") != GLOBAL).select(F.col("chain").alias("own"))
    held = steps.join(own, F.col("src_ip") == F.col("own"), "left").withColumn("chain", F.coalesce("own", F.lit(GLOBAL))).drop("own")
    out = probabilities(held, model, alpha)
    return out.withColumn("transition_anomaly_score", F.when(F.col("prev").isNull(), 0.0).otherwise(sigmoid(-F.ln("p"))))


def score(df: DataFrame, model: dict[str, DataFrame]) -> DataFrame:
    """``df`` with prev, p and transition_anomaly_score; the first row of a source scores 0."""
    if not model:
        raise ValueError("fit a model first")
    return scored(with_previous(with_state(df)).withColumnRenamed("state", "cur"), model)


def flag(df: DataFrame, model: dict[str, DataFrame], threshold: float = 0.5) -> DataFrame:
    return score(df, model).withColumn("markov_anomaly", F.col("transition_anomaly_score") >= threshold)


def summary(flagged: DataFrame) -> DataFrame:
    """One row: detected, n_anomalous, fraction, severity and confidence."""
    hit = F.col("markov_anomaly")
    one = flagged.agg(F.count(F.lit(1)).alias("total"), F.sum(F.when(hit, 1).otherwise(0)).alias("n"), F.avg(F.when(hit, F.col("transition_anomaly_score"))).alias("confidence"))
    share = F.try_divide(F.col("n"), F.col("total"))
    found = F.col("n") > 0
    return one.select(
        F.coalesce(found, F.lit(False)).alias("detected"), F.coalesce("n", F.lit(0)).alias("n_anomalous"), F.when(found, F.bround(share, 4)).alias("fraction"),
        F.when(found, F.when(share > 0.3, "critical").when(share > 0.1, "high").when(share > 0.03, "medium").otherwise("low")).alias("severity"), F.when(found, F.col("confidence")).alias("confidence"),
    )


def top_flows(flagged: DataFrame, n: int = 50) -> DataFrame:
    return flagged.where("markov_anomaly").orderBy("row_id").limit(n).select("row_id", "src_ip", "transition_anomaly_score")


def fit_labelled(df: DataFrame, label: str = "label", normal: str = "Normal") -> dict[str, DataFrame]:
    return fit(df.where(F.col(label) == normal))


def save(model: dict[str, DataFrame], path: str) -> None:
    for name, part in model.items():
        part.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("transitions", "exits", "sizes", "states")}
