"""Session features of a source, and the other window operators.

Two definitions exist: over the whole table in time order, and in a centred
window of seconds. Counts come from group-bys with partial aggregation; windows
are used only where order matters, over slices of heavy sources whose ends are
carried over (:mod:`.ordered`). The centred window is a sweep over time buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import filled
from .ordered import SLICE_ROWS, numeric, placed, sliced
from .sweep import session_sweep


def session_global(df: DataFrame, rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` with the six session columns; ``timestamp`` text, or numeric ``start`` in seconds, gives the order. A null source is 0.

    Sources with more than ``rows`` flows are cut into slices, each led in by the ten flows before it."""
    time = F.unix_micros(F.try_to_timestamp("timestamp")) / 1e6 if "timestamp" in df.columns else F.col("start").cast("double")
    cut = sliced(df.withColumns({"_t": time, "_at": placed(time)}), ["sIPs"], "_at", numeric(df, "row_id"), rows)
    order = cut.window("_t", "row_id")
    gap = F.coalesce(F.col("_t") - F.lag("_t").over(order), F.lit(0.0))
    gapped = cut.led(["_t", "row_id"], 10).withColumn("src_inter_flow_interval", gap)
    spread = F.coalesce(F.var_samp("src_inter_flow_interval").over(order.rowsBetween(-9, 0)), F.lit(0.0))
    gapped = gapped.withColumn("src_inter_flow_variance", spread).where(~F.col("_copy")).drop("_at", "_slice", "_copy")
    pairs = df.groupBy("sIPs", "rIPs").agg(F.count(F.lit(1)).alias("_pair"))
    sources = pairs.groupBy("sIPs").agg(F.count("rIPs").alias("_distinct"), F.sum("_pair").alias("_flows"))
    held = gapped.join(sources, "sIPs", "left").join(pairs, ["sIPs", "rIPs"], "left")
    known = lambda c: F.when(F.col("sIPs").isNull(), 0.0).otherwise(F.coalesce(c, F.lit(0.0))).cast("double")
    return held.withColumns({
        "src_unique_dst_count": known(F.col("_distinct")), "src_flow_count": known(F.col("_flows")), "src_inter_flow_interval": known(F.col("src_inter_flow_interval")), "src_inter_flow_variance": known(F.col("src_inter_flow_variance")),
        "src_dst_flow_ratio": known(F.col("_pair") / (F.col("_flows") + 1)), "src_payload_entropy": F.log1p(filled("sPayloadSum")) if "sPayloadSum" in df.columns else F.lit(0.0),
    }).drop("_t", "_distinct", "_flows", "_pair")


def _clean(df: DataFrame) -> DataFrame:
    if "start" not in df.columns:
        raise ValueError("session windows need a start column")
    return df.select("row_id", F.coalesce("sIPs", F.lit("unknown")).alias("sIPs"), F.coalesce("rIPs", F.lit("unknown")).alias("rIPs"), filled("start").alias("start"), (filled("sPayloadAvg") if "sPayloadAvg" in df.columns else F.lit(0.0)).alias("payload"))


def entropy_by(df: DataFrame, key: str, value: str, bins: int = 10) -> DataFrame:
    """(key, e): entropy in bits of ``bins`` equal bins between a key's least and largest value, from counts of the bins."""
    ends = df.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    held = df.where(F.col(value).isNotNull()).join(ends.select(F.col(key).alias("_key"), "low", "high"), F.col(key).eqNullSafe(F.col("_key")))
    index = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1)))
    counts = held.groupBy("_key", index.alias("bin")).agg(F.count(F.lit(1)).alias("k")).where("bin is not null")  # at most ``bins`` rows a key
    joined = ends.join(counts, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.groupBy(key).agg(F.coalesce(-F.sum(F.col("k") / F.col("n") * F.log2(F.col("k") / F.col("n"))), F.lit(0.0)).alias("e"))


def session_window(df: DataFrame, seconds: float = 60) -> DataFrame:
    """row_id and the session columns over [t - seconds, t + seconds] of the same source: one sweep over each time bucket.

    A source is spread over its buckets of ``seconds``. A bucket's task holds the numbers of three buckets, about 200
    bytes a flow, and no lists: memory is linear in the flows, however many of them lie in a window."""
    base = _clean(df)
    bucket = F.floor(F.col("start") / seconds)
    near = base.select("row_id", F.xxhash64("sIPs").alias("_part"), "start", F.xxhash64("rIPs").alias("dst"), "payload", F.posexplode(F.array(bucket, bucket - 1, bucket + 1)).alias("_way", "_bucket"))
    return session_sweep(near.withColumn("own", F.col("_way") == 0), seconds)


def neighbours(base: DataFrame, seconds: int = 60) -> DataFrame:
    """Interval self-join: all flows of the same source within ``seconds`` of each flow, by equality on time buckets."""
    bucket = F.floor(F.col("start") / seconds)
    left = base.select("row_id", "sIPs", "start", bucket.alias("b"))
    right = base.select(F.col("sIPs").alias("src"), F.col("start").alias("other_start"), F.col("rIPs").alias("other_dst"), F.col("payload").alias("other_payload"), F.col("row_id").alias("other_id"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("ob"))
    return left.join(right, (F.col("sIPs") == F.col("src")) & (F.col("b") == F.col("ob"))).where(F.abs(F.col("start") - F.col("other_start")) <= seconds)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """First n rows of each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def rate_excess(df: DataFrame, key: str, time: str, limit: int = 100, seconds: float = 60, rows: int = SLICE_ROWS) -> DataFrame:
    """Rows beyond ``limit`` within the trailing ``seconds`` of their key, with ``in_window``. Rows without a time are left out.

    In a key with more than ``rows`` rows, the count is that of all rows up to the time less that of all before the
    window: running counts over slices with what lies before carried over."""
    timed = df.where(F.col(time).isNotNull())
    # a row comes at its time, and asks at the window's start, ahead of what comes then
    event = F.struct(F.col(time).cast("double").alias("at"), F.lit(1).alias("comes")), F.struct((F.col(time) - seconds).cast("double").alias("at"), F.lit(0).alias("comes"))
    numbered = timed.withColumns({"_row": F.struct(*timed.columns), "_id": F.monotonically_increasing_id()})
    events = numbered.select(key, "_id", F.explode(F.array(*event)).alias("_e"), "_row").select(key, "_id", "_e.at", "_e.comes", F.when(F.col("_e.comes") == 1, F.col("_row")).alias("_row"))
    cut = sliced(events, [key], "at", rows=2 * rows)
    if not cut.heavy:
        w = Window.partitionBy(key).orderBy(F.col(time)).rangeBetween(-seconds, 0)
        return timed.withColumn("in_window", F.count(F.lit(1)).over(w)).where(F.col("in_window") > limit)
    run = cut.carried(cut.df, {"_before": F.sum("comes")}).withColumn("_seen", F.sum("comes").over(cut.window("at", "comes")) + F.col("_before"))
    both = run.groupBy("_id").agg(F.first("_row", ignorenulls=True).alias("_row"), (F.max(F.when(F.col("comes") == 1, F.col("_seen"))) - F.max(F.when(F.col("comes") == 0, F.col("_seen")))).alias("in_window"))
    return both.where(F.col("in_window") > limit).select("_row.*", "in_window")


def _drawn(seed: int) -> Column:
    """A row's draw: the md5 of the seed and ``row_id``, which other engines have as well."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string")))


def stratified_split(df: DataFrame, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``is_test`` for the ``share`` of each class with the smallest draws; found by rank within 256 parts by the draw's first digits, so no class lies in one task."""
    held = df.withColumn("_h", _drawn(seed)).withColumn("_b", F.substring("_h", 1, 2))
    sizes = held.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(label, "_b", (F.sum("_n").over(Window.partitionBy(label).orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(label)).alias("_all"))
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", "row_id"))
    return held.withColumn("_r", rank).join(F.broadcast(before), [label, "_b"]).withColumn("is_test", F.col("_before") + F.col("_r") <= F.round(F.col("_all") * share)).drop("_h", "_b", "_r", "_before", "_all")


def sample_rows(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """The ``k`` rows with the smallest draws; rows that share ``row_id`` go by their other columns."""
    return df.orderBy(_drawn(seed), *df.columns).limit(k)
