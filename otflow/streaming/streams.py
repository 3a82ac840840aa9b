"""Structured Streaming forms of the operators. Rows later than the watermark are dropped from windows; :func:`split_late`
hands them to a sink of their own, and :func:`late_rows` counts those that a query dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as feats
from ..operators.detectors import detect
from ..operators.inspect import _modbus_fc
from ..operators.markov import ALPHA, scored, state_of
from .stateful import centred_stream, flow_stream, previous_stream

WATERMARK = "2 minutes"


def score_stream(flows: DataFrame, mean_size: float, thresholds: dict | None = None) -> DataFrame:
    """Stateless features and detectors; the mean packet size is a fitted parameter."""
    return detect(feats.feature_table(flows, 2, mean_size=mean_size, sessions=False), thresholds)


def session_stream(flows: DataFrame, seconds: float = 60, watermark: str = WATERMARK) -> DataFrame:
    """The six session columns over [ts - seconds, ts + seconds] of the same source, once the watermark has passed the
    window's end: the rows of :func:`..operators.sessions.session_window`, late by that much."""
    return centred_stream(flows, seconds, watermark)


def session_counts_stream(flows: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Approximate counts of a source in sliding windows, without the wait."""
    w = F.window("ts", window, slide)
    return flows.withWatermark("ts", watermark).groupBy("sIPs", w).agg(F.count(F.lit(1)).alias("src_flow_count"), F.approx_count_distinct("rIPs").alias("src_unique_dst_count"))


def assemble_stream(packets: DataFrame, idle: float = 120, linger: float = 2, watermark: str = WATERMARK) -> DataFrame:
    """Flows with all columns of the batch form, closed ``idle`` seconds after their last packet or, once FIN or RST was seen, ``linger`` seconds."""
    return flow_stream(packets, idle, linger, watermark)


def rules_stream(packets: DataFrame, function: int, count: int, seconds: int, watermark: str = "10 seconds") -> DataFrame:
    held = _modbus_fc(packets).where(F.col("fc") == function)
    return held.withWatermark("ts", watermark).groupBy("src_ip", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def dedup_alerts(alerts: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """One alert for each pattern and source within the watermark's period."""
    return alerts.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["pattern", "src_ip"])


def markov_stream(flows: DataFrame, model: dict, alpha: float = ALPHA, ttl_seconds: float = 3600) -> DataFrame:
    """Score of each row: the state before it is kept by source, and the model's tables are joined as in the batch form,
    a source's own chain where it has one. A source that is silent for ``ttl_seconds`` starts anew.

    That time is processing time, for which there is always another batch: a run with the trigger ``availableNow`` ends
    only if ``spark.sql.streaming.noDataMicroBatches.enabled`` is false."""
    steps = previous_stream(flows.withColumn("state", state_of(flows)), ttl_seconds)
    return scored(steps, model, alpha).select("row_id", "src_ip", F.col("transition_anomaly_score").alias("score"))


def split_late(stream: DataFrame, on_time, late, checkpoint: str, seconds: int = 120, time: str = "ts"):
    """A writer that calls ``on_time(rows, batch)`` and ``late(rows, batch)`` for each micro-batch.

    A row is late if it is more than ``seconds`` behind the largest time of all earlier batches, as with a watermark.
    That time is kept by batch in a table beside the checkpoint, in a folder that all executors share, so that a batch
    that is run again after a failure is split as before. A null time is on time."""
    spark, marks = stream.sparkSession, f"{checkpoint}/largest_time"

    def split(rows: DataFrame, batch: int) -> None:
        seen = None
        if batch:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{marks}/{batch - 1}")
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                seen = spark.read.schema("t timestamp").parquet(f"{marks}/{batch - 1}").first()["t"]
        behind = F.lit(False) if seen is None else F.coalesce(F.col(time) < F.lit(seen) - F.expr(f"INTERVAL {int(seconds)} SECONDS"), F.lit(False))
        on_time(rows.where(~behind), batch)
        late(rows.where(behind), batch)
        now = rows.agg(F.greatest(F.max(time), F.lit(seen).cast("timestamp")).alias("t"))
        now.coalesce(1).write.mode("overwrite").parquet(f"{marks}/{batch}")  # one row

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)


def late_rows(query) -> int:
    """Rows that a running query's stateful operators dropped for being behind the watermark, over the kept progress."""
    return sum(int(o.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for o in p.get("stateOperators", []))
