"""Queries that fit models on flows; their rows depend on the fit, so they have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import severity_from_score
from ..operators import features as X
from ..operators import ml as ML
from ..operators import packets as K
from ..operators import sessions as W
from ..operators.ordered import written
from ..sources import adapters as A
from .registry import add

NAMES = ["src_packets", "dst_packets", "src_bytes", "byte_ratio", "src_packet_rate", "src_syn_rate", "traffic_symmetry", "bytes_per_packet"]
REQUEST = ["src_packets", "dst_packets", "src_bytes", "byte_ratio", "src_packet_rate", "bytes_per_packet"]
#: Models are of the operators' default sizes: 200 trees of 256 rows, 200 rounds of depth 6, 200 trees of depth 15.
FOREST, BOOSTED, TREES = {}, {}, {}


def _training(s, d):
    flows = A.flows(s, d)
    return X.feature_table(flows, 2, keep=("row_id", F.col("IT_B_Label").alias("label")), sessions=False).select("row_id", "label", *NAMES)


def training(s, d):
    """Written: models read it many times."""
    return written(_training(s, d))


def keyed(df):
    """``row_id`` as (row_id, nth, label), which tells apart rows that share order and line."""
    nth = F.row_number().over(Window.partitionBy("row_id").orderBy("label", *NAMES))
    return df.withColumn("nth", nth).withColumn("row_id", F.struct("row_id", "nth", "label")).drop("nth")


def _forest(s, d, df=None, **how):
    df = training(s, d) if df is None else df
    scaled = ML.scale(df, ML.scale_parameters(df, NAMES), tuple(c for c in df.columns if c not in NAMES))
    return scaled, ML.fit_isolation_forest(scaled, NAMES, **(FOREST | how))


def isolation_forest(s, d):
    scaled, model = _forest(s, d)
    return model.score(scaled).select("row_id", "iso_score", "iso")


def details(s, d):
    df = training(s, d)
    model = ML.fit_ensemble(df, NAMES, forest=FOREST, boosted=BOOSTED, trees=TREES)
    return model.predict(df, ("row_id", "label")).select("row_id", "label", "iso", "iso_score", "xgb", "xgb_p", "rf", "rf_p", "ensemble_score", "prediction", "confidence", "agree")


def boosted(s, d):
    df = training(s, d)
    return ML.fit_boosted(df, NAMES, **BOOSTED).transform(df).select("row_id", F.col("xgb").cast("int").alias("xgb"))


def forest(s, d):
    df = training(s, d)
    return ML.fit_forest(df, NAMES, **TREES).transform(df).select("row_id", F.col("rf").cast("int").alias("rf"))


def importance(s, d):
    df = training(s, d)
    return ML.importance(ML.fit_forest(df, NAMES, **TREES), NAMES, df)


def contributions(s, d):
    """The top 5 features of every row."""
    scaled, model = _forest(s, d, written(keyed(_training(s, d))))
    return ML.explain(model, scaled).select("row_id.row_id", "row_id.nth", "feature", "contribution", "percent", "rank", "direction")


def attribution(s, d):
    """By feature and label, over all features of all rows."""
    scaled, model = _forest(s, d, written(keyed(training(s, d))))
    return ML.attribution(model, scaled, ("label",))


def audit(s, d):
    df = written(keyed(training(s, d)))
    model = ML.fit_ensemble(df, NAMES, forest=FOREST, boosted=BOOSTED, trees=TREES)
    scaled = ML.scale(df, model.parameters)
    out = ML.audit_report(model.predict(df, ("row_id", "label")), model, scaled)
    return out.select("row_id.row_id", "row_id.nth", "confidence", "feature", "contribution", "percent", "rank", "direction")


def guard(s, d):
    """A single class: only the isolation forest is fitted and votes."""
    df = training(s, d).where("label = 0")
    return ML.fit_ensemble(df, NAMES, forest=FOREST).predict(df).select("row_id", "iso", "ensemble_score", "prediction")


def packet_scores(s, d):
    flows = X.from_packet_flow(K.assemble(A.packets(s, d))).withColumn("row_id", F.xxhash64("src_ip", "dst_ip", "src_port", "dst_port"))
    names = ["src_packets", "dst_packets", "src_bytes", "byte_ratio", "bytes_per_packet", "flow_burstiness"]
    table = written(X.align(flows, names))
    scaled = ML.scale(table, ML.scale_parameters(table, names))
    out = ML.fit_isolation_forest(scaled, names, **FOREST).score(scaled)
    return out.select("row_id", "iso_score", "iso", severity_from_score(F.col("iso_score"), F.col("iso") == 1).alias("severity"))


def request_scores(s, d):
    req = A.requests(s, d)
    # (order, line) isn't unique: the forest draws rows by a hash of the whole request
    req = req.withColumns({"request": F.struct(*req.columns), "row_id": F.xxhash64(*req.columns)})
    feats = written(X.from_request(req, REQUEST, ("row_id", "request")))
    labelled = feats.withColumn("label", F.when(F.col("src_packets") > 45, 1).otherwise(0))
    model = ML.fit_ensemble(labelled, REQUEST, forest=FOREST, boosted=BOOSTED, trees=TREES)
    return ML.score_requests(model, feats).select("row_id", "signed_score", "zone", "zone_severity", "action")


def ablation(s, d):
    df = written(W.stratified_split(training(s, d), "label"))
    return ML.ablation(df, NAMES[:4], NAMES[4:])


add("ml_isolation_forest", isolation_forest)
add("ml_predict_details", details)
add("ml_boosted_trees", boosted)
add("ml_random_forest", forest)
add("ml_importance", importance)
add("top_importance", importance)
add("ml_explain", contributions)
add("ml_global_attribution", attribution)
add("ml_audit_report", audit)
add("ml_train_guard", guard)
add("ml_score_packet_flows", packet_scores)
add("ml_score_api_batch", request_scores)
add("ml_ablation", ablation)
