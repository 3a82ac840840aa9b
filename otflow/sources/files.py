"""File sources and sinks: flow CSVs, captures, NVD responses; features, rules, bundles and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import SESSION, groups_json, leak_guard
from .captures import PACKETS, captures

__all__ = ["PACKETS", "captures"]


def list_datasets(spark: SparkSession, root: str) -> DataFrame:
    """Folders below ``root`` with their number of CSV files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(root).select("path")
    parts = F.split("path", "/")
    return files.groupBy(F.get(parts, F.size(parts) - 2).alias("dataset")).agg(F.count(F.lit(1)).alias("files"))


def csv_dataset(spark: SparkSession, folder: str, max_files: int = 5, schema: str | None = None) -> DataFrame:
    """The first CSV files of a folder by name, columns united, rows numbered by file and position."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path", "length")
    paths = [r["path"] for r in files.where("length > 0").orderBy("path").limit(max_files).collect()]
    if not paths:
        raise FileNotFoundError(f"no CSV files in {folder}")
    out = None
    for path in paths:
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
        one = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.withColumn("row_id", F.monotonically_increasing_id())


def nvd_responses(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.enrich import cves_of

    return cves_of(spark.read.option("multiLine", True).json(path))


def write_features(features: DataFrame, flows: DataFrame, labels: DataFrame, path: str) -> None:
    """Full table, table without session columns, labels, and groups as JSON. Labels among the features are an error."""
    leak_guard(features, reject=True)
    features.write.mode("overwrite").parquet(f"{path}/features_v3")
    features.drop(*SESSION).write.mode("overwrite").parquet(f"{path}/features_v2")
    labels.write.mode("overwrite").parquet(f"{path}/labels")
    features.sparkSession.createDataFrame([(groups_json(flows),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/groups")


def features_with_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Join by key; unequal row counts are an error."""
    out = features.join(labels, "row_id")
    if not features.count() == labels.count() == out.count():
        raise ValueError("features and labels don't match row by row")
    return out


def write_sample(df: DataFrame, path: str, n: int = 10_000) -> None:
    df.orderBy("row_id").limit(n).write.mode("overwrite").option("header", True).csv(path)


def write_rules(rules: DataFrame, path: str) -> None:
    rules.orderBy("sid").select("rule").coalesce(1).write.mode("overwrite").text(path)


def write_bundle(objects: DataFrame, path: str, envelope: bool = False) -> None:
    """One JSON bundle; its objects follow detected patterns, a bounded number."""
    bundle = objects.agg(F.concat(F.lit('{"type":"bundle","objects":['), F.array_join(F.array_sort(F.collect_list("body")), ","), F.lit("]}")).alias("value"))
    if envelope:
        bundle = bundle.select(F.concat(F.lit('{"more":false,"objects":['), "value", F.lit("]}")).alias("value"))
    bundle.coalesce(1).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, kind: str = "json") -> None:
    """Reports, distributions, predictions and summaries as JSON or CSV."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)
