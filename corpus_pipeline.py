"""Corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; every result is written and read again. All but the last return the
columns of ``docs``.

Nulls and oddities: a null or empty text, or one without a letter, goes in the
first stage. Rows that share a doc_id are one document, of which near-dedup keeps
one row; a null doc_id names none, so such rows all pass it, however alike. A null
source is a source of its own. Repeated rows are near copies of each other. Extra
columns pass through, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from otflow.llm import decontamination, language_id, minhash_dedup, mixing, sharding
from otflow.llm.common import materialise, table

#: Posterior below which a text's language is taken as unknown.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language with even odds, go."""
    judged = language_id.identify(docs).where(F.col("lang_pred") != language_id.UNKNOWN).where(F.col("score") >= LEAST_SCORE)
    return judged.select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8)."""
    return minhash_dedup.keep_one(docs, shingle=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; small sources are repeated up to twice as often as the largest."""
    copies = mixing.mix(docs, repetition_limit=2.0)
    return copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.shard_digest(docs)


STAGES = [("language_id", known_language), ("near_dedup", one_of_near_copies), ("decontamination", without_benchmark), ("mixing", mixed), ("sharding", sharded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
