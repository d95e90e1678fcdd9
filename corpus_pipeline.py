"""A training corpus from raw documents: classify, deduplicate, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread as the next stage's ``docs``.  All but the last
return the columns of their input; extra columns pass through.  Nulls, empty
texts, repeated rows and empty tables are handled as each operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweb.llm import decontamination, mixing, near_dedup, quality, sharding
from strataweb.llm.common import materialise, table, temporary

SHARDS = 24


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; the held-out third of the labels is never learned."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), trainable=~quality.held_out(F.col("doc_id")))
    return quality.keep_good(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order that meets the sources' weights."""
    return mixing.in_mixed_order(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard, slot in it and mix_position, their place in the mixed order; rows of one cell of the curve follow that order."""
    return sharding.shard(mixing.with_layout_position(docs), SHARDS, ties=(mixing.POSITION,))


STAGES = [
    ("quality_classifier", classify_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: SQL cannot express the classifier or the sampled signatures; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary(spark):  # what the stage has written for itself goes with it
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
