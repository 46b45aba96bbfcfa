"""A corpus pipeline: quality rules, near-duplicate removal, suffix dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atlasq.llm import jaccard, mixing, packing, rules, suffixes
from atlasq.llm.store import materialize, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return stage(docs, rules.keep_good)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return stage(docs, jaccard.one_of_each)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long strings that occur more than once are cut out of the texts."""
    return stage(docs, suffixes.without_repeats)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their source's target tells."""
    return stage(docs, mixing.mixed_rows)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in their sequences."""
    return stage(docs, packing.pack_documents)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources", source_mix),
    ("packing", pack),
]

#: SQL can express neither the estimated rules nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, work) in enumerate(STAGES):
        docs = materialize(work(spark, docs, sf_dir), f"stage{k}")
    return docs
