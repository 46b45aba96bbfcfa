"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, jaccard, language_model, licenses, mixing, packing, resampling, rules, search, shards, suffixes, target_draw, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removal_digest(table(spark, sf_dir, "documents"))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.token_output(table(spark, sf_dir, "documents"))


def op6_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_ids(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents have no paths; a tree is laid out by source and doc_id, each tenth document being a licence file."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 10 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.expr("doc_id div 1000"), F.expr("doc_id div 100"), name)
    return licenses.licenses(docs.select("doc_id", path.alias("path"), "text"))


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op10_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_products(table(spark, sf_dir, "embeddings"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_draw.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_importance_resampling": op2_importance_resampling,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_shards": op4_token_shards,
    "op5_mix_sources": op5_mix_sources,
    "op6_jaccard_components": op6_jaccard_components,
    "op7_license_scan": op7_license_scan,
    "op8_pack_sequences": op8_pack_sequences,
    "op9_score_texts": op9_score_texts,
    "op10_top_products": op10_top_products,
    "op11_target_resampling": op11_target_resampling,
    "op12_url_filter": op12_url_filter,
    "op13_source_divergence": op13_source_divergence,
}
ORACLES: dict[str, str] = {"op5_mix_sources": mixing.SQL, "op10_top_products": search.SQL, "op11_target_resampling": target_draw.SQL, "op13_source_divergence": divergence.SQL}
