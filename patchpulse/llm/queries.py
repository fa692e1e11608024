"""The operators as named queries over the supplied tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, compression, decontaminate, extraction, mixing, neardup, ranking, repetition, secrets, sharding, substrings, suffixes, toxicity
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extraction.main_text(table(spark, sf_dir, "pages"))


@query
def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("key")


@query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weights and the drawn documents."""
    return mixing.mix(table(spark, sf_dir, "documents"))


SQL["op3_source_mixing"] = mixing.oracle()


@query
def op4_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition rules over every document."""
    return repetition.repetition_quality(table(spark, sf_dir, "documents"))


@query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("items", "spans")


SQL["op5_benchmark_decontamination"] = decontaminate.oracle()


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return compression.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of repeated windows removed from every document."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


SQL["op9_substring_dedup"] = substrings.oracle()


@query
def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of near-equal bytes."""
    out = sharding.kd_shards(table(spark, sf_dir, "documents"), shards=24)
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


@query
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of repeated strings removed from every document."""
    return suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"))


SQL["op11_suffix_dedup"] = suffixes.oracle()


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of each language by their weakest cut."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


SQL["op12_collocations"] = collocations.oracle()


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for every benchmark item."""
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op13_ranked_search"] = ranking.oracle()
