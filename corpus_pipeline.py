"""From raw documents to token shards in training order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.common import materialise
from pagewright.llm.decontaminate import decontaminate
from pagewright.llm.jaccard_join import drop_near_copies
from pagewright.llm.mixing import mix_sources
from pagewright.llm.quality import quality_filter
from pagewright.llm.token_shards import write_shards


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality_filter(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose word shingles (five words, a similarity of 0.8 or more) link."""
    return drop_near_copies(docs, width=5, percent=80)


def benchmark_words(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' targets ask for."""
    return mix_sources(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per sequence written to the shards, with its slot."""
    return write_shards(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("benchmark_words", benchmark_words),
    ("source_mix", source_mix),
    ("token_shards", token_shards),
]

#: Token ids aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
