"""A corpus pipeline: the classifier's rejects go, one of each group of near-duplicates stays, documents that hold
benchmark passages go, sources are mixed to their target weights, and what is left is sharded in the order of training.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hostlens.llm import decontaminate, mixing, quality, sharding, shingles
from hostlens.llm.common import discard, shared_dir, table, tidy


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ordered, place = mixing.in_order(docs)
    return sharding.sharded(ordered, order=place).read()


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", accept),
    ("simhash_near_dedup", deduplicate),
    ("benchmark_decontamination", remove_benchmark),
    ("mixing", mix),
    ("sharding", shard),
]

#: Fitted weights, fingerprints and shard files are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        with tidy(spark):  # the stage's intermediate tables
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
