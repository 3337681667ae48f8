"""The training-text pipeline: documents to packed sequences.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``. By then the
tables that the stage kept aside are no longer read, and the next stage deletes them first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echotrail.llm.common import text_session
from echotrail.llm.exact_copies import drop_exact_copies
from echotrail.llm.mixing import mix
from echotrail.llm.near_copies import drop_near_copies
from echotrail.llm.packing import pack
from echotrail.llm.rules import keep_good
from echotrail.session import drop_written
from echotrail.sources.files import scratch_path


def _begin(spark: SparkSession, docs: DataFrame) -> None:
    drop_written(text_session(spark), used_by=docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules find good."""
    _begin(spark, docs)
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    _begin(spark, docs)
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    _begin(spark, docs)
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; documents repeat or go as their source's budget says."""
    _begin(spark, docs)
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a document that the mix repeats is packed as often."""
    _begin(spark, docs)
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

# SQL cannot express the fitted rules, so the pipeline is tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    text_session(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
