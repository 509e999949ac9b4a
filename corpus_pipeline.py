"""A training corpus from ``documents`` in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written as Parquet in the
shared folder and read again by the next. Null or empty texts fail the quality rules; repeated rows
become one in the second stage; an empty table gives an empty corpus. Stages pass on the columns of
their input, the last one replaces ``text`` by its ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from warraq.llm import bpe, decontaminate, near_dups, quality_rules, repeated_spans
from warraq.session import discard, settled


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dups.keep_one(docs)


def span_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of 200 bytes or more that occur again are cut out of the texts."""
    return repeated_spans.cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of texts, with digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, with_ids=True).drop("text")


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("span_dedup", span_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", encoding),
]

#: Suffix order and token merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, settled(spark, lambda f=stage, d=docs: f(spark, d, sf_dir))
        discard(before)
    return docs
