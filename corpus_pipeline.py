"""The corpus pipeline: each stage works on all documents that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kmerframe.llm import decontaminate, mixing, ngram_join, suffix_dedup, toxicity
from kmerframe.llm.common import written

STAGES = [
    ("toxicity", toxicity.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("suffix_array_dedup", suffix_dedup.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("source_mixing", mixing.stage),
]

ORACLE_SQL = None  # nearest neighbours, components and rounding have no SQL; tests/llm holds brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = written(docs, name)
    return docs
