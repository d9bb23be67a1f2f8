"""The corpus pipeline: toxicity, exact dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftlens.llm import stages

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("toxicity", stages.toxicity),
    ("exact_dedup", stages.exact),
    ("simhash_dedup", stages.near),
    ("mixing", stages.mix),
    ("packing", stages.pack),
]

#: SQL expresses neither the classifier nor the random rounding; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stages.reread(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
