"""A training corpus from ``documents``: quality, near-dedup, decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a
DataFrame; all but the last return the columns of ``documents``. Null ids and texts, repeated rows and
empty tables are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import decontam, mixing, neardup, quality, tokens
from foliospark.llm.common import stage, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(spark, docs, quality.fit(spark, docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of the document with the smallest id of each group stays: five words, similarity 0.8 or more."""
    return neardup.deduplicated(spark, docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source, in its order; repeated documents are repeated rows."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, read back: (doc_id, start, n_tokens, ids_crc32)."""
    return tokens.tokenized(spark, docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("token-id output", write_tokens),
]
#: The classifier, MinHash and the tokenizer are not SQL; tests/llm/test_models.py has each stage
#: against its parts and the near-duplicates against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stage(spark, docs, f"stage-{n}")
    return docs.select(F.col("doc_id"), "start", "n_tokens", "ids_crc32")
