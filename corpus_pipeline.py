"""A corpus pipeline of five stages: quality, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; :func:`run` writes every
stage's result to the shared folder and reads it again for the next. All stages but the last return the columns of
documents; the last returns the place of every kept copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestore.llm.common import documents, dropped, saved
from lodestore.llm.decontamination import clean_documents
from lodestore.llm.mixing import mixture
from lodestore.llm.near_dedup import one_of_each
from lodestore.llm.quality import good_documents
from lodestore.llm.sharding import hilbert_shards

SHARDS = 40


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: shingles of five words, similarity of 0.8 or more.

    Every row is a document: of repeated rows one stays, and rows with a null doc_id are compared like all others.
    """
    return one_of_each(docs, words=5, threshold=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a passage of one, go: each row by its own text, whatever its doc_id."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it, whatever its doc_id."""
    return mixture(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy's shard and slot along the Hilbert curve."""
    return hilbert_shards(docs, SHARDS)


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can express neither the classifier nor fuzzy decontamination: the tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        last, docs = docs, saved(stage(spark, docs, sf_dir), f"stage-{name}")
        if docs is not last:
            dropped(last)
    return docs


def queries() -> dict:
    """The pipeline as a query."""
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    """No SQL: see ORACLE_SQL."""
    return {}
