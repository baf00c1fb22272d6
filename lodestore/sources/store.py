"""The entry store: schema, and a store derived from the documents table.

The derived store gives every column that retrieval, lifecycle and ingest need a deterministic value, so all
operators can be held against SQL on the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..config import VALID_TYPES

_TEXT = ("id", "version", "timestamp", "type", "summary", "content")
_MORE = (
    "created_at", "updated_at", "data_type", "train_batch_id", "g2_labeled_by", "g3_reviewed_by", "g3_result", "corrected_at", "summary_hash",
    "concern_id", "industry", "source_ref", "expires_at", "deprecated_at", "quadrant", "quadrant_labeled_at", "merged_to", "memory_track",
    "references", "entities", "relations", "conflict_type",
)
_EVENTS = T.ArrayType(T.MapType(T.StringType(), T.StringType()))

#: All columns of a store; readers may be given fewer.
STORE = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField(c, T.DoubleType()) for c in ("confidence", "trust_score")]
    + [T.StructField("importance", T.IntegerType()), T.StructField("half_life", T.StringType()), T.StructField("source_agent", T.StringType())]
    + [T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("audit_log", _EVENTS), T.StructField("merge_history", _EVENTS)]
    + [T.StructField(c, T.StringType()) for c in _MORE]
    + [T.StructField(c, T.IntegerType()) for c in ("train_eligible", "g1_check_passed", "correction_count", "deprecated")]
    + [T.StructField("event_date", T.DateType())]
)

_FIRST = 1767225600  # 2026-01-01T00:00:00Z


def store_sql(duck: bool = False, table: str = "documents") -> str:
    """SELECT of the derived store over documents, for Spark or for DuckDB."""
    types = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(VALID_TYPES))

    def iso(seconds: str) -> str:
        if duck:
            return f"strftime(make_timestamp(({seconds}) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
        return f"date_format(timestamp_seconds({seconds}), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"

    born = f"({_FIRST} + (doc_id * 9973 % 240) * 86400 + doc_id % 86400)"
    sha = "substr(sha256(substr(text, 1, 100)), 1, 12)" if duck else "substr(sha2(substr(text, 1, 100), 256), 1, 12)"
    day = f"CAST(make_timestamp({born} * 1000000) AS DATE)" if duck else f"CAST(timestamp_seconds({born}) AS DATE)"
    return f"""
SELECT doc_id, concat('m', lpad(CAST(doc_id AS STRING), 8, '0')) AS id, substr(text, 1, 100) AS summary, text AS content,
  CASE CAST(doc_id % 25 AS INT) {types} END AS type, source AS source_agent, lang,
  CAST((doc_id * 37) % 101 AS DOUBLE) / 100 AS confidence, 0.5 + CAST((doc_id * 11) % 50 AS DOUBLE) / 100 AS trust_score,
  CAST(1 + (doc_id * 7) % 10 AS INT) AS importance,
  CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN 'permanent' WHEN 1 THEN '30d' WHEN 2 THEN '90d' WHEN 3 THEN '8w' WHEN 4 THEN '6m' ELSE '2y' END AS half_life,
  CASE lang WHEN 'en' THEN 'AI' WHEN 'fr' THEN '[AI, finance]' WHEN 'de' THEN '["energy", AI]' ELSE '' END AS industry,
  {iso(born)} AS timestamp, {born} AS ts, {iso(born)} AS created_at, {iso(f"{born} + (doc_id % 40) * 86400")} AS updated_at,
  CASE WHEN doc_id % 4 = 0 THEN {iso(f"{born} + 7776000")} ELSE '' END AS expires_at,
  CAST(CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS INT) AS deprecated,
  CASE WHEN doc_id % 2 = 0 THEN 'semantic' ELSE 'episodic' END AS memory_track, {sha} AS summary_hash,
  CASE WHEN doc_id % 3 <> 0 THEN {day} END AS event_date,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('src/', CAST(doc_id % 97 AS STRING)) END AS source_ref,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'knowledge' END AS data_type,
  CAST(doc_id % 3 AS INT) AS g1_check_passed, CAST(doc_id % 2 AS INT) AS train_eligible
FROM {table}"""


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived store; columns that a query does not use are not read."""
    return spark.sql(store_sql(table="{docs}"), docs=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
