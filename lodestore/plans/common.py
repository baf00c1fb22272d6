"""Inputs that the registered queries share, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import NOW
from ..operators.index import TextIndex
from ..scratch import delete, scratch_path, state_of
from ..sources.store import store, store_sql, table

__all__ = ["BENCH_QUERIES", "NOW", "STORE", "access_log", "bench_queries", "entry_vectors", "query_vectors", "store", "table", "text_index", "ACCESS", "edges", "EDGES", "entry_edges", "ENTRY_EDGES"]

STORE = f"store AS ({store_sql(duck=True)})"
BENCH_QUERIES = "queries AS (SELECT item_id AS qid, array_to_string(list_slice(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), 1, 6), ' ') AS text FROM benchmark)"
ACCESS = "access AS (SELECT concat('m', lpad(CAST(user_id AS VARCHAR), 8, '0')) AS entry_id, event_type AS scene, ts + INTERVAL 945 DAY AS accessed_at FROM events)"
EDGES = "edges AS (SELECT DISTINCT least(l_partkey, l_suppkey + 100000) AS id1, greatest(l_partkey, l_suppkey + 100000) AS id2, 'keyword_overlap' AS relation, CAST((l_partkey * 7 + l_suppkey * 3) % 10 AS DOUBLE) / 10 AS weight FROM lineitem)"

ENTRY_EDGES = "edges AS (SELECT DISTINCT least(a, b) AS id1, greatest(a, b) AS id2, 'same_agent' AS relation, weight FROM (SELECT concat('m', lpad(CAST(l_partkey AS VARCHAR), 8, '0')) AS a, concat('m', lpad(CAST(l_suppkey * 7 AS VARCHAR), 8, '0')) AS b, CAST((l_partkey * 7 + l_suppkey * 3) % 10 AS DOUBLE) / 10 AS weight FROM lineitem) WHERE a <> b)"


def bench_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, text): the first six words of each benchmark item."""
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(F.slice(words, 1, 6), " ").alias("text"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, scene, accessed_at) from events, moved to the months before NOW."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("m"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("entry_id"), F.col("event_type").alias("scene"), (F.col("ts") + F.expr("interval 945 days")).alias("accessed_at")
    )


def entry_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("m"), F.lpad(F.col("vec_id").cast("string"), 8, "0")).alias("id"), F.col("embedding").alias("vec"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, qvec): the vector numbered like each benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    return table(spark, sf_dir, "embeddings").join(items, F.col("vec_id") == F.col("qid")).select("qid", F.col("embedding").alias("qvec"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bipartite graph of parts and suppliers as weighted edges (id1 < id2)."""
    a, b = F.col("l_partkey"), F.col("l_suppkey") + 100000
    return table(spark, sf_dir, "lineitem").select(F.least(a, b).alias("id1"), F.greatest(a, b).alias("id2"), F.lit("keyword_overlap").alias("relation"), (((F.col("l_partkey") * 7 + F.col("l_suppkey") * 3) % 10).cast("double") / 10).alias("weight")).distinct()


def entry_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted edges between entries of the store (id1 < id2), from parts and suppliers."""
    a, b = (F.concat(F.lit("m"), F.lpad(c.cast("string"), 8, "0")) for c in (F.col("l_partkey"), F.col("l_suppkey") * 7))
    rows = table(spark, sf_dir, "lineitem").select(F.least(a, b).alias("id1"), F.greatest(a, b).alias("id2"), F.lit("same_agent").alias("relation"), (((F.col("l_partkey") * 7 + F.col("l_suppkey") * 3) % 10).cast("double") / 10).alias("weight"))
    return rows.where("id1 <> id2").distinct()


_indexes: dict[tuple[str, str], tuple[tuple[int, int], TextIndex]] = {}


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The stored index of the derived store: built when it is first asked for, and anew if the documents have changed since."""
    key = (spark.sparkContext.applicationId, sf_dir)
    state = state_of(f"{sf_dir}/documents.parquet")
    known = _indexes.get(key)
    if known is None or known[0] != state:
        if known is not None:
            delete(known[1].root)
        _indexes[key] = (state, TextIndex.build(store(spark, sf_dir), scratch_path(spark, "text-index")))
    return _indexes[key][1]
