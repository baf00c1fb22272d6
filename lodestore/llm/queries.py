"""The registered queries of the training-data operators, over their whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .decontamination import contaminated
from .hard_negatives import hard_negatives
from .lexical import ranked_search
from .licenses import license_scan
from .line_dedup import drop_frequent_lines
from .mixing import mixed
from .near_dedup import near_groups
from .pii import personal_data
from .quality import quality_scores
from .sharding import hilbert_shards
from .simhash import edited_fingerprints
from .token_counts import routine_edits, token_counts
from .toxicity import toxicity_scores


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(routine_edits(documents(spark, sf_dir)))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(documents(spark, sf_dir), 40)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_frequent_lines(documents(spark, sf_dir), 10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op8_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), words=4, threshold=0.8)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", relabelled()))


def relabelled() -> Column:
    """Labels as the query's contract has them: every seventh row's is the next one."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    named = [
        op1_token_counts, op2_hilbert_shards, op3_license_scan, op4_line_dedup, op5_decontamination, op6_quality, op7_simhash,
        op8_entropy_balanced_mix, op9_near_dedup, op10_toxicity, op11_hard_negatives, op12_personal_data, op13_lexical_search,
    ]
    return {f.__name__: f for f in named}


LINE_SQL = """
WITH lines AS (
  SELECT row_id, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT row_id, doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row_id) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (f.key IS NOT NULL))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (key) GROUP BY row_id, doc_id
"""


NEGATIVE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row_id, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.row_id AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.row_id <> b.row_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INT) AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 5
"""

TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
LEXICAL_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {TERMS} AS ts FROM documents WHERE text IS NOT NULL),
whole AS (SELECT count(*) AS docs, sum(len(ts)) AS len FROM d WHERE len(ts) > 0),
tf AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(ts) AS term FROM d) GROUP BY ALL),
asked AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS item, item_id, unnest({TERMS}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole),
sums AS (
  SELECT item, item_id, row_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(ts) * docs) // whole.len)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN d USING (row_id), whole GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER w AS INT) AS rank, doc_id, score FROM sums WHERE score > 0
WINDOW w AS (PARTITION BY item ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER w <= 20
"""


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {"op4_line_dedup": LINE_SQL, "op11_hard_negatives": NEGATIVE_SQL, "op13_lexical_search": LEXICAL_SQL}
