"""Ingest queries: layers, sinks, dedup, conflicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lifecycle import curated_score
from ..operators import ingest as I
from ..operators import retrieval as R
from ..operators.conflicts import conflict_scan
from ..operators.contradictions import greedy_contradictions
from ..registry import query
from .common import STORE, bench_queries, store, table, text_index


@query("p1_first_layer", f"WITH {STORE}, k AS (SELECT DISTINCT source_agent, summary_hash FROM store WHERE doc_id % 3 = 0) SELECT id FROM store ANTI JOIN k USING (source_agent, summary_hash) WHERE doc_id % 3 <> 0 AND length(summary) >= 10")
def p1(spark, d):
    s = store(spark, d)
    return I.first_layer(s.where("doc_id % 3 <> 0"), s.where("doc_id % 3 = 0")).select("id")


@query("p2_promote", f"WITH {STORE}, n AS (SELECT *, count(*) OVER (PARTITION BY source_agent, summary_hash) AS n FROM store) SELECT id, CASE WHEN confidence >= 0.8 THEN 'confidence' WHEN n >= 2 THEN 'repeat' ELSE 'keyword' END AS reason FROM n WHERE confidence >= 0.8 OR n >= 2 OR contains(content, '记住')")
def p2(spark, d):
    return I.promoted(store(spark, d)).select("id", "reason")


@query("p2_z17_upsert", f"WITH {STORE}, a AS (SELECT id, importance, confidence FROM store WHERE doc_id % 3 <> 0), b AS (SELECT id, importance + 1 AS importance, confidence FROM store WHERE doc_id % 2 = 0) SELECT coalesce(a.id, b.id) AS id, coalesce(b.importance, a.importance) AS importance, coalesce(b.confidence, a.confidence) AS confidence, CASE WHEN a.id IS NULL THEN 'insert' WHEN b.id IS NOT NULL THEN 'update' ELSE 'keep' END AS op FROM a FULL JOIN b ON a.id = b.id")
def p2b(spark, d):
    s = store(spark, d)
    return I.merged(s.where("doc_id % 3 <> 0"), s.where("doc_id % 2 = 0").withColumn("importance", F.col("importance") + 1), "id", ["importance", "confidence"])


@query("p3_p4_curate", f"WITH {STORE}, a AS (SELECT *, least(10, greatest(1, importance + CASE WHEN confidence >= 0.9 THEN 1 WHEN confidence < 0.5 THEN -1 ELSE 0 END)) AS score FROM store WHERE confidence >= 0.6 AND importance >= 3 AND type IN ('principle', 'insight')) SELECT id, score, CASE WHEN industry = '' THEN 'general' ELSE string_split(regexp_replace(industry, '[\\[\\]\"'' ]', '', 'g'), ',')[1] END AS route FROM a WHERE score >= 6")
def p3(spark, d):
    route = F.when(F.col("industry") == "", "general").otherwise(F.get(F.split(F.regexp_replace("industry", "[\\[\\]\"' ]", ""), ","), F.lit(0)))
    a = store(spark, d).where("confidence >= 0.6 and importance >= 3 and type in ('principle', 'insight')")
    return a.select("id", curated_score(F.col("importance"), F.col("confidence")).alias("score"), route.alias("route")).where("score >= 6")


@query("p5_j10_gene_promote", f"WITH {STORE}, g AS (SELECT DISTINCT summary FROM store WHERE type = 'principle') SELECT id, confidence >= 0.95 AS flagged FROM store ANTI JOIN g USING (summary) WHERE type = 'lesson' AND confidence >= 0.85")
def p5(spark, d):
    s = store(spark, d)
    known = s.where("type = 'principle'").select("summary").distinct()
    return s.where("type = 'lesson' and confidence >= 0.85").join(known, "summary", "left_anti").select("id", (F.col("confidence") >= 0.95).alias("flagged"))


@query("k3_k4_s14_sink", f"WITH {STORE}, old AS (SELECT * FROM store WHERE doc_id % 4 = 0), new AS (SELECT * FROM store WHERE doc_id % 4 <> 0), f AS (SELECT * FROM new WHERE summary_hash NOT IN (SELECT summary_hash FROM old) AND NOT EXISTS (SELECT 1 FROM old o WHERE o.type = new.type AND o.source_ref = new.source_ref AND o.source_ref <> '')), o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY summary_hash ORDER BY id) = 1), t AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY type, source_ref, CASE WHEN source_ref = '' THEN id END ORDER BY id) = 1) SELECT id, summary_hash, type, source_ref FROM t")
def k3(spark, d):
    s = store(spark, d).select("id", "doc_id", "summary_hash", "type", "source_ref")
    return I.insertable(s.where("doc_id % 4 <> 0"), s.where("doc_id % 4 = 0")).select("id", "summary_hash", "type", "source_ref")


def _notes(spark, d):
    """Each note's summary and content, whole."""
    return store(spark, d).select("id", F.concat(X.or_empty(F.col("summary")), F.lit("\n"), X.or_empty(F.col("content"))).alias("text"))


@query("p6_x18_similar_pairs", f"WITH {STORE}, n AS (SELECT id, regexp_replace(lower(summary), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') AS t FROM store), g AS (SELECT id, CASE WHEN length(t) >= 2 THEN list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) ELSE list_distinct(string_split(t, '')) END AS g FROM n WHERE t <> ''), p AS (SELECT a.id AS a, b.id AS b, round(2 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g))::DOUBLE, 9) AS dice FROM g a JOIN g b ON a.id < b.id AND abs(len(a.g) - len(b.g)) <= 20) SELECT a, b, dice FROM p WHERE dice >= 0.9")
def p6(spark, d):
    """Pairs of like summaries, whole; p6_x19_duplicates judges summaries and contents together."""
    return I.similar_pairs(store(spark, d).select("id", F.col("summary").alias("text"))).select("a", "b", "dice")


@query("p6_x19_duplicates")
def p6b(spark, d):
    return I.duplicates(_notes(spark, d))


@query("p6_guard")
def p6c(spark, d):
    """Which summaries the guard lets in, one after another, and what the others repeat."""
    return I.accepted(store(spark, d).select("id", F.col("summary").alias("text")))


@query("p7_x17_conflicts")
def p7(spark, d):
    """Each note against the newest five notes that hold any of its keywords: class of the pair."""
    s = store(spark, d).select("id", "summary", "timestamp")
    plain = s.withColumn("plain", X.normal_text(F.col("summary")))  # once a note, not once a pair
    other = plain.select(F.col("id").alias("other"), F.col("summary").alias("b"), F.col("plain").alias("plain_b"))
    pairs = I.conflict_candidates(s).join(plain, "id").join(other, "other")
    sim = F.greatest(X.ratio("summary", "b"), X.likeness("plain", "plain_b"))
    scored = pairs.withColumn("similarity", F.round(sim, 6))
    return scored.select("id", "other", "similarity", I.conflict_class(F.col("summary"), F.col("b"), F.col("similarity")).alias("class"))


@query("p8_p9_conflict_scan", f"WITH {STORE}, k AS (SELECT id, type, source_agent, timestamp, list_distinct(list_filter(regexp_extract_all(lower(summary), '([a-z0-9]+)', 1), lambda w: length(w) > 4)) AS ks FROM store), t AS (SELECT *, unnest(ks) AS w FROM k), p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM t a JOIN t b ON a.w = b.w AND a.id < b.id), s AS (SELECT a, b, len(list_intersect(x.ks, y.ks)) / greatest(len(x.ks), len(y.ks))::DOUBLE + CASE WHEN x.type = y.type THEN 0.15::DOUBLE ELSE 0::DOUBLE END AS score, x.source_agent = y.source_agent AS same, CASE WHEN x.timestamp >= y.timestamp THEN a ELSE b END AS newer FROM p JOIN k x ON x.id = a JOIN k y ON y.id = b) SELECT a, b, round(score, 6) AS score, CASE WHEN same THEN newer ELSE 'arbitrate' END AS verdict FROM s WHERE score >= 0.5")
def p8(spark, d):
    runs = F.regexp_extract_all(F.lower("summary"), F.lit("([a-z0-9]+)"), 1)
    k = store(spark, d).select("id", "type", "source_agent", "timestamp", F.array_distinct(F.filter(runs, lambda w: F.length(w) > 4)).alias("ks"))
    return conflict_scan(k)


@query("p12_injection", "SELECT item_id, contains(lower(text), 'the') AS found FROM benchmark")
def p12(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.used(F.lit("the"), F.col("text")).alias("found"))


@query("r13_contradictions")
def r13(spark, d):
    s = store(spark, d)
    hits = R.ranked(R.top_bm25(bench_queries(spark, d), text_index(spark, d), 10), F.desc("full"), F.col("id"), limit=10)
    rows = hits.join(s.select("id", "summary", "content", "summary_hash", "confidence", "timestamp", "deprecated"), "id").withColumnRenamed("full", "score")
    return greedy_contradictions(rows).select("qid", "rank0", "id")
