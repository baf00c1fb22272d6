"""Retrieval queries: channels, fusion, cascade, the whole search, grading, routing, federation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import ROUTER_FAST, Search
from ..functions.text import contains_any
from ..operators import retrieval as R
from ..operators.retrieval import route
from ..registry import query
from .common import ACCESS, BENCH_QUERIES, ENTRY_EDGES, NOW, STORE, access_log, bench_queries, entry_edges, entry_vectors, query_vectors, store, table, text_index

CFG = Search()

INDEX = r"""
docs_t AS (SELECT id, regexp_extract_all(lower(summary), '[\p{L}\p{N}]+') AS nt, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS bt FROM store),
flat AS (SELECT id, unnest(nt) AS term, 1 AS n, len(nt) + len(bt) AS dl FROM docs_t UNION ALL SELECT id, unnest(bt), 0, len(nt) + len(bt) FROM docs_t),
postings AS (SELECT id, term, dl, sum(n) AS tf_note, count(*) AS tf_full FROM flat GROUP BY ALL),
qterms AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM queries),
stats AS (SELECT count(*) AS docs, avg(len(nt) + len(bt)) AS avgdl FROM docs_t),
hits AS (SELECT p.* FROM postings p SEMI JOIN qterms USING (term)),
freq AS (SELECT term, count(*) AS df_full, count(*) FILTER (tf_note > 0) AS df_note FROM hits GROUP BY term),
bm AS (SELECT qid, id,
  round(sum(greatest(1e-6, ln((docs - df_note + 0.5) / (df_note + 0.5))) * tf_note * 2.2 / (tf_note + 1.2 * (0.25 + 0.75 * dl / avgdl))) FILTER (tf_note > 0), 9) AS note,
  round(sum(greatest(1e-6, ln((docs - df_full + 0.5) / (df_full + 0.5))) * tf_full * 2.2 / (tf_full + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS "full"
  FROM hits JOIN freq USING (term) JOIN qterms USING (term), stats GROUP BY qid, id)"""
FTS = INDEX + """,
staged AS (SELECT *, count(note) OVER (PARTITION BY qid) AS n_note, max(note) OVER (PARTITION BY qid) AS best, CASE WHEN note IS NOT NULL THEN 0 ELSE 1 END AS stage, coalesce(note, "full") AS score FROM bm),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid, stage ORDER BY score DESC, id) AS inn FROM staged),
fts AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY stage, score DESC, id) - 1 AS rank0, CASE WHEN n_note = 0 THEN 'ep_backfill_empty' WHEN n_note < 5 OR best < 8.0 THEN 'ep_backfill' ELSE 'note_only' END AS label
  FROM placed WHERE inn <= CASE WHEN stage = 0 OR n_note = 0 THEN 200 WHEN n_note < 5 OR best < 8.0 THEN 40 ELSE 0 END)"""
VECTORS = """
qv AS (SELECT item_id AS qid, embedding AS qvec FROM benchmark JOIN embeddings ON vec_id = item_id),
ev AS (SELECT concat('m', lpad(CAST(vec_id AS VARCHAR), 8, '0')) AS id, embedding AS vec FROM embeddings),
dots AS (SELECT qid, id, round(list_sum(list_transform(list_zip(qvec, vec), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 9) + 0.0 AS score FROM qv, ev),
emb AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank0 FROM dots QUALIFY rank0 < 200)"""
FUSED = """
parts AS (SELECT qid, id, score, rank0, 'fts' AS channel, 1.0::DOUBLE / (60 + rank0 / 1.3::DOUBLE + 1) AS part FROM fts UNION ALL SELECT qid, id, score, rank0, 'emb', 1.0::DOUBLE / (60 + rank0 / 0.6::DOUBLE + 1) FROM emb),
answered AS (SELECT qid, count(DISTINCT channel) AS n_channels, min(channel) AS only_one FROM parts GROUP BY qid),
sums AS (SELECT qid, id, sum(part) AS rrf, max(score) AS raw, min(rank0) AS own_rank FROM parts GROUP BY qid, id),
scored AS (SELECT qid, id, CASE WHEN n_channels = 1 THEN raw ELSE round(rrf * (1 + 0.3::DOUBLE * coalesce(nullif(confidence, 0), 0.5::DOUBLE)), 9) END AS score,
  CASE WHEN n_channels = 1 THEN own_rank ELSE 0 END AS o, n_channels, only_one FROM sums JOIN answered USING (qid) JOIN store USING (id)),
fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o, score DESC, id) - 1 AS rank0 FROM scored QUALIFY rank0 < 5)"""


@query("r1_bm25", f"WITH {STORE}, {BENCH_QUERIES}, {INDEX} SELECT qid, id, note, \"full\" AS full_score FROM bm")
def r1(spark, d):
    return R.bm25(bench_queries(spark, d), text_index(spark, d)).withColumnRenamed("full", "full_score")


@query("r2_cascade", f"WITH {STORE}, {BENCH_QUERIES}, {FTS} SELECT * FROM fts")
def r2(spark, d):
    return R.cascade(R.best_bm25(bench_queries(spark, d), text_index(spark, d), CFG), CFG)


@query("r2_t1_pruned_cascade", f"WITH {STORE}, {BENCH_QUERIES}, {FTS} SELECT * FROM fts")
def r2_pruned(spark, d):
    """The cascade where hardly anything is read ahead: lists are passed over by their bounds, frequent words looked up."""
    return R.cascade(R.best_bm25(bench_queries(spark, d), text_index(spark, d), CFG, first=50), CFG)


@query("r3_vectors", f"WITH {VECTORS} SELECT qid, id, round(score, 6) AS score, rank0 FROM emb")
def r3(spark, d):
    return R.vectors(query_vectors(spark, d), entry_vectors(spark, d), CFG).withColumn("score", F.round("score", 6))


GATE = """
g AS (SELECT *, first_value(score) OVER w - coalesce(nth_value(score, 10) OVER w, last_value(score) OVER w) AS gap10, first_value(score) OVER w - coalesce(nth_value(score, 5) OVER w, last_value(score) OVER w) AS gap5
  FROM emb WINDOW w AS (PARTITION BY qid ORDER BY rank0 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query("r4_w6_gap_gate", f"WITH {VECTORS}, {GATE} SELECT qid, id, rank0, CASE WHEN gap10 < 0.02 THEN 3 WHEN gap5 < 0.05 THEN 5 ELSE 10 END AS keep FROM g WHERE rank0 < keep")
def r4(spark, d):
    return R.gap_gate(R.vectors(query_vectors(spark, d), entry_vectors(spark, d), CFG)).select("qid", "id", "rank0", "keep")


@query("r5_w1_rrf", f"WITH {STORE}, {BENCH_QUERIES}, {FTS}, {VECTORS}, {FUSED} SELECT qid, id, score, rank0, n_channels FROM fused")
def r5(spark, d):
    s = store(spark, d)
    channels = {"fts": R.cascade(R.best_bm25(bench_queries(spark, d), text_index(spark, d), CFG), CFG), "emb": R.vectors(query_vectors(spark, d), entry_vectors(spark, d), CFG)}
    return R.fused(channels, s, CFG).select("qid", "id", "score", "rank0", "n_channels")


SEARCH = f"""WITH {STORE}, {BENCH_QUERIES}, {ACCESS}, {FTS}, {VECTORS}, {FUSED},
active AS (SELECT DISTINCT entry_id AS id FROM access WHERE accessed_at >= TIMESTAMP '2026-09-01 00:00:00' - INTERVAL 90 DAY),
aged AS (SELECT f.qid, f.id, CASE WHEN a.id IS NULL AND s.ts < epoch(TIMESTAMP '2026-08-02 00:00:00') THEN round(f.score * 0.6::DOUBLE, 9) ELSE f.score END AS score,
  CASE WHEN n_channels = 1 AND only_one = 'fts' THEN 'fts_only' WHEN n_channels = 1 THEN 'embed_only' ELSE 'dual_rrf' END AS mode,
  s.summary, s.summary_hash, s.timestamp, s.deprecated, s.expires_at, s.type FROM fused f JOIN store s USING (id) LEFT JOIN active a USING (id)),
wide AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank0 FROM aged),
valid AS (SELECT *, min(rank0) OVER (PARTITION BY qid, summary_hash) AS fst, row_number() OVER (PARTITION BY qid, summary_hash ORDER BY timestamp DESC, id) AS n FROM wide WHERE deprecated = 0 AND (expires_at = '' OR expires_at >= '{NOW}')),
kept0 AS (SELECT * REPLACE (row_number() OVER (PARTITION BY qid ORDER BY fst, id) - 1 AS rank0) FROM valid WHERE n = 1),
kept1 AS (SELECT qid, id, score, mode, summary, type, rank0 FROM kept0 UNION ALL SELECT qid, id, score, mode, summary, type, rank0 FROM wide WHERE rank0 = 0 AND qid NOT IN (SELECT qid FROM kept0)),
latest AS (SELECT id, 0.0 AS score, 'time_desc' AS mode, summary, type, row_number() OVER (ORDER BY timestamp DESC, id) - 1 AS rank0 FROM store QUALIFY rank0 < 5),
kept AS (SELECT * FROM kept1 UNION ALL SELECT q.qid, l.id, l.score, l.mode, l.summary, l.type, l.rank0 FROM queries q, latest l WHERE q.qid NOT IN (SELECT qid FROM kept1)),
norm AS (SELECT *, round(CASE WHEN mode = 'fts_only' THEN score / 300.0::DOUBLE ELSE score END * (3.2::DOUBLE / 2.9::DOUBLE), 9) AS nrm FROM kept),
best AS (SELECT *, max(nrm) OVER (PARTITION BY qid) AS b FROM norm)
SELECT qid, rank0 AS rank, id, score, mode, type, CASE WHEN length(summary) > 50 THEN substr(summary, 1, 50) || '…' ELSE summary END AS summary,
  CASE WHEN mode = 'time_desc' THEN 'weak' WHEN b >= 0.10 THEN 'high' WHEN b >= 0.03 THEN 'medium' WHEN b >= 0.01 THEN 'low' ELSE 'weak' END AS quality,
  CASE WHEN mode = 'time_desc' THEN 'weak' WHEN b >= 0.10 THEN 'strong' WHEN b >= 0.03 THEN 'medium' ELSE 'weak' END AS grade,
  (mode = 'time_desc' OR nrm < 0.03) AS weak_match FROM best"""


@query("r23_search", SEARCH)
def r23(spark, d):
    return R.search(bench_queries(spark, d), store(spark, d), access_log(spark, d), query_vectors(spark, d), entry_vectors(spark, d), CFG, text_index(spark, d))


GRAPH = """
first AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o, score DESC, id) AS n FROM scored) WHERE n <= 30),
bothways AS (SELECT id1 AS src, id2 AS dst, weight FROM edges UNION ALL SELECT id2, id1, weight FROM edges),
heavy AS (SELECT src, dst, max(weight) AS weight FROM bothways GROUP BY src, dst),
nearest AS (SELECT * FROM heavy QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 3),
reached AS (SELECT f.qid, dst AS id, max(weight) AS score FROM first f JOIN nearest ON src = f.id GROUP BY ALL HAVING max(weight) >= 0.35),
copies AS (SELECT DISTINCT qid, substr(summary_hash, 1, 8) AS mark FROM first JOIN store USING (id)),
others AS (SELECT r.* FROM reached r JOIN store s USING (id) ANTI JOIN first f ON f.qid = r.qid AND f.id = r.id ANTI JOIN copies c ON c.qid = r.qid AND c.mark = substr(s.summary_hash, 1, 8)),
graph AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank0 FROM others QUALIFY rank0 < 15),
gparts AS (SELECT * FROM parts UNION ALL SELECT qid, id, score, rank0, 'graph', 1.0::DOUBLE / (60 + rank0 + 1) FROM graph),
ganswered AS (SELECT qid, count(DISTINCT channel) AS n_channels, min(channel) AS only_one, bool_or(channel = 'graph') AS reached FROM gparts GROUP BY qid),
gsums AS (SELECT qid, id, sum(part) AS rrf, max(score) AS raw, min(rank0) AS own_rank FROM gparts GROUP BY qid, id),
gscored AS (SELECT qid, id, CASE WHEN n_channels = 1 THEN raw ELSE round(rrf * (1 + 0.3::DOUBLE * coalesce(nullif(confidence, 0), 0.5::DOUBLE)), 9) END AS score,
  CASE WHEN n_channels = 1 THEN own_rank ELSE 0 END AS o, n_channels, only_one, reached FROM gsums JOIN ganswered USING (qid) JOIN store USING (id)),
gfused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o, score DESC, id) - 1 AS rank0 FROM gscored QUALIFY rank0 < 5)"""
WIDER = SEARCH.replace("emb AS (SELECT *, row_number()", "allemb AS (SELECT *, row_number()").replace(
    FUSED,
    """
g AS (SELECT *, first_value(score) OVER w - coalesce(nth_value(score, 10) OVER w, last_value(score) OVER w) AS gap10, first_value(score) OVER w - coalesce(nth_value(score, 5) OVER w, last_value(score) OVER w) AS gap5
  FROM allemb WINDOW w AS (PARTITION BY qid ORDER BY rank0 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
emb AS (SELECT qid, id, score, rank0 FROM g WHERE rank0 < CASE WHEN gap10 < 0.02 THEN 3 WHEN gap5 < 0.05 THEN 5 ELSE 10 END),"""
    + FUSED + f", {ENTRY_EDGES}," + GRAPH,
).replace("ELSE 'dual_rrf' END AS mode", "WHEN reached THEN 'dual_rrf_graph' ELSE 'dual_rrf' END AS mode").replace("FROM fused f JOIN store s", "FROM gfused f JOIN store s")


@query("r6_r22_r23_wider_search", WIDER)
def r23_wider(spark, d):
    """The search with its gap gate and its graph channel on."""
    cfg = replace(CFG, gate=True, graph=True)
    return R.search(bench_queries(spark, d), store(spark, d), access_log(spark, d), query_vectors(spark, d), entry_vectors(spark, d), cfg, text_index(spark, d), entry_edges(spark, d))


@query("r11_forget", f"WITH {STORE}, {ACCESS}, hits AS (SELECT event_id % 40 AS qid, entry_id AS id, round(sum(value), 9) AS score FROM (SELECT *, concat('m', lpad(CAST(user_id AS VARCHAR), 8, '0')) AS entry_id FROM events) GROUP BY ALL), active AS (SELECT DISTINCT entry_id AS id FROM access WHERE accessed_at >= TIMESTAMP '2026-06-03 00:00:00' AND scene = 'purchase') SELECT qid, h.id, CASE WHEN a.id IS NULL AND s.ts < epoch(TIMESTAMP '2026-08-02 00:00:00') THEN round(score * 0.6::DOUBLE, 9) ELSE score END AS score FROM hits h JOIN store s USING (id) LEFT JOIN active a USING (id)")
def r11(spark, d):
    hits = table(spark, d, "events").groupBy((F.col("event_id") % 40).alias("qid"), F.concat(F.lit("m"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("id")).agg(F.round(F.sum("value"), 9).alias("score"))
    s = store(spark, d)
    hits = hits.join(s.select("id"), "id", "left_semi").withColumn("rank0", F.lit(0))
    return R.forgotten(hits, s, access_log(spark, d).where("scene = 'purchase'"), CFG).select("qid", "id", "score")


@query("r12_w3_versions", f"WITH {STORE}, v AS (SELECT *, row_number() OVER (PARTITION BY summary_hash ORDER BY timestamp DESC, id) AS n FROM store WHERE deprecated = 0 AND (expires_at = '' OR expires_at >= '{NOW}')) SELECT id, summary_hash FROM v WHERE n = 1")
def r12(spark, d):
    hits = store(spark, d).select(F.lit(0).alias("qid"), "id", "summary_hash", "timestamp", "deprecated", "expires_at", F.col("doc_id").alias("rank0"))
    w = Window.partitionBy("summary_hash").orderBy(F.desc("timestamp"), "id")
    return hits.where(R.is_valid(NOW)).withColumn("n", F.row_number().over(w)).where("n = 1").select("id", "summary_hash")


@query("r10_time_channel", f"WITH {STORE}, q AS (SELECT item_id AS qid, make_timestamp((1767225600 + item_id * 432000) * 1000000)::DATE AS t1 FROM benchmark), s AS (SELECT qid, id, round(0.05::DOUBLE + 0.85::DOUBLE * greatest(0.0, 1 - abs(event_date - t1) / 30.0::DOUBLE), 9) AS score FROM q, store WHERE event_date IS NOT NULL AND abs(event_date - t1) <= 30) SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank0 FROM s QUALIFY rank0 < 15")
def r10(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.timestamp_seconds(F.col("item_id") * 432000 + 1767225600).cast("date").alias("t1"))
    return R.time_channel(q, store(spark, d), CFG)


@query("r19_x31_x32_grades", "WITH s AS (SELECT event_id, value / 1000 AS score, event_type FROM events) SELECT event_id, CASE WHEN score >= 0.10 THEN 'high' WHEN score >= 0.03 THEN 'medium' WHEN score >= 0.01 THEN 'low' ELSE 'weak' END AS quality, CASE WHEN event_type = 'error' THEN 'weak' WHEN score >= 0.10 THEN 'strong' WHEN score >= 0.03 THEN 'medium' ELSE 'weak' END AS grade, CASE WHEN score >= 0.25 THEN 'strong' WHEN score >= 0.05 THEN 'medium' WHEN score >= 0.01 THEN 'low' ELSE 'weak' END AS judge FROM s")
def r19(spark, d):
    from ..functions.lifecycle import grade_of, quality_of

    score = F.col("value") / 1000
    judge = F.when(score >= 0.25, "strong").when(score >= 0.05, "medium").when(score >= 0.01, "low").otherwise("weak")
    return table(spark, d, "events").select("event_id", quality_of(score, CFG).alias("quality"), grade_of(score, F.col("event_type") == "error", CFG).alias("grade"), judge.alias("judge"))


@query("r20_obqc", "WITH s AS (SELECT user_id AS qid, value / 1000 AS score, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events), f AS (SELECT qid, max(score) AS best, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS unknown, min(0.6::DOUBLE + score) AS conf FROM s WHERE n <= 5 GROUP BY qid) SELECT qid, CASE WHEN best < 0.01 THEN 'refuse' WHEN best < 0.03 OR unknown > 0 OR conf < 0.8 THEN 'mark' ELSE 'pass' END AS verdict, (unknown > 0) AS unknown_source, (conf < 0.8) AS low_confidence FROM f")
def r20(spark, d):
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    top = e.withColumn("n", F.row_number().over(w)).where("n <= 5").withColumn("score", F.col("value") / 1000)
    f = top.groupBy(F.col("user_id").alias("qid")).agg(F.max("score").alias("best"), F.count_if(F.col("event_type") == "error").alias("unknown"), F.min(0.6 + F.col("score")).alias("conf"))
    verdict = F.when(F.col("best") < 0.01, "refuse").when((F.col("best") < 0.03) | (F.col("unknown") > 0) | (F.col("conf") < 0.8), "mark").otherwise("pass")
    return f.select("qid", verdict.alias("verdict"), (F.col("unknown") > 0).alias("unknown_source"), (F.col("conf") < 0.8).alias("low_confidence"))


@query("r25_router", "WITH q AS (SELECT page_id, trim(url) AS q FROM pages), p AS (SELECT *, regexp_extract(q, '([A-Za-z]{2,}[-_][A-Za-z0-9]+|\\d{4,}|[\\w.-]+\\.(?:py|json|yaml|yml|sh|db|md|log|conf|plist|toml|bak)\\b)', 1) AS f, list_min(list_filter(list_transform([" + ", ".join(f"'{w}'" for w in ROUTER_FAST) + "], lambda w: strpos(q, w)), lambda x: x > 0)) AS s FROM q) SELECT page_id, CASE WHEN f <> '' OR s IS NOT NULL THEN 'fts' ELSE 'dual' END AS mode, CASE WHEN f <> '' OR s IS NOT NULL THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS sure FROM p")
def r25(spark, d):
    mode, sure = route(F.col("url"))
    return table(spark, d, "pages").select("page_id", mode.alias("mode"), sure.alias("sure"))


@query("r27_w5_federated", "WITH c AS (SELECT 'store' AS source, doc_id AS item, n_chars AS s FROM documents UNION ALL SELECT 'session', conv_id * 100 + turn, length(text) FROM conversations UNION ALL SELECT 'files', page_id, length(url) FROM pages), r AS (SELECT source, item, row_number() OVER (PARTITION BY source ORDER BY s DESC, item) AS rank FROM c) SELECT source, item, rank, round(1.0::DOUBLE / (60 + rank + 1), 4) AS score FROM r ORDER BY 1.0::DOUBLE / (61 + rank) DESC, source LIMIT 60")
def r27(spark, d):
    parts = [
        table(spark, d, "documents").select(F.lit("store").alias("source"), F.col("doc_id").alias("item"), F.col("n_chars").alias("s")),
        table(spark, d, "conversations").select(F.lit("session").alias("source"), (F.col("conv_id") * 100 + F.col("turn")).alias("item"), F.length("text").cast("long").alias("s")),
        table(spark, d, "pages").select(F.lit("files").alias("source"), F.col("page_id").alias("item"), F.length("url").cast("long").alias("s")),
    ]
    return federated(parts, 60)


def federated(parts, limit):
    """Interleave (source, item, s) tables by rank: no summing across sources."""
    w = Window.partitionBy("source").orderBy(F.desc("s"), "item")
    each = [p.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit) for p in parts]
    out = each[0]
    for p in each[1:]:
        out = out.unionByName(p)
    exact = 1.0 / (F.col("rank") + 61)
    return out.orderBy(exact.desc(), "source").limit(limit).select("source", "item", "rank", F.round(exact, 4).alias("score"))


@query("r28_layer_hints", "SELECT source, count(*) AS hits, CASE WHEN count(*) FILTER (lang = 'es') = 0 THEN 'widen' WHEN count(*) FILTER (lang = 'es') < 5 THEN 'thin' ELSE 'ok' END AS hint FROM documents GROUP BY source")
def r28(spark, d):
    n = F.count_if(F.col("lang") == "es")
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("hits"), F.when(n == 0, "widen").when(n < 5, "thin").otherwise("ok").alias("hint"))


@query("r29_j14_concept_query", "WITH q AS (SELECT item_id AS qid, lower(regexp_extract(text, '^(\\S+)', 1)) AS term FROM benchmark), c AS (SELECT n_nationkey AS cid, lower(substr(n_name, 1, 3)) AS pref, lower(r_name) AS alt FROM nation JOIN region ON n_regionkey = r_regionkey), m AS (SELECT qid, cid, CASE WHEN pref = term THEN 0 WHEN alt = term THEN 1 WHEN contains(pref, substr(term, 1, 1)) THEN 2 WHEN contains(alt, substr(term, 1, 1)) THEN 3 END AS level FROM q, c) SELECT qid, cid, level, row_number() OVER (PARTITION BY qid ORDER BY level, cid) AS n FROM m WHERE level IS NOT NULL QUALIFY n <= 10")
def r29(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.lower(F.regexp_extract("text", r"^(\S+)", 1)).alias("term"))
    c = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("cid"), F.lower(F.substring("n_name", 1, 3)).alias("pref"), F.lower("r_name").alias("alt"))
    head = F.substring("term", 1, 1)
    level = F.when(F.col("pref") == F.col("term"), 0).when(F.col("alt") == F.col("term"), 1).when(F.contains("pref", head), 2).when(F.contains("alt", head), 3)
    m = q.crossJoin(R.checked_broadcast(c)).select("qid", "cid", level.alias("level")).where("level is not null")
    return R.ranked(m, F.col("level"), F.col("cid"), limit=10, name="n").withColumn("n", F.col("n") + 1)


@query("r31_r30_ontology", "SELECT r_name AS bucket, count(n_nationkey) AS concepts, string_agg(n_name, ',' ORDER BY n_name) AS labels FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def r31(spark, d):
    j = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.groupBy(F.col("r_name").alias("bucket")).agg(F.count("n_nationkey").alias("concepts"), F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("labels"))


@query("r18_multi_hop", f"WITH {STORE}, q0 AS (SELECT item_id AS qid, 0 AS hop, array_to_string(list_slice(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), 1, 4), ' ') AS text FROM benchmark UNION ALL SELECT item_id, 1, array_to_string(list_slice(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), 5, 8), ' ') FROM benchmark), queries AS (SELECT qid * 2 + hop AS qid, text FROM q0), {INDEX}, pool AS (SELECT qid // 2 AS qid, id, max(\"full\") AS score FROM bm GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank0 FROM pool QUALIFY rank0 < 30) SELECT * FROM r WHERE rank0 < 5")
def r18(spark, d):
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    b = table(spark, d, "benchmark")
    hops = b.select(F.col("item_id").alias("qid"), F.posexplode(F.array(F.array_join(F.slice(words, 1, 4), " "), F.array_join(F.slice(words, 5, 4), " "))).alias("hop", "text"))
    return multi_hop(hops, text_index(spark, d), 5)


def multi_hop(hops, entries, top_k, pool=30):
    """All hops' sub-queries (qid, hop, text) in one batch; an entry keeps its best score of any hop."""
    asked = hops.select((F.col("qid") * 2 + F.col("hop")).alias("qid"), "text")
    found = R.top_bm25(asked, entries, pool).groupBy(F.expr("qid div 2").alias("qid"), "id").agg(F.max("full").alias("score"))
    return R.ranked(found, F.desc("score"), F.col("id"), limit=pool).where(F.col("rank0") < top_k)


@query("f14_r26_instruction_tail", f"WITH {STORE}, {BENCH_QUERIES}, {INDEX}, h AS (SELECT b.qid, b.id, \"full\" AS score, (s.type = 'instruction' AND confidence > 0.9) AS tail, (contains(q.text, 'the') OR contains(q.text, 'for')) AS hint FROM bm b JOIN store s USING (id) JOIN queries q ON q.qid = b.qid), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN hint AND tail THEN 1 ELSE 0 END, score DESC, id) - 1 AS rank0, sum(CASE WHEN hint AND tail THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS extra, sum(CASE WHEN hint AND tail THEN 0 ELSE 1 END) OVER (PARTITION BY qid) AS plain FROM h) SELECT qid, id, score, rank0 FROM r WHERE rank0 < 5 + extra")
def f14(spark, d):
    q, s = bench_queries(spark, d), store(spark, d)
    h = R.bm25(q, text_index(spark, d)).join(s.select("id", "type", "confidence"), "id").join(q, "qid")
    # the small tables' words stand in for the hints, which are Chinese
    return R.instruction_tail(h, F.desc("full"), F.col("id"), top_k=5, hints=("the", "for")).select("qid", "id", F.col("full").alias("score"), "rank0")
