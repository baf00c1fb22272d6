"""Ranking extras and second-tier queries: gates, reranking, routing with fall-back, small gates and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Search
from ..functions.text import overlap, tokens
from ..operators import retrieval as R
from ..registry import query
from .common import STORE, bench_queries, entry_vectors, query_vectors, store, table, text_index
from .retrieval import BENCH_QUERIES, FTS, INDEX, VECTORS, route

CFG = Search()


def candidate_gate(candidates: DataFrame, query_vecs: DataFrame, entry_vecs: DataFrame, keep: int = 8, gate: float | None = None) -> DataFrame:
    """Candidates by cosine with their query: the best ``keep``, and all without a vector (appended, they pass any gate).

    Only the candidates' vectors are joined, not all pairs.
    """
    with_vec = candidates.join(query_vecs, "qid", "left").join(entry_vecs, "id", "left")
    sim = F.when(F.col("qvec").isNotNull() & F.col("vec").isNotNull(), F.round(R.dot(F.col("qvec"), F.col("vec")), 9))
    scored = with_vec.withColumn("sim", sim).select("qid", "id", "rank0", "sim")
    if gate is not None:
        scored = scored.where(F.col("sim").isNull() | (F.col("sim") >= gate))
    w = Window.partitionBy("qid", F.col("sim").isNull()).orderBy(F.desc("sim"), "rank0", "id")
    return scored.withColumn("n", F.row_number().over(w)).where(F.col("sim").isNull() | (F.col("n") <= keep)).select("qid", "id", "sim")


@query("r7_r8_r9_truncate", f"WITH {STORE}, {BENCH_QUERIES}, {FTS}, {VECTORS}, s AS (SELECT f.qid, f.id, f.rank0, round(list_sum(list_transform(list_zip(qvec, vec), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 9) + 0.0 AS sim FROM fts f LEFT JOIN qv USING (qid) LEFT JOIN ev ON ev.id = f.id), s2 AS (SELECT qid, id, rank0, CASE WHEN sim IS NOT NULL AND EXISTS (SELECT 1 FROM ev WHERE ev.id = s.id) THEN sim END AS sim FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY qid, sim IS NULL ORDER BY sim DESC, rank0, id) AS n FROM s2) SELECT qid, id, round(sim, 6) AS sim FROM r WHERE sim IS NULL OR n <= 8")
def r9(spark, d):
    c = R.cascade(R.best_bm25(bench_queries(spark, d), text_index(spark, d), CFG), CFG)
    return candidate_gate(c, query_vectors(spark, d), entry_vectors(spark, d)).withColumn("sim", F.round("sim", 6) + 0.0)


def reranked(candidates: DataFrame, score, top: int = 20, k: int = 5) -> DataFrame:
    """The best ``top`` candidates by a scorer column, its evidence kept. Any column will do: a model's pandas UDF, or a lexical one."""
    w = Window.partitionBy("qid")
    pool = candidates.where(F.col("rank0") < top).withColumn("evidence", score)
    return pool.withColumn("n", F.row_number().over(w.orderBy(F.desc("evidence"), "rank0", "id"))).where(F.col("n") <= k)


@query("r15_rerank", f"WITH {STORE}, {BENCH_QUERIES}, {INDEX}, r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY \"full\" DESC, id) - 1 AS rank0 FROM bm QUALIFY rank0 < 20), t AS (SELECT r.*, list_distinct(regexp_extract_all(lower(q.text), '[\\p{{L}}\\p{{N}}]+')) AS a, list_distinct(regexp_extract_all(lower(s.summary), '[\\p{{L}}\\p{{N}}]+')) AS b FROM r JOIN queries q USING (qid) JOIN store s USING (id)), e AS (SELECT qid, id, rank0, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b)) / greatest(len(a), len(b))::DOUBLE END, 6) AS evidence FROM t) SELECT qid, id, evidence FROM e QUALIFY row_number() OVER (PARTITION BY qid ORDER BY evidence DESC, rank0, id) <= 5")
def r15(spark, d):
    q, s = bench_queries(spark, d), store(spark, d)
    c = R.ranked(R.top_bm25(q, text_index(spark, d), 20), F.desc("full"), F.col("id"), limit=20).join(q, "qid").join(s.select("id", "summary"), "id")
    lexical = F.round(overlap(F.array_distinct(tokens(F.col("text"))), F.array_distinct(tokens(F.col("summary")))), 6)
    return reranked(c, lexical).select("qid", "id", "evidence")


def routed(fast: DataFrame, deep: DataFrame, queries: DataFrame, soft_line: float = 4.6329) -> DataFrame:
    """Fast results of queries routed to full text; the deep ones where the route says so, or the fast best is missing or below the line."""
    mode, _ = route(F.col("text"))
    best = fast.groupBy("qid").agg(F.max("score").alias("best"))
    plan = queries.select("qid", mode.alias("mode")).join(best, "qid", "left").select("qid", F.when((F.col("mode") == "fts") & (F.col("best") >= soft_line), "fts").otherwise("dual").alias("mode"))
    one = fast.select("qid", "id", "rank0", F.lit("fts").alias("mode"))
    return one.unionByName(deep.select("qid", "id", "rank0", F.lit("dual").alias("mode"))).join(plan, ["qid", "mode"], "left_semi")


@query("r26_routed", f"WITH {STORE}, {BENCH_QUERIES}, {FTS}, {VECTORS}, b AS (SELECT qid, max(score) AS best FROM fts WHERE rank0 < 5 GROUP BY qid), m AS (SELECT q.qid, CASE WHEN regexp_matches(q.text, '[A-Za-z]{{2,}}[-_][A-Za-z0-9]+|\\d{{4,}}') AND best >= 4.6329 THEN 'fts' ELSE 'dual' END AS mode FROM queries q LEFT JOIN b USING (qid)) SELECT qid, id, rank0, mode FROM (SELECT qid, id, rank0, 'fts' AS mode FROM fts WHERE rank0 < 5 UNION ALL SELECT qid, id, rank0, 'dual' FROM emb WHERE rank0 < 5) SEMI JOIN m USING (qid, mode)")
def r26(spark, d):
    q = bench_queries(spark, d)
    fast = R.cascade(R.best_bm25(q, text_index(spark, d), CFG), CFG).where("rank0 < 5")
    return routed(fast, R.vectors(query_vectors(spark, d), entry_vectors(spark, d), CFG).where("rank0 < 5"), q)


@query("u5_expected_valid", f"WITH {STORE}, g AS (SELECT source_agent, list_sort(list(id)) AS e, list(id) FILTER (deprecated = 1) AS dead FROM store GROUP BY 1) SELECT source_agent, array_to_string(list_filter(e, lambda x: NOT list_contains(coalesce(dead, []), x)), ',') AS expected FROM g")
def u5(spark, d):
    g = store(spark, d).groupBy("source_agent").agg(F.sort_array(F.collect_list("id")).alias("e"), F.collect_list(F.when(F.col("deprecated") == 1, F.col("id"))).alias("dead"))
    return g.select("source_agent", F.array_join(F.array_except("e", "dead"), ",").alias("expected"))


@query("x30_x44_maps", f"WITH {STORE} SELECT id, lower(trim(source_agent)) AS agent, CASE WHEN type IN ('lesson', 'fact', 'decision', 'result', 'insight', 'principle', 'info', 'instruction', 'correction', 'record', 'idea', 'estimate', 'rule') THEN 'content' ELSE 'asset' END AS kind, (summary <> '' AND source_ref <> '' AND data_type <> '') AS complete FROM store")
def x30(spark, d):
    from ..config import CONTENT_TYPES

    full = (F.col("summary") != "") & (F.col("source_ref") != "") & (F.col("data_type") != "")
    return store(spark, d).select("id", F.lower(F.trim("source_agent")).alias("agent"), F.when(F.col("type").isin(*CONTENT_TYPES), "content").otherwise("asset").alias("kind"), full.alias("complete"))


def arbitration_mode(pairs: DataFrame) -> DataFrame:
    """One row: recall and false positives of a heuristic's verdicts (flag, truth), and the mode that they allow."""
    hit, wrong = F.count_if(F.col("flag") & F.col("truth")), F.count_if(F.col("flag") & ~F.col("truth"))
    recall, false = hit / F.count_if("truth"), wrong / F.count("*")
    return pairs.agg(F.round(recall, 6).alias("recall"), F.round(false, 6).alias("false_rate"), F.when((recall >= 0.8) & (false <= 0.1), "auto").when(recall >= 0.5, "assist").otherwise("manual").alias("mode"))


@query("p9_arbitration_mode", "WITH p AS (SELECT value > 20 AS flag, event_type = 'purchase' AS truth FROM events) SELECT round(count(*) FILTER (flag AND truth) / count(*) FILTER (truth)::DOUBLE, 6) AS recall, round(count(*) FILTER (flag AND NOT truth) / count(*)::DOUBLE, 6) AS false_rate, CASE WHEN count(*) FILTER (flag AND truth) / count(*) FILTER (truth)::DOUBLE >= 0.8 AND count(*) FILTER (flag AND NOT truth) / count(*)::DOUBLE <= 0.1 THEN 'auto' WHEN count(*) FILTER (flag AND truth) / count(*) FILTER (truth)::DOUBLE >= 0.5 THEN 'assist' ELSE 'manual' END AS mode FROM p")
def p9(spark, d):
    return arbitration_mode(table(spark, d, "events").select((F.col("value") > 20).alias("flag"), (F.col("event_type") == "purchase").alias("truth")))


@query("z7_z8_reports", "SELECT item_id, CAST(regexp_extract(m, 'passed: (\\d+)', 1) AS INT) AS passed, CAST(regexp_extract(m, 'rate = ([0-9.]+)', 1) AS DOUBLE) AS rate FROM (SELECT item_id, '## layer' || chr(10) || 'passed: ' || (item_id % 9) || chr(10) || 'rate = 0.' || (item_id % 7 + 1) AS m FROM benchmark)")
def z7(spark, d):
    n = F.col("item_id")
    m = F.concat(F.lit("## layer\npassed: "), (n % 9).cast("string"), F.lit("\nrate = 0."), (n % 7 + 1).cast("string"))
    return table(spark, d, "benchmark").select("item_id", F.regexp_extract(m, r"passed: (\d+)", 1).cast("int").alias("passed"), F.regexp_extract(m, r"rate = ([0-9.]+)", 1).cast("double").alias("rate"))


@query("z16_latest_config", "SELECT c_nationkey AS scope, arg_max(c_custkey, (c_acctbal, c_custkey)) AS version FROM customer GROUP BY 1")
def z16(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("scope")).agg(F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("version"))


@query("t6_pair_coverage", "WITH g AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS groups_, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs, round(least(1.0::DOUBLE, 50000 / sum(n * (n - 1) // 2)::DOUBLE), 6) AS coverage FROM g")
def t6(spark, d):
    """How many pairs a rule would compare, and what share a cap of 50,000 would cover; the pairs themselves are never made."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("n"))
    pairs = F.sum(F.expr("n * (n - 1) div 2"))
    return g.agg(F.count("*").alias("groups_"), pairs.alias("pairs"), F.round(F.least(F.lit(1.0), F.lit(50000) / pairs), 6).alias("coverage"))
