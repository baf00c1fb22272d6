"""Evaluation queries: ranking quality, gates, weight search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import Search
from ..operators import retrieval as R
from ..operators.containment import holding
from ..registry import query
from .common import STORE, bench_queries, entry_vectors, query_vectors, store, table, text_index
from .retrieval import BENCH_QUERIES, FTS, VECTORS

RESULTS = "res AS (SELECT o_custkey AS qid, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank0 FROM orders QUALIFY rank0 < 5), gold AS (SELECT o_custkey AS qid, o_orderkey AS id FROM orders WHERE o_orderkey % 4 = 0)"


def _results(spark, d):
    o = table(spark, d, "orders")
    res = R.ranked(o.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), "o_totalprice"), F.desc("o_totalprice"), F.col("id"), limit=5)
    return res, o.where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"))


def metrics(results, golden, k=5):
    """Per query: linear-discount NDCG, precision, hit, first hit. results (qid, id, rank0), golden (qid, id)."""
    hits = results.where(F.col("rank0") < k).join(golden.distinct().withColumn("_rel", F.lit(1)), ["qid", "id"], "left")
    gain = F.sum(F.when(F.col("_rel") == 1, 1.0 / (F.col("rank0") + 2)).otherwise(0.0))
    per = hits.groupBy("qid").agg(gain.alias("dcg"), F.count("_rel").alias("hits"), F.max(F.when((F.col("rank0") == 0) & (F.col("_rel") == 1), 1).otherwise(0)).alias("top1"))
    n = golden.distinct().groupBy("qid").agg(F.count("*").alias("n_rel"))
    j = n.join(per, "qid", "left").na.fill(0, ["dcg", "hits", "top1"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_rel")).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / (i + 1))
    return j.select("qid", F.round(F.col("dcg") / ideal, 6).alias("ndcg"), F.round(F.col("hits") / F.least(F.lit(k), F.col("n_rel")), 6).alias("precision"), (F.col("hits") > 0).alias("hit"), (F.col("top1") == 1).alias("first"))


METRICS = f"{RESULTS}, per AS (SELECT r.qid, sum(CASE WHEN g.id IS NOT NULL THEN 1.0::DOUBLE / (rank0 + 2) ELSE 0 END) AS dcg, count(g.id) AS hits, max(CASE WHEN rank0 = 0 AND g.id IS NOT NULL THEN 1 ELSE 0 END) AS top1 FROM res r LEFT JOIN gold g ON g.qid = r.qid AND g.id = r.id GROUP BY r.qid), n AS (SELECT qid, count(*) AS n_rel FROM gold GROUP BY qid), met AS (SELECT n.qid, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(5, n_rel) + 1), lambda i: 1.0::DOUBLE / (i + 1))), 6) AS ndcg, round(coalesce(hits, 0) / least(5, n_rel)::DOUBLE, 6) AS \"precision\", coalesce(hits, 0) > 0 AS hit, coalesce(top1, 0) = 1 AS first FROM n LEFT JOIN per USING (qid))"


@query("e1_e2_e3_metrics", f"WITH {METRICS} SELECT * FROM met")
def e1(spark, d):
    return metrics(*_results(spark, d))


@query("e4_e10_e12_gates", f"WITH {METRICS} SELECT count(*) AS n, round(avg(ndcg), 6) AS ndcg, round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate, avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END) < 0.5 AS alert, round(count(*) FILTER (qid % 10 = 0 AND hit) / count(*) FILTER (qid % 10 = 0)::DOUBLE, 6) AS answered_negatives FROM met")
def e4(spark, d):
    rate = F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0))
    neg = F.col("qid") % 10 == 0
    return metrics(*_results(spark, d)).agg(F.count("*").alias("n"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(rate, 6).alias("hit_rate"), (rate < 0.5).alias("alert"), F.round(F.count_if(neg & F.col("hit")) / F.count_if(neg), 6).alias("answered_negatives"))


@query("e5_z10_bank_judge", "WITH h AS (SELECT item_id, text AS gt FROM benchmark) SELECT h.item_id, count(d.doc_id) AS docs, CASE WHEN count(d.doc_id) > 0 THEN 'hit' ELSE 'refuse' END AS verdict FROM h LEFT JOIN documents d ON contains(d.text, h.gt) GROUP BY h.item_id")
def e5(spark, d):
    return bank_judge(table(spark, d, "benchmark").select("item_id", F.col("text").alias("gt")), table(spark, d, "documents").select("doc_id", "text"))


def bank_judge(bank, corpus):
    """How many texts hold each case's expected string, whole: a stated set of cases against all texts, in one pass."""
    found = holding(corpus, "doc_id", "text", bank, "item_id", "gt").groupBy("item_id").agg(F.count("*").alias("docs"))
    return bank.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("docs", F.lit(0)).alias("docs"), F.when(F.col("docs") > 0, "hit").otherwise("refuse").alias("verdict"))


@query("e6_coverage", "WITH h AS (SELECT item_id, text AS gt FROM benchmark), c AS (SELECT h.item_id, bool_or(d.doc_id IS NOT NULL) AS ok FROM h LEFT JOIN documents d ON contains(d.text, h.gt) GROUP BY 1) SELECT count(*) AS cases, count(*) FILTER (ok) AS covered, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS coverage, count(*) FILTER (ok) / count(*)::DOUBLE >= 0.9 AS passed FROM c")
def e6(spark, d):
    j = bank_judge(table(spark, d, "benchmark").select("item_id", F.col("text").alias("gt")), table(spark, d, "documents").select("doc_id", "text"))
    ok = F.count_if(F.col("verdict") == "hit")
    return j.agg(F.count("*").alias("cases"), ok.alias("covered"), F.round(ok / F.count("*"), 6).alias("coverage"), (ok / F.count("*") >= 0.9).alias("passed"))


GRID = [(a, b) for a in (1.3, 1.5, 1.7) for b in (0.6, 0.7, 0.8)] + [(1.0, 1.0)]


def weight_grid(fts, emb, golden, grid=tuple(GRID), rrf_k=60):
    """Mean NDCG of every pair of channel weights in one job: ranks are computed once and joined with the grid."""
    spark = fts.sparkSession
    g = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(grid)], "g int, wf double, we double")
    parts = fts.select("qid", "id", "rank0", F.lit("f").alias("c")).unionByName(emb.select("qid", "id", "rank0", F.lit("e").alias("c")))
    w = F.when(F.col("c") == "f", F.col("wf")).otherwise(F.col("we"))
    each = parts.crossJoin(F.broadcast(g)).groupBy("g", "qid", "id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank0") / w + 1)), 9).alias("s"))  # ten fixed rows
    ranked = each.withColumn("rank0", F.row_number().over(Window.partitionBy("g", "qid").orderBy(F.desc("s"), "id")) - 1).where("rank0 < 5")
    hits = ranked.join(golden.distinct(), ["qid", "id"]).groupBy("g", "qid").agg(F.sum(1.0 / (F.col("rank0") + 2)).alias("gain"))
    asked = golden.select("qid").distinct().crossJoin(F.broadcast(g))
    return asked.join(hits, ["g", "qid"], "left").groupBy("g", "wf", "we").agg(F.round(F.avg(F.coalesce("gain", F.lit(0.0))), 6).alias("mean_gain"), F.count("*").alias("queries"))


@query("e7_grid_search", f"WITH {STORE}, {BENCH_QUERIES}, {FTS}, {VECTORS}, gold AS (SELECT item_id AS qid, concat('m', lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), grid AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}::DOUBLE, {b}::DOUBLE)' for i, (a, b) in enumerate(GRID))}) t(g, wf, we)), parts AS (SELECT qid, id, rank0, 'f' AS c FROM fts UNION ALL SELECT qid, id, rank0, 'e' FROM emb), e AS (SELECT g, qid, id, round(sum(1.0::DOUBLE / (60 + rank0 / CASE WHEN c = 'f' THEN wf ELSE we END + 1)), 9) AS s FROM parts, grid GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY g, qid ORDER BY s DESC, id) - 1 AS rank0 FROM e QUALIFY rank0 < 5), h AS (SELECT g, qid, sum(1.0::DOUBLE / (rank0 + 2)) AS gain FROM r JOIN gold USING (qid, id) GROUP BY ALL), a AS (SELECT DISTINCT qid, g, wf, we FROM gold, grid) SELECT a.g, a.wf, a.we, round(avg(coalesce(gain, 0)), 6) AS mean_gain, count(*) AS queries FROM a LEFT JOIN h ON a.g = h.g AND a.qid = h.qid GROUP BY ALL")
def e7(spark, d):
    cfg, s = Search(), store(spark, d)
    fts = R.cascade(R.best_bm25(bench_queries(spark, d), text_index(spark, d), cfg), cfg)
    emb = R.vectors(query_vectors(spark, d), entry_vectors(spark, d), cfg)
    bank = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("gt"))
    gold = holding(s, "id", "content", bank, "qid", "gt")
    return weight_grid(fts, emb, gold)


@query("e8_e9_j13_regressions", f"WITH {METRICS}, c AS (SELECT qid, ndcg AS base, CASE WHEN qid % 7 = 0 THEN ndcg * 0.5::DOUBLE ELSE ndcg END AS cand FROM met) SELECT qid, base, cand, cand < base - 1e-9::DOUBLE AS degraded FROM c WHERE cand < base - 1e-9::DOUBLE")
def e8(spark, d):
    base = metrics(*_results(spark, d)).select("qid", F.col("ndcg").alias("base"))
    cand = base.select("qid", F.when(F.col("qid") % 7 == 0, F.col("base") * 0.5).otherwise(F.col("base")).alias("cand"))
    return regressions(base, cand)


def regressions(base, cand):
    """Queries that a candidate answers worse than the baseline; none may remain for a promotion."""
    worse = F.col("cand") < F.col("base") - 1e-9
    return base.join(cand, "qid").where(worse).select("qid", "base", "cand", worse.alias("degraded"))


@query("e11_z9_bank_gate", f"WITH {METRICS}, s AS (SELECT avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END) FILTER (qid % 2 = 0) AS a, avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END) FILTER (qid % 2 = 1) AS b FROM met) SELECT round(a, 6) AS bank_a, round(b, 6) AS bank_b, abs(a - b) <= 0.05 AS within, CASE WHEN abs(a - b) <= 0.05 THEN 'promote' ELSE 'hold' END AS decision FROM s")
def e11(spark, d):
    h = F.when(F.col("hit"), 1.0).otherwise(0.0)
    s = metrics(*_results(spark, d)).agg(F.avg(F.when(F.col("qid") % 2 == 0, h)).alias("a"), F.avg(F.when(F.col("qid") % 2 == 1, h)).alias("b"))
    ok = F.abs(F.col("a") - F.col("b")) <= 0.05
    return s.select(F.round("a", 6).alias("bank_a"), F.round("b", 6).alias("bank_b"), ok.alias("within"), F.when(ok, "promote").otherwise("hold").alias("decision"))


@query("e13_relation_accuracy", "WITH g AS (SELECT ps AS pair, lower(regexp_replace(p_name, '\\s+', '', 'g')) AS a, lower(regexp_replace(p_brand, '\\s+', '', 'g')) AS b FROM (SELECT *, p_partkey AS ps FROM part)) SELECT pair, contains(a, b) OR contains(b, a) AS matched FROM g")
def e13(spark, d):
    a, b = F.lower(F.regexp_replace("p_name", r"\s+", "")), F.lower(F.regexp_replace("p_brand", r"\s+", ""))
    return table(spark, d, "part").select(F.col("p_partkey").alias("pair"), (F.contains(a, b) | F.contains(b, a)).alias("matched"))


@query("e14_z6_baseline_upsert", "WITH old AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id % 3 AS source, 0 AS n FROM events WHERE user_id % 2 = 0), new AS (SELECT CAST(ts AS DATE) AS day, user_id % 3 AS source, count(*) AS n FROM events WHERE user_id % 5 = 0 GROUP BY 1, 2) SELECT day, source, n FROM old ANTI JOIN new USING (day, source) UNION ALL SELECT * FROM new")
def e14(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("date").alias("day"), (F.col("user_id") % 3).alias("source"), "user_id")
    old = e.where("user_id % 2 = 0").select("day", "source", F.lit(0).cast("long").alias("n")).distinct()
    new = e.where("user_id % 5 = 0").groupBy("day", "source").agg(F.count("*").alias("n"))
    return old.join(new, ["day", "source"], "left_anti").unionByName(new)


@query("r24_shadow", "WITH a AS (SELECT user_id AS qid, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events QUALIFY r <= 5), b AS (SELECT user_id AS qid, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY value * CASE WHEN event_type = 'view' THEN 2 ELSE 1 END DESC, event_id) AS r FROM events QUALIFY r <= 5) SELECT coalesce(a.qid, b.qid) AS qid, count(a.id) FILTER (b.id IS NOT NULL) AS kept, count(*) FILTER (a.id IS NULL) AS gained, count(*) FILTER (b.id IS NULL) AS lost FROM a FULL JOIN b ON a.qid = b.qid AND a.id = b.id GROUP BY 1")
def r24(spark, d):
    e = table(spark, d, "events")

    def top(score):
        return R.ranked(e.select(F.col("user_id").alias("qid"), F.col("event_id").alias("id"), score.alias("s")), F.desc("s"), F.col("id"), limit=5).select("qid", "id")

    a, b = top(F.col("value")).withColumn("a", F.lit(1)), top(F.col("value") * F.when(F.col("event_type") == "view", 2).otherwise(1)).withColumn("b", F.lit(1))
    return a.join(b, ["qid", "id"], "full").groupBy("qid").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("kept"), F.count_if(F.col("a").isNull()).alias("gained"), F.count_if(F.col("b").isNull()).alias("lost"))
