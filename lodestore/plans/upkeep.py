"""Queries of upkeep: tuning gates, regression logs, anchors, distilling, whole promotion, layers and the register, audit summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import NOW, Search
from ..functions import extract as X
from ..functions import lifecycle as LC
from ..functions.text import used
from ..operators import distill as D
from ..operators import retrieval as R
from ..operators import tuning as T
from ..operators.containment import holding
from ..registry import query
from ..scratch import saved, scratch_path
from ..sources import layers as LY
from ..sources import scanners as SC
from .common import STORE, bench_queries, entry_vectors, query_vectors, store, table, text_index
from .evaluation import GRID, METRICS, _results, metrics
from .retrieval import BENCH_QUERIES, FTS, VECTORS
from .scalars import TYPE_CASE

CURRENT, BASELINE = GRID.index((1.5, 0.7)), GRID.index((1.0, 1.0))
TUNED = f"""WITH {STORE}, {BENCH_QUERIES}, {FTS}, {VECTORS},
gold AS (SELECT item_id AS qid, concat('m', lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
grid AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}::DOUBLE, {b}::DOUBLE)' for i, (a, b) in enumerate(GRID))}) t(g, wf, we)),
parts AS (SELECT qid, id, rank0, 'f' AS c FROM fts UNION ALL SELECT qid, id, rank0, 'e' FROM emb),
e AS (SELECT g, qid, id, round(sum(1.0::DOUBLE / (60 + rank0 / CASE WHEN c = 'f' THEN wf ELSE we END + 1)), 9) AS s FROM parts, grid WHERE qid IN (SELECT qid FROM gold) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY g, qid ORDER BY s DESC, id) - 1 AS rank0 FROM e QUALIFY rank0 < 5),
h AS (SELECT g, qid, sum(1.0::DOUBLE / (rank0 + 2)) AS gain FROM r JOIN (SELECT DISTINCT * FROM gold) USING (qid, id) GROUP BY ALL),
n AS (SELECT qid, count(DISTINCT id) AS n FROM gold GROUP BY qid),
per AS (SELECT a.g, a.qid, round(coalesce(gain, 0) / list_sum(list_transform(range(1, least(5, n) + 1), lambda i: 1.0::DOUBLE / (i + 1))), 6) AS ndcg FROM (SELECT g, qid, n FROM grid, n) a LEFT JOIN h ON h.g = a.g AND h.qid = a.qid),
means AS (SELECT g, round(avg(ndcg), 6) AS train FROM per WHERE qid % 5 <> 0 AND g <> {BASELINE} GROUP BY g),
best AS (SELECT g AS candidate, train AS train_ndcg FROM means ORDER BY train DESC, g LIMIT 1),
two AS (SELECT a.qid, a.ndcg AS now, b.ndcg AS later FROM per a JOIN per b ON a.qid = b.qid AND a.g = {CURRENT} AND b.g = (SELECT candidate FROM best)),
gate AS (SELECT round(avg(now) FILTER (qid % 5 = 0), 6) AS val_current, round(avg(later) FILTER (qid % 5 = 0), 6) AS val_candidate, count(*) FILTER (qid % 5 = 0 AND later < now - 1e-9) AS degraded, count(*) FILTER (qid % 7 = 0 AND later < now - 1e-9) AS history_degraded FROM two)
SELECT candidate, train_ndcg, val_current, val_candidate, degraded, history_degraded, CASE WHEN candidate = {CURRENT} THEN 'no_change' WHEN val_candidate >= val_current - 1e-9 AND degraded = 0 AND history_degraded = 0 THEN 'gate_pass' ELSE 'gate_fail' END AS decision FROM best, gate"""


@query("e7_tuning_gate", TUNED)
def tuning_gate(spark, d):
    """The best weights of the grid by four fifths of the questions, held against the current ones on the last and on those of earlier regressions."""
    cfg, s, items = Search(), store(spark, d), table(spark, d, "benchmark")
    fts = R.cascade(R.best_bm25(bench_queries(spark, d), text_index(spark, d), cfg), cfg)
    emb = R.vectors(query_vectors(spark, d), entry_vectors(spark, d), cfg)
    gold = saved(holding(s, "id", "content", items.select(F.col("item_id").alias("qid"), F.col("text").alias("gt")), "qid", "gt"), "golden")
    scores = saved(T.scored_grid({"f": fts, "e": emb}, gold, GRID), "grid-scores")
    history = items.where("item_id % 7 = 0").select(F.col("item_id").alias("qid"))
    return T.tuned(scores, CURRENT, BASELINE, F.col("qid") % 5 != 0, history)


@query("e8_past_regressions", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS qid FROM events WHERE event_type = 'error' AND value > 40")
def past_regressions(spark, d):
    """Users with errors as the regressions that monthly runs, one a day of the log, have told of."""
    path = scratch_path(spark, "monthly-log")
    e = table(spark, d, "events").where("event_type = 'error' and value > 40")
    detail = F.collect_list(F.struct(F.col("user_id").cast("string").alias("id"), F.round("value", 2).alias("ndcg")))
    e.groupBy(F.col("ts").cast("date").cast("string").alias("month")).agg(detail.alias("regress_detail")).select(F.to_json(F.struct("month", "regress_detail"))).write.text(path)
    return T.past_regressions(spark.read.text(path))


@query("e9_monthly_gate", f"WITH {METRICS}, later AS (SELECT qid, CASE WHEN qid % 9 = 0 THEN ndcg * 0.9::DOUBLE ELSE ndcg END AS ndcg, precision FROM met), b AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 20 <> 0), c AS (SELECT count(*) AS n FROM orders) SELECT round(avg(m.ndcg), 6) AS ndcg_before, round(avg(l.ndcg), 6) AS ndcg_now, round(avg(m.precision), 6) AS p5_before, round(avg(l.precision), 6) AS p5_now, count(*) FILTER (l.ndcg < m.ndcg - 1e-9) AS worse, false AS corpus_drift, false AS weights_drift, 'block' AS decision FROM met m JOIN later l USING (qid)")
def monthly(spark, d):
    """This month's figures, some questions worse, against last month's on nine tenths of the orders and more."""
    base = metrics(*_results(spark, d)).select("qid", "ndcg", F.col("precision").alias("p5"))
    now = base.withColumn("ndcg", F.when(F.col("qid") % 9 == 0, F.col("ndcg") * 0.9).otherwise(F.col("ndcg")))
    o = table(spark, d, "orders")
    weights = Search().weights
    return T.monthly_gate(base, now, o.where("o_orderkey % 20 <> 0").count(), o.count(), weights, dict(weights))


@query("z10_anchors", "WITH c AS (SELECT item_id AS qid, unnest([item_id, item_id + 1, item_id + 2]) AS v FROM benchmark), a AS (SELECT qid, embedding AS avec FROM c JOIN embeddings ON vec_id = v), s AS (SELECT a.qid, round(list_sum(list_transform(list_zip(e.embedding, a.avec), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(a.avec, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) + 1e-9::DOUBLE), 6) AS s FROM a JOIN embeddings e ON e.vec_id = CASE WHEN a.qid % 3 = 0 THEN a.qid + 2 ELSE a.qid + 5 END) SELECT q.qid, coalesce(max(s), 0) AS best, coalesce(max(s), 0) >= 0.65 AS hit FROM (SELECT DISTINCT qid FROM a) q LEFT JOIN s USING (qid) GROUP BY q.qid")
def anchors(spark, d):
    """Each item's case has three anchors, and an answer that is one of them or not."""
    e = table(spark, d, "embeddings")
    cases = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array(*[F.col("item_id") + i for i in range(3)])).alias("vec_id")).join(e, "vec_id").select("qid", F.col("vec_id").alias("anchor"), F.col("embedding").alias("avec"))
    answer = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.when(F.col("item_id") % 3 == 0, F.col("item_id") + 2).otherwise(F.col("item_id") + 5).alias("vec_id"))
    return T.anchored(cases, answer.join(e, "vec_id").select("qid", F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))


PATTERNS = "top AS (SELECT * FROM store WHERE confidence > 0.6 AND type <> 'L4b' ORDER BY confidence DESC, id LIMIT 500), g AS (SELECT source_agent, count(*) AS n, round(avg(confidence), 6) AS confidence, arg_max(summary, (confidence, length(summary), id)) AS summary, list_slice(list_sort(list(id)), 1, 5) AS refs FROM top GROUP BY source_agent HAVING count(*) >= 3)"


@query("p11_distilled", f"WITH {STORE}, {PATTERNS} SELECT substr(md5('l4b_' || source_agent || '_' || summary), 1, 16) AS id, 'L4b' AS type, summary, source_agent, confidence, CAST(least(10, 5 + n // 5) AS INT) AS importance, '{NOW}' AS timestamp, '[\"' || array_to_string(refs, '\",\"') || '\"]' AS references_ FROM g")
def distilled(spark, d):
    return D.distilled(D.patterns(store(spark, d)), NOW).withColumnRenamed("references", "references_")


@query("p11_p24_distill_run")
def distill_run(spark, d):
    """One run of the chain over the store: what is distilled is held against every stored summary."""
    return D.distill_run(store(spark, d), NOW, "2026-08-02T00:00:00Z")


@query("p2_whole_promotion", f"WITH {STORE}, two AS (SELECT * FROM store WHERE doc_id % 3 <> 0), three AS (SELECT * FROM store WHERE doc_id % 3 = 0), n AS (SELECT *, count(*) OVER (PARTITION BY source_agent, summary_hash) AS n FROM two), c AS (SELECT *, CASE WHEN confidence >= 0.8 THEN 'confidence' WHEN n >= 2 THEN 'repeat' WHEN contains(content, '记住') THEN 'keyword' END AS reason FROM n), o AS (SELECT * FROM c WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY summary_hash ORDER BY id) = 1), h AS (SELECT summary_hash, min(id) AS target, list(DISTINCT type) AS types FROM three GROUP BY 1), k AS (SELECT o.*, target, types, CASE WHEN target IS NULL THEN 'insert' ELSE 'update' END AS op FROM o LEFT JOIN h USING (summary_hash)) SELECT id, op, coalesce(target, id) AS target, reason, CASE WHEN type IN ('fact', 'correction') THEN '2026-11-30T00:00:00Z' WHEN type IN ('record', 'info', 'context') THEN '2026-10-01T00:00:00Z' ELSE '' END AS expires_at, CASE WHEN target IS NULL THEN 'independent' WHEN list_contains(types, type) THEN 'extension' ELSE 'conflict' END AS conflict_type, '{{\"at\":\"{NOW}\",\"op\":\"' || op || '\",\"reason\":\"' || reason || '\"}}' AS audit FROM k")
def whole_promotion(spark, d):
    """Promotion with all that an entry is written with; the days that texts tell of are left to the tests."""
    s = store(spark, d)
    return D.promotion(s.where("doc_id % 3 <> 0"), s.where("doc_id % 3 = 0"), NOW).drop("event_date").withColumnRenamed("into", "target")


@query("s10_k5_layers", f"WITH {STORE} SELECT source_agent AS agent, id, CASE WHEN doc_id % 2 = 0 THEN summary ELSE summary || ' (second)' END AS summary FROM store WHERE source_agent = 'src1'")
def layers(spark, d):
    """One agent's part of a layer that was written in two batches, the second of which repeats the first with other texts."""
    root = scratch_path(spark, "layer")
    s = store(spark, d).select(F.col("source_agent").alias("agent"), "id", "summary", "doc_id")
    LY.write_layer(s.where("doc_id % 2 = 0").drop("doc_id"), root)
    LY.write_layer(s.withColumn("summary", F.concat("summary", F.lit(" (second)"))).drop("doc_id"), root)
    return LY.read_layer(spark, root, "src1").select("agent", "id", "summary")


def _registered(spark, d):
    path, names = scratch_path(spark, "register"), LY.REGISTER.names[:-1]
    docs = table(spark, d, "documents")
    own = docs.where("source is not null").select(F.col("source").alias("source_id"), F.col("lang").alias("tier"), *[F.lit(c).alias(c) for c in names[2:]]).distinct()
    LY.register(own.where("source_id < 'src3'"), path, "first")
    return LY.register(own.where("source_id < 'src5'"), path, "second")


@query("s14_register", "SELECT source AS source_id, min(lang) AS tier, CASE WHEN source < 'src3' THEN 'first' ELSE 'second' END AS registered_at FROM documents WHERE source < 'src5' GROUP BY source")
def register(spark, d):
    """Sources put on the register in two runs: each once, by the run that first named it."""
    return _registered(spark, d).select("source_id", "tier", "registered_at")


@query("s13_s14_unregistered", "SELECT doc_id, source FROM documents WHERE source IS NULL OR source >= 'src5'")
def unregistered(spark, d):
    """Documents that a sink refuses, as the register lacks their source."""
    return LY.unregistered(table(spark, d, "documents").select("doc_id", "source"), _registered(spark, d), "source")


@query("a9_bottom_five", "WITH g AS (SELECT user_id AS agent, count(*) AS events, count(*) FILTER (event_type <> 'error') AS passed FROM events GROUP BY 1) SELECT agent, events, passed, round(100.0 * passed / events, 2) AS pass_pct, events - passed AS failed FROM g ORDER BY round(100.0 * passed / events, 2), agent LIMIT 5")
def bottom_five(spark, d):
    """The five agents that pass least often."""
    ok = F.count_if(F.col("event_type") != "error")
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("agent")).agg(F.count("*").alias("events"), ok.alias("passed"), F.round(100.0 * ok / F.count("*"), 2).alias("pass_pct"))
    return g.withColumn("failed", F.col("events") - F.col("passed")).orderBy("pass_pct", "agent").limit(5)


@query("a16_layers_and_relations", "WITH e AS (SELECT DISTINCT least(l_partkey, l_suppkey + 100000) AS id1, greatest(l_partkey, l_suppkey + 100000) AS id2, CASE WHEN l_quantity >= 40 THEN 'heavy' WHEN l_quantity >= 20 THEN 'middle' ELSE 'light' END AS relation FROM lineitem), ends AS (SELECT relation, id1 AS e FROM e UNION SELECT relation, id2 FROM e), known AS (SELECT p_partkey AS e FROM part UNION ALL SELECT s_suppkey + 100000 FROM supplier WHERE s_suppkey % 2 = 0), r AS (SELECT relation, count(*) AS edges FROM e GROUP BY 1), c AS (SELECT relation, count(*) AS ends, count(k.e) AS known, count(*) - count(k.e) AS dangling FROM ends LEFT JOIN known k USING (e) GROUP BY 1) SELECT relation, edges, ends, known, dangling, round(100.0 * known / ends, 2) AS coverage_pct FROM r JOIN c USING (relation)")
def relations(spark, d):
    """Edges of each relation, what stands at their ends, how much of it is known, and how much is left hanging."""
    lines = table(spark, d, "lineitem")
    kind = F.when(F.col("l_quantity") >= 40, "heavy").when(F.col("l_quantity") >= 20, "middle").otherwise("light")
    a, b = F.col("l_partkey"), F.col("l_suppkey") + 100000
    e = lines.select(F.least(a, b).alias("id1"), F.greatest(a, b).alias("id2"), kind.alias("relation")).distinct()
    ends = e.select("relation", F.explode(F.array("id1", "id2")).alias("e")).distinct()
    known = table(spark, d, "part").select(F.col("p_partkey").alias("e")).union(table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey") + 100000)).withColumn("k", F.lit(1))
    c = ends.join(known, "e", "left").groupBy("relation").agg(F.count("*").alias("ends"), F.count("k").alias("known"), F.count_if(F.col("k").isNull()).alias("dangling"))
    return e.groupBy("relation").agg(F.count("*").alias("edges")).join(c, "relation").withColumn("coverage_pct", F.round(100.0 * F.col("known") / F.col("ends"), 2))


@query("p12_used_turns", "WITH t AS (SELECT conv_id, turn, trim(substr(text, 1, 8)) AS entry, text FROM conversations), n AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations) SELECT conv_id, turn, contains(lower(answer), lower(entry)) AS used FROM t JOIN n USING (conv_id, turn) WHERE entry <> ''")
def used_turns(spark, d):
    """Whether the beginning of a turn comes back in the turn behind it."""
    c = table(spark, d, "conversations")
    t = c.select("conv_id", "turn", F.trim(F.substring("text", 1, 8)).alias("entry")).where("entry <> ''")
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return t.join(n, ["conv_id", "turn"]).select("conv_id", "turn", used(F.col("entry"), F.col("answer")).alias("used"))


def _tree(spark, d):
    """Documents as the files of a tree: a fifth each as skills, plain files of one folder, configurations of profiles, and documents under a hidden or a set-aside folder."""
    i, name = F.col("doc_id"), F.col("doc_id").cast("string")
    path = (
        F.when(i % 5 == 0, F.concat(F.lit("/tree/skills/"), F.when(i % 15 == 0, ".").otherwise(""), F.lit("s"), name, F.lit("/SKILL.md")))
        .when(i % 5 == 1, F.concat(F.lit("/tree/docs/f"), name, F.when(i % 2 == 0, ".md").otherwise(".sh")))
        .when(i % 5 == 2, F.concat(F.lit("/tree/profiles/p"), name, F.lit("/config.yaml")))
        .when(i % 5 == 3, F.concat(F.lit("/tree/conf/"), F.col("source"), F.lit("/方案"), name, F.lit(".md")))
        .otherwise(F.concat(F.lit("/tree/conf/"), F.when(i % 2 == 0, "backup").otherwise("live"), F.lit("/报告"), name, F.when(i % 3 == 0, ".yaml").otherwise(".html")))
    )
    return table(spark, d, "documents").where("source is not null").select(F.concat(F.lit("file:"), path).alias("path"), F.col("text").alias("value"))


@query("s15a_skills", "SELECT 'skill' AS type, 's' || doc_id AS name, '/tree/skills/s' || doc_id || '/SKILL.md' AS source_ref FROM documents WHERE source IS NOT NULL AND doc_id % 5 = 0 AND doc_id % 15 <> 0")
def skills(spark, d):
    """Skill folders, hidden ones left out."""
    return SC.skills(_tree(spark, d), "/tree/skills").select("type", "name", "source_ref")


@query("s15d_workflows", "SELECT 'workflow' AS type, 's' || doc_id AS name, '/tree/skills/s' || doc_id || '/SKILL.md' AS source_ref FROM documents WHERE source IS NOT NULL AND doc_id IN (5, 10, 20) UNION ALL SELECT 'workflow', 'f' || doc_id, '/tree/docs/f' || doc_id || '.md' FROM documents WHERE source IS NOT NULL AND doc_id % 5 = 1 AND doc_id % 2 = 0")
def workflows(spark, d):
    """Named skills and the Markdown files of one folder."""
    return SC.workflows(_tree(spark, d), "/tree/skills", ("s5", "s10", "s20"), "/tree/docs").select("type", "name", "source_ref")


LISTED = "w AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'rule' WHEN 1 THEN 'monitor' WHEN 2 THEN 'benchmark' ELSE 'script' END AS type, 'n' || c_custkey AS name, '/tree/docs/f' || c_custkey || '.sh' AS path FROM customer), t AS (SELECT '/tree/docs/f' || doc_id || '.sh' AS path, doc_id FROM documents WHERE source IS NOT NULL AND doc_id % 5 = 1 AND doc_id % 2 = 1)"


@query("s15e_s15f_s15g_listed", f"WITH {LISTED} SELECT type, name, path AS source_ref FROM w JOIN t USING (path) WHERE doc_id % 3 <> 0")
def listed(spark, d):
    """Listed rules, monitors, benchmarks and scripts that exist and have no entry of another type yet."""
    c = table(spark, d, "customer")
    kind = F.element_at(F.array(F.lit("rule"), F.lit("monitor"), F.lit("benchmark"), F.lit("script")), (F.col("c_custkey") % 4 + 1).cast("int"))
    wanted = c.select(kind.alias("type"), F.concat(F.lit("n"), "c_custkey").alias("name"), F.concat(F.lit("/tree/docs/f"), "c_custkey", F.lit(".sh")).alias("path"), F.lit("hint").alias("hint"))
    taken = table(spark, d, "documents").where("doc_id % 3 = 0").select(F.concat(F.lit("/tree/docs/f"), "doc_id", F.lit(".sh")).alias("source_ref"))
    return SC.listed(_tree(spark, d), wanted, taken).select("type", "name", "source_ref")


@query("s15j_folders", "WITH n AS (SELECT '/tree/conf/' || source AS path, count(*) AS n FROM documents WHERE doc_id % 5 = 3 AND source IS NOT NULL GROUP BY 1) SELECT 'research' AS type, s.source AS name, 'notes；含 ' || n.n || ' 个文件（目录级）' AS told, n.path AS source_ref FROM n JOIN (SELECT DISTINCT source FROM documents) s ON n.path = '/tree/conf/' || s.source")
def folders(spark, d):
    """Listed folders with the number of what stands in them."""
    wanted = table(spark, d, "documents").where("source is not null").select(F.lit("research").alias("type"), F.col("source").alias("name"), F.concat(F.lit("/tree/conf/"), "source").alias("path"), F.lit("notes").alias("hint")).distinct()
    told = F.regexp_replace("summary", "^[^：]*：", "")
    return SC.folders(_tree(spark, d), wanted).select("type", "name", told.alias("told"), "source_ref")


@query("s15l_profiles", "SELECT 'config' AS type, 'profiles：config.yaml；含 ' || count(*) || ' 个 profile config（目录级）' AS summary, '/tree/profiles' AS source_ref FROM documents WHERE source IS NOT NULL AND doc_id % 5 = 2")
def profiles(spark, d):
    return SC.profiles(_tree(spark, d), "/tree/profiles", "profiles").select("type", "summary", "source_ref")


@query("s15i_s15m_s15n_config_documents", "SELECT 'design' AS type, '方案' || doc_id AS name, '/tree/conf/' || source || '/方案' || doc_id || '.md' AS source_ref FROM documents WHERE source IS NOT NULL AND doc_id % 5 = 3 UNION ALL SELECT CASE WHEN doc_id % 3 = 0 THEN 'config' ELSE 'research' END, '报告' || doc_id, '/tree/conf/live/报告' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.yaml' ELSE '.html' END FROM documents WHERE source IS NOT NULL AND doc_id % 5 = 4 AND doc_id % 2 = 1")
def config_documents(spark, d):
    """Documents below a folder, typed by extension and name; set-aside folders are left out."""
    return SC.config_documents(_tree(spark, d), "/tree/conf").select("type", "name", "source_ref")


@query("s15h_models", "SELECT 'asset' AS type, CASE WHEN doc_id % 2 = 0 THEN 'f' || doc_id ELSE 'f' || doc_id || '.sh' END AS name, '/tree/docs/f' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.sh' END AS source_ref FROM documents WHERE source IS NOT NULL AND doc_id % 5 = 1")
def models(spark, d):
    """Documents and scripts of a folder of models."""
    return SC.models(_tree(spark, d), "/tree/docs").select("type", "name", "source_ref")


AXES = f"""WITH {STORE}, c AS (SELECT doc_id, unnest(string_split(substr(summary, 1, 500), '')) AS ch FROM store), k AS (SELECT doc_id, ch, count(*) AS n FROM c GROUP BY ALL), h AS (SELECT doc_id, sum(n) AS len, count(*) AS kinds FROM k GROUP BY doc_id),
e AS (SELECT k.doc_id, CASE WHEN any_value(kinds) > 1 THEN -sum((n / len::DOUBLE) * log2(n / len::DOUBLE)) / log2(least(any_value(len), any_value(kinds))::DOUBLE) ELSE 0 END AS entropy FROM k JOIN h ON h.doc_id = k.doc_id GROUP BY k.doc_id),
a AS (SELECT id, confidence, 0.4::DOUBLE * coalesce(entropy, 0) + 0.3::DOUBLE * least(1.0, log2(1.0 + length(summary)) / log2(501.0)) + 0.3::DOUBLE * {TYPE_CASE} AS c,
 0.25::DOUBLE * CASE s.doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.3 END + 0.25::DOUBLE * CASE s.doc_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 0.3 END + 0.25::DOUBLE * CASE WHEN expires_at = '' THEN 0.7 WHEN expires_at > '{NOW}' THEN 1.0 ELSE 0.1 END
 + 0.25::DOUBLE * CASE WHEN 1788220800 - ts <= 86400 THEN 1.0 WHEN 1788220800 - ts <= 604800 THEN 0.8 WHEN 1788220800 - ts <= 2592000 THEN 0.6 ELSE 0.4 END AS s,
 CASE WHEN importance > 8 OR s.doc_id % 11 > 8 THEN 1 ELSE 0 END AS peak, CASE WHEN g1_check_passed = 1 THEN 1 ELSE 0 END AS fin FROM store s LEFT JOIN e USING (doc_id))
SELECT id, round(c, 6) AS complexity, round(s, 6) AS stability, peak, fin, round(least(10.0, CASE WHEN confidence >= 0.9 THEN 8 WHEN confidence >= 0.7 THEN 6 WHEN confidence >= 0.5 THEN 4 ELSE 2 END + peak + fin + c + s), 6) AS score FROM a"""


@query("x25_x26_whole_axes", AXES)
def whole_axes(spark, d):
    """Both axes with all their terms, the anchors and the score."""
    i = F.col("doc_id")
    proof = F.when(i % 3 == 0, "verified").when(i % 3 == 1, "pending")
    label = F.when(i % 4 == 0, "auto").when(i % 4 == 1, "reviewer").when(i % 4 == 2, "l3_missing")
    c = LC.complexity_axis(F.col("summary"), F.col("type"))
    s = LC.stability_axis(proof, label, F.col("expires_at"), F.col("timestamp"), F.lit(NOW))
    peak = LC.peak_anchor(F.col("importance") - 6, F.lit(None).cast("int"), F.when(i % 11 > 8, 2), F.lit(None).cast("boolean"))
    end = LC.end_anchor(F.lit(""), F.lit(None).cast("boolean"), F.col("g1_check_passed") == 1)
    score = LC.dual_axis_score(F.col("confidence"), c, s, peak, end)
    return store(spark, d).select("id", F.round(c, 6).alias("complexity"), F.round(s, 6).alias("stability"), peak.alias("peak"), end.alias("fin"), F.round(score, 6).alias("score"))


@query("x5_asked_window", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01') WHEN 2 THEN strftime(least(o_orderdate, o_orderdate + INTERVAL (o_custkey % 50 - 25) DAY), '%Y-%m-%d') END AS t1, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01') WHEN 2 THEN strftime(greatest(o_orderdate, o_orderdate + INTERVAL (o_custkey % 50 - 25) DAY), '%Y-%m-%d') END AS t2 FROM orders")
def asked_window(spark, d):
    """Days and months of questions: one day, a month, two days in either order, none."""
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 4
    other = F.date_add(day, (F.col("o_custkey") % 50 - 25).cast("int"))
    text = (
        F.when(k == 0, F.concat(F.lit("what came on "), F.date_format(day, "yyyy/M/d"), F.lit(" of it")))
        .when(k == 1, F.concat(F.date_format(day, "yyyy"), F.lit("年"), F.date_format(day, "M"), F.lit("月 的订单")))
        .when(k == 2, F.concat(F.lit("从 "), F.date_format(day, "yyyy-MM-dd"), F.lit(" 到 "), F.date_format(other, "yyyy年M月d日")))
        .otherwise(F.concat(F.lit("order 12345-67 of "), F.col("o_custkey").cast("string"), F.lit(" in 1869-13")))
    )
    t1, t2 = X.asked_window(text)
    return table(spark, d, "orders").select("o_orderkey", t1.alias("t1"), t2.alias("t2"))
