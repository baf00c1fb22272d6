"""Queries of what checks answers, and of what the archive, promotions, reports and federated sources give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions.text import overlap, tokens
from ..operators import answers as W
from ..operators import archive as A
from ..operators import distill as D
from ..operators import embedding as E
from ..operators import retrieval as R
from ..operators.containment import holding
from ..registry import query
from ..scratch import saved
from ..sources import reports as P
from .common import NOW, STORE, bench_queries, entry_vectors, query_vectors, store, table, text_index
from .retrieval import BENCH_QUERIES, CFG, FTS, FUSED, INDEX, VECTORS, multi_hop

KNOWN = ("src0", "src1", "src2", "src3", "src5", "src8")
FACTOR = f"{CFG.weight_factor!r}::DOUBLE"
OVERLAP = "round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b)) / greatest(len(a), len(b))::DOUBLE END, 6)"


def _answers(spark, d):
    """The first five fused hits of each question, with what the rules look at; evidence is what question and summary have in common."""
    s, q = store(spark, d), bench_queries(spark, d)
    channels = {"fts": R.cascade(R.best_bm25(q, text_index(spark, d), CFG), CFG), "emb": R.vectors(query_vectors(spark, d), entry_vectors(spark, d), CFG)}
    hits = R.fused(channels, s, CFG).join(s.select("id", "source_agent", "confidence", "summary"), "id").join(q, "qid")
    evidence = F.round(overlap(F.array_distinct(tokens(F.col("text"))), F.array_distinct(tokens(F.col("summary")))), 6)
    mode = F.when(F.col("n_channels") > 1, "dual_rrf").when(F.col("only") == "fts", "fts_only").otherwise("embed_only")
    # questions with even numbers have been ranked anew, the others have no evidence
    return hits.select("qid", "id", "rank0", "score", mode.alias("mode"), "source_agent", "confidence", F.when(F.col("qid") % 2 == 0, evidence).alias("evidence"))


ANSWERS = f"""WITH {STORE}, {BENCH_QUERIES}, {FTS}, {VECTORS}, {FUSED},
h AS (SELECT f.qid, f.id, rank0, f.score, CASE WHEN n_channels > 1 THEN 'dual_rrf' WHEN only_one = 'fts' THEN 'fts_only' ELSE 'embed_only' END AS mode, trim(coalesce(source_agent, '')) AS agent, s.confidence,
 list_distinct(regexp_extract_all(lower(q.text), '[\\p{{L}}\\p{{N}}]+')) AS a, list_distinct(regexp_extract_all(lower(s.summary), '[\\p{{L}}\\p{{N}}]+')) AS b FROM fused f JOIN store s USING (id) JOIN queries q ON q.qid = f.qid),
g AS (SELECT qid, round(max(score * {FACTOR}), 9) AS best, max(CASE WHEN qid % 2 = 0 THEN {OVERLAP} END) AS evidence, max(agent) FILTER (rank0 = 0) AS agent, bool_or(mode = 'fts_only') AS words, count(*) FILTER (rank0 < 5 AND confidence < 0.8) AS unsure FROM h GROUP BY qid),
j AS (SELECT q.qid, coalesce(best, 0) AS best, evidence, agent, coalesce(unsure, 0) AS unsure, coalesce(words, false) AS words FROM (SELECT DISTINCT qid FROM queries) q LEFT JOIN g USING (qid)),
r AS (SELECT *, CASE WHEN words THEN [] ELSE list_filter([CASE WHEN best < 0.01 THEN 'relevance_refuse' WHEN best < 0.03 THEN 'relevance_mark' END, CASE WHEN evidence < 0.10 THEN 'evidence_refuse' END, CASE WHEN agent <> '' AND agent NOT IN {KNOWN} THEN 'source_domain_unknown' WHEN agent = '' THEN 'source_domain_empty' END, CASE WHEN unsure > 0 THEN 'low_confidence' END], lambda x: x IS NOT NULL) END AS rs FROM j),
c AS (SELECT qid, best, array_to_string(rs, ',') AS reasons, len(list_filter(rs, lambda x: x LIKE '%\\_refuse' ESCAPE '\\')) > 0 AS would_block, CASE WHEN words THEN 'skipped' WHEN len(list_filter(rs, lambda x: x LIKE '%\\_refuse' ESCAPE '\\')) > 0 THEN 'refuse' WHEN len(rs) > 0 THEN 'mark' ELSE 'pass' END AS action FROM r)"""


@query("r20_checked_answers", ANSWERS + " SELECT qid, action, reasons, would_block, best FROM c")
def checked(spark, d):
    c = W.checked_answers(bench_queries(spark, d), _answers(spark, d), CFG, KNOWN)
    return c.withColumn("reasons", F.array_join("reasons", ","))


@query("r20_enforced", ANSWERS + " SELECT h.qid, id, rank0, action = 'mark' AND confidence < 0.8 AS low_confidence FROM h JOIN c USING (qid) WHERE action <> 'refuse'")
def enforced(spark, d):
    hits = saved(_answers(spark, d), "answers")  # read for the rules and for what they leave
    return W.enforced(hits, W.checked_answers(bench_queries(spark, d), hits, CFG, KNOWN)).select("qid", "id", "rank0", "low_confidence")


@query("r21_certified_judges", "WITH s AS (SELECT user_id % 5 AS judge, event_type IN ('purchase', 'signup') AS positive, (CAST(round(value * 100) AS BIGINT) // 10 + CASE WHEN event_type IN ('purchase', 'signup') THEN (user_id % 5) * 200 ELSE 0 END) / 10000::DOUBLE AS score, event_id FROM events), r AS (SELECT *, rank() OVER (PARTITION BY judge ORDER BY score) + (count(*) OVER (PARTITION BY judge, score) - 1) / 2.0::DOUBLE AS k FROM s), a AS (SELECT judge, round((sum(k) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2.0::DOUBLE) / (count(*) FILTER (positive) * count(*) FILTER (NOT positive)), 6) AS auroc FROM r GROUP BY judge) SELECT judge, auroc, auroc >= 0.7 AS certified, count(*) FILTER (auroc >= 0.7 AND score >= 0.05) AS good, count(*) FILTER (auroc >= 0.7) AS graded FROM s JOIN a USING (judge) GROUP BY ALL")
def certified(spark, d):
    """Five judges, each better than the one before, prove themselves on labelled rows; the others grade nothing."""
    e, right = table(spark, d, "events"), F.col("event_type").isin("purchase", "signup")
    judge = F.col("user_id") % 5
    s = e.select(judge.alias("judge"), right.alias("positive"), ((F.expr("cast(round(value * 100) as bigint) div 10") + F.when(right, judge * 200).otherwise(0)) / 10000.0).alias("score"))
    proven = W.judges(s)
    graded = W.graded_by(s, proven).groupBy("judge").agg(F.count_if(F.col("grade").isin("strong", "medium")).alias("good"), F.count("grade").alias("graded"))
    return proven.join(graded, "judge").select("judge", "auroc", "certified", "good", "graded")


@query("r10_window_channel", f"""WITH {STORE}, q AS (SELECT item_id AS qid, text, make_timestamp((1767225600 + item_id * 432000) * 1000000)::DATE AS t1, make_timestamp((1767225600 + item_id * 432000 + (item_id % 40) * 86400) * 1000000)::DATE AS t2 FROM benchmark),
n AS (SELECT qid, text, t1, t2, s.id, event_date, summary || ' ' || content AS whole FROM q JOIN store s ON event_date BETWEEN t1 AND t2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY event_date DESC, s.id) <= 15),
w AS (SELECT *, list_distinct(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}|[\\p{{L}}\\p{{N}}_]+')) AS ws FROM n),
c AS (SELECT qid, id, round(0.05::DOUBLE + 0.85::DOUBLE * greatest(0.0, 1 - (event_date - t1) / greatest(t2 - t1, 1)::DOUBLE) + 0.10::DOUBLE * (len(list_filter(ws, lambda x: contains(whole, x))) / greatest(len(ws), 1)::DOUBLE), 9) AS score FROM w)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank0 FROM c""")
def window(spark, d):
    """Whole items as questions, each of a window of up to 39 days."""
    at = F.col("item_id") * 432000 + 1767225600
    day = lambda seconds: F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text", day(at).alias("t1"), day(at + (F.col("item_id") % 40) * 86400).alias("t2"))
    return R.window_channel(q, store(spark, d), CFG)


QUESTIONS = "SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN '，为什么 cron 还是 launchd' WHEN 1 THEN ' 和 SQLite 的区别' WHEN 2 THEN '如何备份数据库，请' ELSE '' END AS q FROM conversations"
_NAMES = "list_filter(list_concat(regexp_extract_all(q, '[A-Za-z][A-Za-z0-9+#.\\-]*|\\d+(?:\\.\\d+)?'), list_transform(string_split_regex(q, '{sep}'), lambda s: trim(regexp_replace(trim(regexp_replace(s, '^(?:{ask})+', ''), '{around}'), '[A-Za-z0-9+#.\\-]', '', 'g'), '{around}'))), lambda s: length(s) >= 2)".format(sep=X.SUBJECTS.replace("\\\\", "\\"), ask=X.QUESTION, around=X.AROUND)


@query("x40_x41_questions", f"WITH t AS ({QUESTIONS}), n AS (SELECT conv_id, turn, q, list_sort(list_distinct({_NAMES})) AS names, regexp_matches(q, '{X.QUESTION}') AS asks, list_filter(regexp_extract_all(q, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}|[A-Za-z]{{3,}}'), lambda w: w NOT IN {X.EMPTY_WORDS}) AS words FROM t) SELECT conv_id, turn, CASE WHEN (len(names) >= 2 AND asks) OR len(names) >= 3 THEN 'complex' ELSE 'simple' END AS level, len(names) AS entities, asks AS question, sha256(array_to_string(names, '|')) AS names, len(words) AS n_words, words[-1] AS last_word FROM n")
def questions(spark, d):
    """Turns of conversations, three in four with a question behind them."""
    k = F.col("turn") % 4
    tail = F.when(k == 0, "，为什么 cron 还是 launchd").when(k == 1, " 和 SQLite 的区别").when(k == 2, "如何备份数据库，请").otherwise("")
    q = table(spark, d, "conversations").select("conv_id", "turn", F.concat("text", tail).alias("q"))
    words = X.content_words(F.col("q"))
    out = q.select("conv_id", "turn", X.question_complexity(F.col("q")).alias("c"), F.sha2(F.array_join(X.question_subjects(F.col("q")), "|"), 256).alias("names"), words.alias("w"))
    return out.select("conv_id", "turn", "c.*", "names", F.size("w").cast("long").alias("n_words"), F.get("w", F.size("w") - 1).alias("last_word"))


@query("e12_hop_gate", f"WITH {STORE}, q0 AS (SELECT item_id AS qid, 0 AS hop, text FROM benchmark UNION ALL SELECT item_id, 1, array_to_string(list_slice(string_split(text, '.'), 2, 1000000), ' ') FROM benchmark), queries AS (SELECT qid * 2 + hop AS qid, text FROM q0), {INDEX}, pool AS (SELECT qid // 2 AS qid, id, max(\"full\") AS score FROM bm GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank0 FROM pool QUALIFY rank0 < 5), gold AS (SELECT item_id AS qid, concat('m', lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), hit AS (SELECT DISTINCT qid FROM r JOIN gold USING (qid, id) JOIN store USING (id) WHERE deprecated = 0), n AS (SELECT item_id AS qid, text AS q FROM benchmark), c AS (SELECT qid, len(list_distinct({_NAMES})) AS k, regexp_matches(q, '{X.QUESTION}') AS asks FROM n), a AS (SELECT g.qid, h.qid IS NOT NULL AS hit, (k >= 2 AND asks) OR k >= 3 AS hard FROM (SELECT DISTINCT qid FROM gold) g JOIN c USING (qid) LEFT JOIN hit h ON h.qid = g.qid) SELECT count(*) AS n, count(*) FILTER (hit) AS hit, coalesce(round(count(*) FILTER (hit) / count(*)::DOUBLE, 4), 0) AS hit_rate, count(*) FILTER (hard) AS complex_n, count(*) FILTER (NOT hard) AS simple_n, CASE WHEN count(*) > 0 AND coalesce(round(count(*) FILTER (hit) / count(*)::DOUBLE, 4), 0) >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM a")
def hop_gate(spark, d):
    """Items asked whole and without their first sentence, as two hops; expected are the documents that hold an item."""
    b, s = table(spark, d, "benchmark"), store(spark, d)
    rest = F.array_join(F.slice(F.split("text", r"\."), 2, 1_000_000), " ")
    hops = b.select(F.col("item_id").alias("qid"), F.posexplode(F.array("text", rest)).alias("hop", "text"))
    gold = holding(s, "id", "content", b.select(F.col("item_id").alias("qid"), F.col("text").alias("gt")), "qid", "gt")
    level = b.select(F.col("item_id").alias("qid"), X.question_complexity(F.col("text"))["level"].alias("level"))
    return W.hop_gate(multi_hop(hops, text_index(spark, d), 5), gold, s.where("deprecated = 1"), level, 0.8)


def _told(spark, d):
    """Entries whose texts name their source, their language's platform and a project of both."""
    text = F.concat(F.col("summary"), F.lit(" 「"), F.col("source_agent"), F.lit("」 "), F.col("lang"), F.lit("平台 "), F.col("source_agent"), F.lit("_"), F.col("lang"), F.lit("（项目）"))
    return store(spark, d).where("source_agent is not null").select("id", "doc_id", text.alias("text"))


ARCHIVED = """told AS (SELECT id, doc_id, summary || ' 「' || source_agent || '」 ' || lang || '平台 ' || source_agent || '_' || lang || '（项目）' AS t FROM store WHERE source_agent IS NOT NULL),
f AS (SELECT doc_id, id AS entry, unnest(list_distinct(list_filter(list_concat(regexp_extract_all(t, '[\\x{4e00}-\\x{9fff}A-Za-z0-9_\\-]{2,40}（(?:系统|项目|模型|平台|方案|工具|库|模块)）'), regexp_extract_all(t, '[《「『"“]([\\x{4e00}-\\x{9fff}A-Za-z0-9_\\-]{2,40})[」』"”》]', 1), regexp_extract_all(t, '[\\x{4e00}-\\x{9fff}A-Za-z0-9_]{2,30}(?:系统|平台|引擎|模型|库|框架|工具|项目)')), lambda n: length(n) BETWEEN 2 AND 60))) AS name FROM told),
e AS (SELECT DISTINCT doc_id, entry, replace(replace(name, '（', '('), '）', ')') AS name FROM f)"""


def _archive(spark, d):
    """The archive after two batches, of which the second brings a third of the entries again."""
    told = _told(spark, d)
    empty = spark.createDataFrame([], "entity string, name string, entry_count long, first_seen string")
    none = spark.createDataFrame([], "entity string, entry string")
    archive, links, _ = A.archived(told.where("doc_id % 3 < 2"), empty, none, "first")
    return A.archived(told.where("doc_id % 3 > 0"), archive, links, "second")


@query("p15_archived_entities", f"WITH {STORE}, {ARCHIVED} SELECT name, count(DISTINCT entry) AS entry_count, CASE WHEN min(doc_id % 3) < 2 THEN 'first' ELSE 'second' END AS first_seen FROM e GROUP BY name")
def archived(spark, d):
    """Entities by the half-width form of their names, which is what tells them apart here."""
    half = F.regexp_replace(F.regexp_replace("name", "（", "("), "）", ")")
    return _archive(spark, d)[0].select(half.alias("name"), "entry_count", "first_seen")


@query("p15_shared_edges", f"WITH {STORE}, {ARCHIVED}, m AS (SELECT DISTINCT entry, doc_id, name FROM e WHERE doc_id % 3 = 2), p AS (SELECT a.name AS a, b.name AS b, a.entry FROM m a JOIN m b ON a.entry = b.entry AND a.name < b.name) SELECT a AS name1, b AS name2, count(*) AS shared, 0.8::DOUBLE AS weight FROM p GROUP BY a, b")
def shared(spark, d):
    """Edges that the second batch brings: pairs of its new entries alone."""
    archive, _, edges = _archive(spark, d)
    half = F.regexp_replace(F.regexp_replace("name", "（", "("), "）", ")")
    a, b = archive.select(F.col("entity").alias("id1"), half.alias("n1")), archive.select(F.col("entity").alias("id2"), half.alias("n2"))
    return edges.join(a, "id1").join(b, "id2").select(F.least("n1", "n2").alias("name1"), F.greatest("n1", "n2").alias("name2"), "shared", "weight")


@query("z1_upserted_relations", "WITH r AS (SELECT l_orderkey % 2 AS part, l_partkey AS a, l_suppkey * 20 AS b, CASE WHEN l_quantity >= 25 THEN 'depends_on' ELSE 'uses' END AS relation, l_returnflag AS source, l_quantity / 50 AS weight, l_shipdate AS day FROM lineitem WHERE l_partkey <> l_suppkey * 20), k AS (SELECT part, least(a, b) AS id1, greatest(a, b) AS id2, relation, source, weight, day FROM r), x AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY part, id1, id2, relation, source ORDER BY day DESC, weight DESC) = 1) SELECT id1, id2, relation, source, round(weight, 6) AS weight, CAST(day AS DATE) AS updated_at FROM x QUALIFY row_number() OVER (PARTITION BY id1, id2, relation, source ORDER BY part DESC) = 1")
def relations(spark, d):
    """Edges of parts and suppliers of even orders, then those of odd ones put over them."""
    kind = F.when(F.col("l_quantity") >= 25, "depends_on").otherwise("uses")
    r = table(spark, d, "lineitem").select((F.col("l_orderkey") % 2).alias("part"), F.col("l_partkey").alias("id1"), (F.col("l_suppkey") * 20).alias("id2"), kind.alias("relation"), F.col("l_returnflag").alias("source"), (F.col("l_quantity") / 50).alias("weight"), F.col("l_shipdate").alias("updated_at"))
    none = r.where("false").drop("part")
    held = A.upserted_relations(none, r.where("part = 0"))
    return A.upserted_relations(held, r.where("part = 1")).withColumns({"weight": F.round("weight", 6), "updated_at": F.col("updated_at").cast("date")})


@query("z20_promotion_verdicts", f"WITH {STORE}, l AS (SELECT id, 'lesson' AS type, summary, confidence, doc_id FROM store), c AS (SELECT *, doc_id % 7 = 3 AS held, summary IN (SELECT summary FROM store WHERE type = 'principle') AS gene FROM l WHERE confidence >= 0.85), r AS (SELECT *, row_number() OVER (PARTITION BY summary, held ORDER BY confidence DESC, id) AS n FROM c), v AS (SELECT id, CASE WHEN held THEN 'file' WHEN gene OR n > 1 THEN 'summary' ELSE '' END AS detail FROM r) SELECT id, CASE WHEN detail = '' THEN 'promote' ELSE 'skip_dedup' END AS verdict, detail, CAST(0 AS INT) AS exit_code FROM v")
def verdicts(spark, d):
    """All entries as lessons; a seventh have a file already."""
    s = store(spark, d)
    return A.promotion_verdicts(s.withColumn("type", F.lit("lesson")), s.where("doc_id % 7 = 3").select("id"), s.where("type = 'principle'").select("summary"))


@query("z19_touched", f"WITH {STORE}, h AS (SELECT DISTINCT concat('m', lpad(CAST(user_id AS VARCHAR), 8, '0')) AS id FROM events WHERE event_type = 'purchase') SELECT id, CASE WHEN h.id IS NULL THEN updated_at ELSE '{NOW}' END AS updated_at, CASE WHEN h.id IS NULL THEN NULL ELSE 'injected' END AS action FROM store LEFT JOIN h USING (id)")
def touched(spark, d):
    """Bought entries are touched; the log's row stands beside its entry."""
    ids = table(spark, d, "events").where("event_type = 'purchase'").select(F.concat(F.lit("m"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("id"))
    out, log = E.touched(store(spark, d).select("id", "updated_at"), ids, NOW, "injected")
    return out.join(log.select("id", "action"), "id", "left").select("id", "updated_at", "action")


@query("k7_z18_backfilled", f"WITH {STORE}, m AS (SELECT id, substr(summary || ' ' || content, 1, 1000) AS t FROM store WHERE id NOT IN (SELECT concat('m', lpad(CAST(vec_id AS VARCHAR), 8, '0')) FROM embeddings WHERE vec_id % 2 = 0)) SELECT id, CASE WHEN length(t) % 2 = 0 THEN 'embedder' ELSE 'fallback' END AS source, CAST(512 AS INT) AS dims, true AS unit FROM m")
def backfilled(spark, d):
    """Entries without a vector get one, from an embedder that gives texts of odd length a vector of the wrong size, or from the fall-back."""

    def embed(texts):
        return [v if len(t) % 2 == 0 else v[:100] for t, v in zip(texts, E.hashed(texts), strict=True)]

    # by the vector's number: an id holds its first eight digits only
    even = table(spark, d, "embeddings").where("vec_id % 2 = 0")
    have = even.select(F.concat(F.lit("m"), F.lpad(F.col("vec_id").cast("string"), 8, "0")).alias("id"))
    out = E.embedded(E.missing(store(spark, d), have), embed)
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return out.select("id", "source", F.size("vec").alias("dims"), (F.abs(norm - 1) < 1e-3).alias("unit"))


@query("z7_newest_reports", "WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, count(*) AS n, count(*) FILTER (l_linestatus = 'F' OR l_returnflag = 'R') AS good FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), m AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) = 1) SELECT o_custkey, 'asset' || o_custkey AS asset, CASE WHEN o_orderkey % 2 = 0 THEN 'go' ELSE 'hold' END AS gate, strftime(o_orderdate, '%Y-%m-%d') AS run_ts, CAST(n AS INT) AS layers_total, CAST(good AS INT) AS layers_passed FROM m")
def newest(spark, d):
    """Each order as a report on its customer: its lines are layers, finished ones passed, and the gate stands in either of two forms."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    layer = F.struct(F.when(F.col("l_linestatus") == "F", "pass").otherwise("fail").alias("status"), (F.col("l_returnflag") == "R").alias("passed"))
    own = lines.groupBy("l_orderkey").agg(F.collect_list(layer).alias("layers"))  # an order has seven lines at most
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    gate = F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.struct(F.lit("go").alias("decision"), F.lit("x").alias("verdict")))).otherwise(F.to_json(F.struct(F.lit("hold").alias("verdict"))))
    rest = F.to_json(F.struct(F.concat(F.lit("asset"), "o_custkey").alias("asset"), F.struct(day.alias("ts")).alias("run"), "layers"))
    value = F.concat(F.lit('{"gate":'), gate, F.lit(","), F.substring(rest, 2, 1 << 20))
    texts = orders.join(own, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.col("o_orderkey").cast("string").alias("path"), day.alias("modified"), value.alias("value"))
    return P.newest(texts, "o_custkey").select("o_custkey", P.evaluation(F.col("value")).alias("e")).select("o_custkey", "e.*")


TERMS = "q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS text FROM benchmark)"


@query("s19_federated_hits", f"WITH {TERMS}, h AS (SELECT q.text AS qid, 'store' AS source, doc_id AS item, doc_id AS newest FROM q JOIN documents d ON contains(lower(d.text), q.text) OR contains(lower(source), q.text) UNION ALL SELECT q.text, 'session', conv_id * 1000 + turn, conv_id FROM q JOIN conversations c ON contains(lower(c.text), q.text) OR contains(lower(role), q.text) UNION ALL SELECT q.text, 'files', page_id, -page_id FROM q JOIN pages ON contains(lower(html), q.text) OR contains(lower(url), q.text)), r AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY newest DESC, item) AS n FROM h QUALIFY n <= 10) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY n, source) AS rank, source, item, round(1.0::DOUBLE / (n + 60), 6) AS score FROM r")
def federated(spark, d):
    """Long words of the items, asked of documents, turns of conversations and pages."""
    terms = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{9,})"), 1)).alias("text")).distinct()
    docs, turns, pages = (table(spark, d, t) for t in ("documents", "conversations", "pages"))
    sources = {
        "store": docs.select(F.col("doc_id").alias("item"), "text", F.col("source").alias("name"), F.col("doc_id").alias("newest")),
        "session": turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("item"), "text", F.col("role").alias("name"), F.col("conv_id").alias("newest")),
        "files": pages.select(F.col("page_id").alias("item"), F.col("html").alias("text"), F.col("url").alias("name"), (-F.col("page_id")).alias("newest")),
    }
    return P.federated_hits(terms.select(F.col("text").alias("qid"), "text"), sources, 10)


@query("p3_p6_whole_curation")
def curation(spark, d):
    """The store's entries; every eleventh stands in one target already."""
    s = store(spark, d)
    whole = F.concat(F.coalesce("summary", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    held = s.where("doc_id % 11 = 0").select("id", F.lit("industry/AI").alias("target"), whole.alias("text"))
    return D.curation(s, held)


@query("x9_answer_verdicts", "SELECT o_orderkey AS qid, o_orderkey AS id, CAST(2 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS passed, CAST(4 AS INT) AS total, o_orderkey % 6 = 0 AS passed_all, 'money:' || o_custkey || '元,date:' || strftime(o_orderdate, '%Y-%m-%d') || ',conclusion:完成,percent:' || (10 + o_orderkey % 90) || '%' AS tokens FROM orders")
def answer_verdicts(spark, d):
    """Questions with an amount, a day, a conclusion and a share, and entries that tell the day, every second the amount, every third the share."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    day, money, share = F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.col("o_custkey").cast("string"), F.lit("元")), F.concat((10 + k % 90).cast("string"), F.lit("%"))
    q = o.select(k.alias("qid"), F.concat(F.lit("订单 "), money, F.lit("，于 "), day, F.lit(" 完成，占 "), share).alias("text"))
    s = o.select(k.alias("id"), F.when(k % 2 == 0, money).otherwise("x").alias("summary"), F.concat(day, F.when(k % 3 == 0, F.concat(F.lit(" "), share)).otherwise("")).alias("content"))
    out = W.answer_verdicts(q, o.select(k.alias("qid"), k.alias("id")), s)
    told = F.transform("evidence", lambda e: F.concat(e["type"], F.lit(":"), e["token"]))
    return out.select("qid", "id", "passed", "total", "passed_all", F.array_join(told, ",").alias("tokens"))


def _relation_hits(spark, d):
    """Parts' sentences and what should be found in them: nothing where a sentence has no verb, and by mistake in some others; a relation of another kind in some."""
    k = F.col("p_partkey")
    told = F.concat(F.col("p_brand"), F.lit("系统依赖"), F.col("p_name"), F.lit("。团队负责"), F.col("p_brand"), F.lit("模块"))
    p = table(spark, d, "part")
    found = p.select(k.alias("id"), F.explode(X.triples(F.when(k % 5 == 0, F.concat(F.lit("文字 "), "p_name")).otherwise(told))).alias("t")).select("id", "t.subject", "t.relation", "t.object")
    none = (k % 5 == 0) | (k % 11 == 0)
    want = p.select(k.alias("id"), F.concat(F.upper("p_brand"), F.lit("-系统")).alias("subject"), F.when(~none, F.when(k % 7 == 0, "uses").otherwise("DEPENDS_ON")).alias("relation"), F.substring_index("p_name", " ", 1).alias("object"))
    return W.relation_hits(found, want)


RELATION_HITS = "SELECT p_partkey AS id, p_partkey % 5 = 0 OR (p_partkey % 11 <> 0 AND p_partkey % 7 <> 0) AS hit FROM part"


@query("e13_relation_hits", RELATION_HITS)
def relation_hits(spark, d):
    return _relation_hits(spark, d)


@query("e13_relation_gate", f"WITH h AS ({RELATION_HITS}) SELECT count(*) AS total, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / count(*)::DOUBLE, 4) AS accuracy, round(count(*) FILTER (hit) / count(*)::DOUBLE, 4) >= 0.8 AS passed FROM h")
def relation_gate(spark, d):
    return W.relation_accuracy(_relation_hits(spark, d))
