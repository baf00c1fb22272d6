"""Scalar function queries: text normal forms, hashes, similarities, dates, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import STOP_WORDS
from ..functions import lifecycle as L
from ..functions import text as X
from ..registry import query
from .common import STORE, store, table


@query("x1_x2_x39_queries", "SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS normal, sha256(concat_ws('|', trim(regexp_replace(text, '\\s+', ' ', 'g')), 'compact', 'auto', '', '', '')) AS cache_key, CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 100 THEN substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 99) || '…' ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS clipped FROM benchmark")
def x1(spark, d):
    normal = X.normal_query(F.col("text"))
    key = F.sha2(F.concat_ws("|", normal, F.lit("compact"), F.lit("auto"), F.lit(""), F.lit(""), F.lit("")), 256)
    return table(spark, d, "benchmark").select("item_id", normal.alias("normal"), key.alias("cache_key"), X.clip(F.col("text")).alias("clipped"))


@query("x3_ttl", "SELECT user_id, count(*) FILTER (epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(ts) <= 86400 * 3) AS fresh, count(*) AS n FROM events GROUP BY user_id")
def x3(spark, d):
    age = F.unix_timestamp(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(age <= 3 * 86400).alias("fresh"), F.count("*").alias("n"))


@query("x4_rewrite", "SELECT page_id, CASE WHEN regexp_matches(q, '[A-Za-z]{2,}[-_]\\d+|\\d{5,}') OR regexp_matches(q, '[|;>&]|^[a-z]{2,10}\\s+-') THEN q WHEN length(q) < 4 THEN q || ' 是什么' ELSE q END AS rewritten FROM (SELECT page_id, substr(trim(regexp_replace(url, '^https?://', '')), 1, 1 + page_id::INT % 6) AS q FROM pages)")
def x4(spark, d):
    q = F.substring(F.trim(F.regexp_replace("url", "^https?://", "")), F.lit(1), (F.lit(1) + F.col("page_id") % 6).cast("int"))
    plain = q.rlike(r"[A-Za-z]{2,}[-_]\d+|\d{5,}") | q.rlike(r"[|;>&]|^[a-z]{2,10}\s+-")
    return table(spark, d, "pages").select("page_id", F.when(plain, q).when(F.length(q) < 4, F.concat(q, F.lit(" 是什么"))).otherwise(q).alias("rewritten"))


@query("x5_time_detect", "WITH t AS (SELECT o_orderkey, 'due ' || strftime(o_orderdate, '%Y-%m-%d') || ' or ' || strftime(o_orderdate + INTERVAL (o_orderkey % 60) DAY, '%Y-%m-%d') AS q FROM orders), f AS (SELECT o_orderkey, list_filter(regexp_extract_all(q, '((?:19|20)\\d{2}-(?:0[1-9]|1[0-2])-(?:[12]\\d|3[01]|0[1-9]))', 1), lambda x: x <> '') AS ds FROM t) SELECT o_orderkey, list_min(ds) AS t1, list_max(ds) AS t2 FROM f")
def x5(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    other = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 60).cast("int")), "yyyy-MM-dd")
    t1, t2 = time_window(F.concat(F.lit("due "), day, F.lit(" or "), other))
    return table(spark, d, "orders").select("o_orderkey", t1.alias("t1"), t2.alias("t2"))


def time_window(text):
    """First and last day named in a text; null if none."""
    days = F.regexp_extract_all(text, F.lit(r"((?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:[12]\d|3[01]|0[1-9]))"), 1)
    return F.array_min(days), F.array_max(days)


@query("x6_norm_ts", f"WITH {STORE} SELECT id, CASE WHEN doc_id % 3 = 0 THEN ts::DOUBLE WHEN doc_id % 3 = 1 THEN ts::DOUBLE ELSE ts - 28800.0 END AS at FROM store")
def x6(spark, d):
    stamp = F.when(F.col("doc_id") % 3 == 0, F.col("ts").cast("string")).when(F.col("doc_id") % 3 == 1, F.col("timestamp")).otherwise(F.rtrim(F.col("timestamp"), F.lit("Z")))
    return store(spark, d).select("id", L.epoch(stamp).alias("at"))


@query("x8_snippet", "WITH s AS (SELECT doc_id, text, strpos(lower(text), 'the') - 1 AS p FROM documents) SELECT doc_id, p, CASE WHEN p >= 0 THEN substr(text, greatest(p - 40, 0) + 1, p + 3 + 40 - greatest(p - 40, 0)) END AS snippet FROM s")
def x8(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", (F.locate("the", F.lower("text")) - 1).alias("p")).select("doc_id", F.col("p").cast("long").alias("p"), snippet(F.col("text"), F.col("p"), F.lit(3)).alias("snippet"))


def snippet(text, at, length, radius=40):
    low = F.greatest(at - radius, F.lit(0))
    return F.when(at >= 0, F.substring(text, low + 1, at + length + radius - low))


@query("x11_x12_normal", "SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '', 'g') AS normal, regexp_replace(text, '\\s+', '', 'g') AS name FROM documents")
def x11(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normal_text(F.col("text")).alias("normal"), X.normal_name(F.col("text")).alias("name"))


PAIRS = "pairs AS (SELECT a.item_id AS i, b.item_id AS j, a.text AS a, b.text AS b FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"
GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - {1}, 0) + 1), lambda i: substr({0}, i, {2})))"


def _pairs(spark, d):
    b = table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("i"), F.col("text").alias("a")).join(b.select((F.col("item_id") - 1).alias("i"), F.col("item_id").alias("j"), F.col("text").alias("b")), "i")


@query("x13_x18_u6_grams", f"WITH {PAIRS}, g AS (SELECT i, j, {GRAMS.format('a', 2, 3)} AS ta, {GRAMS.format('b', 2, 3)} AS tb, {GRAMS.format('a', 1, 2)} AS da, {GRAMS.format('b', 1, 2)} AS db FROM pairs) SELECT i, j, round(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb)))::DOUBLE, 8) AS jaccard3, round(2 * len(list_intersect(da, db)) / (len(da) + len(db))::DOUBLE, 8) AS dice2, len(da) + len(db) - 2 * len(list_intersect(da, db)) AS differ FROM g")
def x13(spark, d):
    g = _pairs(spark, d).select("i", "j", X.ngrams(F.col("a"), 3).alias("ta"), X.ngrams(F.col("b"), 3).alias("tb"), X.ngrams(F.col("a"), 2).alias("da"), X.ngrams(F.col("b"), 2).alias("db"))
    differ = F.array_union(F.array_except("da", "db"), F.array_except("db", "da"))
    return g.select("i", "j", F.round(X.jaccard(F.col("ta"), F.col("tb")), 8).alias("jaccard3"), F.round(X.dice(F.col("da"), F.col("db")), 8).alias("dice2"), F.size(differ).cast("long").alias("differ"))


@query("x10_x14_ratio")
def x10(spark, d):
    p = _pairs(spark, d)
    return p.select("i", "j", X.ratio("a", "b").alias("ratio"), F.greatest(X.ratio("a", "b"), X.jaccard(X.ngrams(F.col("a"), 3), X.ngrams(F.col("b"), 3))).alias("similarity"))


STOPS = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + ")"


@query("x15_x16_x20_topics", f"WITH {PAIRS}, g AS (SELECT i, j, list_distinct(list_filter(regexp_extract_all(lower(a), '([a-z0-9]+)', 1), lambda w: length(w) > 1 AND w NOT IN {STOPS})) AS ka, list_distinct(list_filter(regexp_extract_all(lower(b), '([a-z0-9]+)', 1), lambda w: length(w) > 1 AND w NOT IN {STOPS})) AS kb FROM pairs) SELECT i, j, len(list_intersect(ka, kb)) AS shared, round(CASE WHEN len(ka) = 0 OR len(kb) = 0 THEN 0.0 ELSE len(list_intersect(ka, kb)) / greatest(len(ka), len(kb))::DOUBLE END, 8) AS topic FROM g")
def x15(spark, d):
    g = _pairs(spark, d).select("i", "j", X.keywords(F.col("a"), STOP_WORDS).alias("ka"), X.keywords(F.col("b"), STOP_WORDS).alias("kb"))
    return g.select("i", "j", F.size(F.array_intersect("ka", "kb")).cast("long").alias("shared"), F.round(X.overlap(F.col("ka"), F.col("kb")), 8).alias("topic"))


@query("x21_x22_x23_decay", f"WITH {STORE}, t AS (SELECT *, (1788220800 - ts) // 86400 AS days, CASE half_life WHEN '30d' THEN 30 WHEN '90d' THEN 90 WHEN '8w' THEN 56 WHEN '6m' THEN 180 WHEN '2y' THEN 730 END AS hl FROM store) SELECT id, days, hl, round(greatest(0.1::DOUBLE, trust_score * pow(0.95::DOUBLE, days)), 2) AS trust, round(greatest(0.05::DOUBLE, confidence * pow(0.5::DOUBLE, days / hl::DOUBLE)), 2) AS confidence FROM t")
def x21(spark, d):
    days, hl = F.expr("(1788220800 - ts) div 86400"), L.half_life_days(F.col("half_life"))
    return store(spark, d).select("id", days.alias("days"), hl.alias("hl"), L.trust_decay(F.col("trust_score"), days).alias("trust"), L.half_life_decay(F.col("confidence"), days, hl).alias("confidence"))


@query("x24_entropy", "WITH c AS (SELECT doc_id, unnest(string_split(substr(text, 1, 500), '')) AS ch FROM documents), k AS (SELECT doc_id, ch, count(*) AS n FROM c GROUP BY ALL), h AS (SELECT doc_id, sum(n) AS len, count(*) AS kinds FROM k GROUP BY doc_id) SELECT k.doc_id, round(-sum((n / len::DOUBLE) * log2(n / len::DOUBLE)) / log2(least(any_value(len), any_value(kinds))::DOUBLE), 6) AS entropy FROM k JOIN h ON h.doc_id = k.doc_id GROUP BY k.doc_id HAVING any_value(kinds) > 1")
def x24(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(L.entropy(F.col("text")), 6).alias("entropy")).where("entropy > 0")


TYPE_CASE = "CASE type WHEN 'research' THEN 1.0 WHEN 'correction' THEN 0.95 WHEN 'principle' THEN 0.9 WHEN 'lesson' THEN 0.85 WHEN 'decision' THEN 0.8 WHEN 'instruction' THEN 0.8 WHEN 'insight' THEN 0.7 WHEN 'estimate' THEN 0.65 WHEN 'result' THEN 0.6 WHEN 'record' THEN 0.55 WHEN 'fact' THEN 0.5 WHEN 'info' THEN 0.45 WHEN 'benchmark' THEN 0.9 WHEN 'rule' THEN 0.9 WHEN 'spec' THEN 0.85 WHEN 'workflow' THEN 0.85 WHEN 'skill' THEN 0.8 WHEN 'asset' THEN 0.7 WHEN 'monitor' THEN 0.7 WHEN 'cron' THEN 0.6 WHEN 'design' THEN 0.85 WHEN 'script' THEN 0.6 WHEN 'config' THEN 0.5 WHEN 'reference' THEN 0.6 ELSE 0.5 END"


@query("x25_x26_x27_dual_axis", f"WITH {STORE}, a AS (SELECT id, confidence, least(1.0, log2(1.0 + length(summary)) / log2(501.0)) AS l, {TYPE_CASE} AS f, CASE WHEN importance > 8 THEN 1 ELSE 0 END AS peak, CASE WHEN g1_check_passed = 1 THEN 1 ELSE 0 END AS done, CASE WHEN expires_at = '' THEN 0.7 WHEN expires_at >= '2026-09-01T00:00:00Z' THEN 1.0 ELSE 0.1 END AS e FROM store) SELECT id, round(0.3::DOUBLE * l + 0.3::DOUBLE * f, 6) AS complexity, round(0.25::DOUBLE * e + 0.25::DOUBLE * 0.5::DOUBLE, 6) AS stability, CASE WHEN confidence >= 0.9 THEN 8 WHEN confidence >= 0.7 THEN 6 WHEN confidence >= 0.5 THEN 4 ELSE 2 END AS base, round(least(10.0, CASE WHEN confidence >= 0.9 THEN 8 WHEN confidence >= 0.7 THEN 6 WHEN confidence >= 0.5 THEN 4 ELSE 2 END + peak + done + 0.3::DOUBLE * l + 0.3::DOUBLE * f + 0.25::DOUBLE * e + 0.25::DOUBLE * 0.5::DOUBLE), 6) AS score FROM a")
def x25(spark, d):
    c = 0.3 * L.length_axis(F.col("summary")) + 0.3 * L.type_complexity(F.col("type"))
    e = F.when(F.col("expires_at") == "", 0.7).when(F.col("expires_at") >= "2026-09-01T00:00:00Z", 1.0).otherwise(0.1)
    s = 0.25 * e + 0.25 * F.lit(0.5)
    base = L.confidence_base(F.col("confidence"))
    anchors = F.when(F.col("importance") > 8, 1).otherwise(0) + F.when(F.col("g1_check_passed") == 1, 1).otherwise(0)
    return store(spark, d).select("id", F.round(c, 6).alias("complexity"), F.round(s, 6).alias("stability"), base.alias("base"), F.round(F.least(F.lit(10.0), base + anchors + c + s), 6).alias("score"))


@query("x28_x29_x30_defaults", f"WITH {STORE} SELECT id, least(10, greatest(1, importance + CASE WHEN confidence >= 0.9 THEN 1 WHEN confidence < 0.5 THEN -1 ELSE 0 END)) AS curated, CASE WHEN type IN ('fact', 'correction') THEN 90 WHEN type IN ('record', 'info', 'context') THEN 30 END AS expiry_days, CASE WHEN type IN ('principle', 'rule', 'insight', 'decision') THEN 'permanent' WHEN type IN ('fact', 'correction') THEN '90d' WHEN type IN ('record', 'info', 'context') THEN '30d' END AS half_life FROM store")
def x28(spark, d):
    return store(spark, d).select("id", L.curated_score(F.col("importance"), F.col("confidence")).alias("curated"), L.default_expiry_days(F.col("type")).alias("expiry_days"), L.type_half_life(F.col("type")).alias("half_life"))


@query("x37_json", "SELECT event_id, CAST(json_extract_string(substr(j, strpos(j, '{')), '$.k') AS INT) AS k FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '```json ' || props ELSE props END AS j FROM events)")
def x37(spark, d):
    j = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json "), F.col("props"))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", tolerant_json(j, "k int")["k"].alias("k"))


def tolerant_json(col, schema):
    """The first object in a text that may be fenced or led in by words; null if there is none."""
    return F.from_json(F.regexp_extract(col, r"(?s)(\{.*\})", 1), schema)


@query("x38_endpoints", "SELECT page_id, regexp_matches(h, '^(localhost|127\\.|10\\.|192\\.168\\.|172\\.(1[6-9]|2\\d|3[01])\\.)|\\.local$') AS allowed FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '10.0.0.' || (page_id % 250) WHEN page_id % 4 = 1 THEN 'box.local' ELSE regexp_extract(url, '^https?://([^/:]+)', 1) END AS h FROM pages)")
def x38(spark, d):
    host = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("10.0.0."), (F.col("page_id") % 250).cast("string"))).when(F.col("page_id") % 4 == 1, "box.local").otherwise(F.regexp_extract("url", "^https?://([^/:]+)", 1))
    return table(spark, d, "pages").select("page_id", private_host(host).alias("allowed"))


def private_host(host):
    """Loopback, private ranges and .local names: the only endpoints a model may be served from."""
    return host.rlike(r"^(localhost|127\.|10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)|\.local$")


@query("x40_x41_content_words", "WITH w AS (SELECT item_id, list_filter(regexp_extract_all(text, '([A-Za-z]{3,})', 1), lambda x: lower(x) NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'are', 'was')) AS ws FROM benchmark) SELECT item_id, len(ws) AS n_words, len(list_filter(ws, lambda x: regexp_matches(x, '^[A-Z]'))) AS entities, (len(list_filter(ws, lambda x: regexp_matches(x, '^[A-Z]'))) >= 3) AS complex FROM w")
def x40(spark, d):
    ws = F.filter(F.regexp_extract_all("text", F.lit("([A-Za-z]{3,})"), 1), lambda x: ~F.lower(x).isin("the", "and", "for", "with", "that", "this", "are", "was"))
    names = F.filter(ws, lambda x: x.rlike("^[A-Z]"))
    return table(spark, d, "benchmark").select("item_id", F.size(ws).cast("long").alias("n_words"), F.size(names).cast("long").alias("entities"), (F.size(names) >= 3).alias("complex"))


@query("x42_split", "WITH h AS (SELECT item_id, sha256('42:' || item_id) AS k FROM benchmark), r AS (SELECT item_id, k, row_number() OVER (ORDER BY k) AS n, count(*) OVER () AS total FROM h) SELECT item_id, CASE WHEN n <= round(total * 0.8) THEN 'train' ELSE 'val' END AS part FROM r")
def x42(spark, d):
    return split(table(spark, d, "benchmark").select("item_id"), "item_id", 42)


def split(golden, key, seed, share=0.8):
    """Order by a seeded hash, the first share is for training. The cut is one hash value, so no row is numbered in one task."""
    h = golden.withColumn("_k", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    n = round(h.count() * share)
    cut = h.select("_k").orderBy("_k").limit(n).agg(F.max("_k").alias("_cut"))
    return h.crossJoin(F.broadcast(cut)).select(key, F.when(F.col("_k") <= F.col("_cut"), "train").otherwise("val").alias("part"))


@query("x43_audit", f"WITH {STORE} SELECT id, 1 + CASE WHEN deprecated = 1 THEN 1 ELSE 0 END AS n_events, CASE WHEN deprecated = 1 THEN 'deprecated' ELSE 'created' END AS last_op, substr(content, 1, 500) AS preview FROM store")
def x43(spark, d):
    s = store(spark, d).withColumn("audit_log", F.array(event("created", F.col("created_at"))))
    s = s.withColumn("audit_log", F.when(F.col("deprecated") == 1, F.array_append("audit_log", event("deprecated", F.col("updated_at")))).otherwise(F.col("audit_log")))
    return s.select("id", F.size("audit_log").alias("n_events"), F.element_at("audit_log", -1)["op"].alias("last_op"), F.substring("content", 1, 500).alias("preview"))


def event(op, at):
    return F.struct(F.lit(op).alias("op"), at.alias("at"))


@query("f16_sampling", "SELECT event_id FROM events WHERE substr(sha256('q' || event_id), 1, 16) < '028f5c28f5c28f5c'")
def f16(spark, d):
    return table(spark, d, "events").where(F.substring(F.sha2(F.concat(F.lit("q"), F.col("event_id").cast("string")), 256), 1, 16) < "028f5c28f5c28f5c").select("event_id")
