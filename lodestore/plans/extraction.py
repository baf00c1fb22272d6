"""Extraction queries: dates, entities, relations, verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import BANNED_RELATIONS, SEMANTIC_RELATIONS
from ..functions import extract as X
from ..functions.text import unescape
from ..registry import query
from .common import STORE, store, table

@query("x33_x34_p16_event_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN DATE '2026-09-01' - CAST(7 * (o_orderkey % 9) AS INT) ELSE CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 4 = 3 THEN 0.85::DOUBLE ELSE 0.95::DOUBLE END AS confidence FROM orders")
def x33(spark, d):
    k = F.col("o_orderkey") % 4
    at = F.col("o_orderdate").cast("date")
    text = F.when(k == 0, F.concat(F.lit("on "), F.date_format(at, "yyyy-MM-dd"))).when(k == 1, F.concat(F.lit("by "), F.date_format(at, "yyyy/MM/dd"), F.lit("."))).when(k == 2, F.concat(F.lit("since "), F.date_format(at, "MMM d, yyyy"))).otherwise(F.concat((F.col("o_orderkey") % 9).cast("string"), F.lit(" weeks ago")))
    found = X.event_date(text, F.lit("2026-09-01").cast("date"))
    return table(spark, d, "orders").select("o_orderkey", found.alias("f")).select("o_orderkey", "f.day", "f.confidence")


@query("x35_p15_entities", "SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(html, '\"([A-Za-z0-9_\\-]{2,40})\"', 1), lambda n: length(n) BETWEEN 2 AND 60))), ',') AS names FROM pages")
def x35(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(F.sort_array(X.entities(F.col("html"))), ",").alias("names"))


@query("x36_p17_triples", "SELECT p_partkey, p_brand || '系统' AS subject, 'depends_on' AS relation, p_name AS object, 0.9::DOUBLE AS confidence FROM part UNION ALL SELECT p_partkey, '团队', 'develops', p_brand || '模块', 0.85::DOUBLE FROM part")
def x36(spark, d):
    """Relations of sentences made from the parts table; pseudo relations never pass."""
    text = F.concat(F.col("p_brand"), F.lit("系统依赖"), F.col("p_name"), F.lit("。团队负责"), F.col("p_brand"), F.lit("模块"))
    t = table(spark, d, "part").select("p_partkey", F.explode(X.triples(text)).alias("t")).select("p_partkey", "t.*")
    return t.where(F.col("relation").isin(*SEMANTIC_RELATIONS) & ~F.col("relation").isin(*BANNED_RELATIONS))


@query("x7_x9_r21_verify")
def x7(spark, d):
    s = store(spark, d).select("id", "summary", "content", X.key_data(F.col("content")).alias("keys"))
    return s.select("id", F.size("keys").alias("n_keys"), X.verified(F.col("keys"), F.col("content"), F.col("summary")).alias("v")).select("id", "n_keys", "v.passed", "v.total")


@query("s11_web_pages", "WITH p AS (SELECT page_id, url, html, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS t, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')) AS h FROM pages WHERE NOT regexp_matches(lower(url), 'login|signin|sign-in|paywall|subscribe')), u AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS title, replace(replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS h1 FROM p) SELECT page_id, CASE WHEN length(s) > 100 THEN substr(s, 1, 99) || '…' ELSE s END AS summary, substr(sha256(CASE WHEN length(s) > 100 THEN substr(s, 1, 99) || '…' ELSE s END), 1, 12) AS summary_hash FROM (SELECT page_id, trim(regexp_replace(title || '：' || h1, '\\s+', ' ', 'g')) AS s FROM u)")
def s11(spark, d):
    return web_entries(table(spark, d, "pages")).select("page_id", "summary", "summary_hash")


def web_entries(pages):
    """Title, description or first heading, and plain text of HTML pages; denied addresses are left out."""
    from ..config import DENIED_URLS
    from ..functions.text import clip, summary_hash

    title = unescape(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)))
    described = unescape(F.trim(F.regexp_extract("html", r"(?is)<meta[^>]+name=[\"']description[\"'][^>]+content=[\"']([^\"']*)[\"']", 1)))
    h1 = unescape(F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", "")))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " "), "<[^>]+>", " ")
    kept = pages.where(~F.lower("url").rlike("|".join(DENIED_URLS)))
    out = kept.select("page_id", F.col("url").alias("source_ref"), clip(F.concat(title, F.lit("："), F.when(described != "", described).otherwise(h1))).alias("summary"), unescape(F.trim(F.regexp_replace(body, r"\s+", " "))).alias("content"))
    return out.withColumn("summary_hash", summary_hash(F.col("summary")))


@query("z1_normal_relations", f"WITH {STORE}, r AS (SELECT source_agent AS a, lang AS b, count(*) AS n FROM store GROUP BY ALL) SELECT least(a, b) AS id1, greatest(a, b) AS id2, sum(n)::BIGINT AS n FROM r WHERE a <> b GROUP BY ALL")
def z1(spark, d):
    r = store(spark, d).groupBy(F.col("source_agent").alias("a"), F.col("lang").alias("b")).agg(F.count("*").alias("n")).where("a <> b")
    return r.groupBy(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2")).agg(F.sum("n").alias("n"))
