"""Source and sink queries over tables that stand for files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.ingest import frontmatter
from ..registry import query
from ..sources import files
from .common import STORE, store, table


@query("s8_jsonl", "SELECT user_id, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS INT))::BIGINT AS k FROM events WHERE event_id % 10 <> 0 GROUP BY user_id")
def s8(spark, d):
    line = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.col("props"))
    rows = table(spark, d, "events").select("user_id", F.from_json(line, "k int", {"mode": "PERMISSIVE"}).alias("j")).where("j.k is not null")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("j.k").alias("k"))


@query("s9_s10_s17_frontmatter", "SELECT doc_id, source AS agent, CAST(doc_id % 10 AS VARCHAR) AS importance, text AS body FROM documents")
def s9(spark, d):
    value = F.concat(F.lit("---\nagent: "), F.col("source"), F.lit("\nimportance: \""), (F.col("doc_id") % 10).cast("string"), F.lit("\"\n---\n"), F.col("text"))
    texts = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), value.alias("value"))
    return frontmatter(texts).select(F.col("path").cast("long").alias("doc_id"), F.col("meta")["agent"].alias("agent"), F.col("meta")["importance"].alias("importance"), "body")


@query("s12_file_source", "SELECT doc_id, trim(regexp_replace(regexp_replace(string_split(text, chr(10))[1], '^[#\\s]*', ''), '\\s+', ' ', 'g')) AS head FROM documents")
def s12(spark, d):
    first = F.get(F.split("text", "\n"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace(F.regexp_replace(first, r"^[#\s]*", ""), r"\s+", " ")).alias("head"))


@query("s15_s16_assets", "SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'skill' WHEN page_id % 6 = 1 THEN 'config' WHEN page_id % 6 = 2 THEN 'script' WHEN page_id % 6 = 3 THEN 'benchmark' WHEN page_id % 6 = 4 THEN 'workflow' ELSE 'reference' END AS type FROM pages")
def s15(spark, d):
    names = F.array(*[F.lit(x) for x in ("a/x/SKILL.md", "a/c.yaml", "a/run.sh", "a/bench_1.txt", "a/workflow_b.md", "a/notes.md")])
    path = F.concat(F.col("page_id").cast("string"), F.lit("/"), F.element_at(names, (F.col("page_id") % 6 + 1).cast("int")))
    texts = table(spark, d, "pages").select(path.alias("path"), F.lit("# Title\nplain words\n").alias("value"))
    return files.assets(texts).select(F.regexp_extract("source_ref", r"^(\d+)/", 1).cast("long").alias("page_id"), "type")


@query("s15b_schedules", "SELECT CAST(c_custkey AS VARCHAR) AS path, 'job ' || c_custkey AS name, 'every ' || (c_custkey % 60) || 'm' AS schedule FROM customer")
def s15b(spark, d):
    lines = F.array(F.lit("  [active]"), F.concat(F.lit("  Name: job "), F.col("c_custkey").cast("string")), F.concat(F.lit("  Schedule: every "), (F.col("c_custkey") % 60).cast("string"), F.lit("m")))
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.posexplode(lines).alias("n", "value"))
    return files.scheduled(rows).select("path", "name", "schedule")


@query("s15k_untyped_scripts", f"WITH {STORE}, t AS (SELECT DISTINCT source_ref FROM store WHERE type IN ('rule', 'monitor', 'benchmark') AND confidence >= 0.9) SELECT id, source_ref FROM store ANTI JOIN t USING (source_ref) WHERE type = 'script'")
def s15k(spark, d):
    s = store(spark, d)
    typed = s.where(F.col("type").isin("rule", "monitor", "benchmark") & (F.col("confidence") >= 0.9)).select("source_ref").distinct()
    return s.where("type = 'script'").join(typed, "source_ref", "left_anti").select("id", "source_ref")


@query("s18_activity", "SELECT user_id, max(ts) < TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 600 SECOND AS idle FROM events GROUP BY user_id")
def s18(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg((F.max("ts") < F.lit("2024-01-29 00:00:00").cast("timestamp_ntz") - F.expr("interval 600 seconds")).alias("idle"))


@query("s19_federated_sources", "SELECT source, count(*) AS n FROM (SELECT 'store' AS source FROM documents WHERE contains(lower(text), 'the') UNION ALL SELECT 'session' FROM conversations WHERE contains(lower(text), 'the') UNION ALL SELECT 'files' FROM pages WHERE contains(lower(html), 'the')) GROUP BY source")
def s19(spark, d):
    parts = [table(spark, d, t).where(F.lower(c).contains("the")).select(F.lit(name).alias("source")) for t, c, name in (("documents", "text", "store"), ("conversations", "text", "session"), ("pages", "html", "files"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(F.count("*").alias("n"))


@query("k1_access_rows", "SELECT user_id AS qid, event_id AS entry_id, 'search' AS scene FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 5")
def k1(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    top = table(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n <= 5").groupBy(F.col("user_id").alias("qid")).agg(F.collect_list("event_id").alias("ids"))
    return access_rows(top, "search")


def access_rows(results, scene):
    """One log row for each id that a query returned; one with a null id if it returned none."""
    return results.select("qid", F.explode_outer("ids").alias("entry_id"), F.lit(scene).alias("scene"))


@query("k6_k7_k8_missing_vectors", f"WITH {STORE} SELECT id, substr(summary || ' ' || content, 1, 1000) AS text FROM store WHERE id NOT IN (SELECT concat('m', lpad(CAST(vec_id AS VARCHAR), 8, '0')) FROM embeddings)")
def k6(spark, d):
    have = table(spark, d, "embeddings").select(F.concat(F.lit("m"), F.lpad(F.col("vec_id").cast("string"), 8, "0")).alias("id"))
    return store(spark, d).join(have, "id", "left_anti").select("id", F.substring(F.concat_ws(" ", "summary", "content"), 1, 1000).alias("text"))


@query("k13_redaction", "SELECT page_id, CASE WHEN length(url) > 50 THEN substr(url, 1, 50) || '…' ELSE url END AS url, 1 AS kept FROM pages")
def k13(spark, d):
    params = F.create_map(F.lit("url"), F.col("url"), F.lit("api_token"), F.lit("abc"))
    return table(spark, d, "pages").select("page_id", files.redacted(params).alias("p")).select("page_id", F.col("p")["url"].alias("url"), F.size("p").alias("kept"))


@query("z5_audit_blocks", "SELECT event_id, event_type AS op, user_id AS reader FROM events WHERE event_type IN ('view', 'click', 'purchase')")
def z5(spark, d):
    block = F.concat(F.lit("op: "), F.col("event_type"), F.lit("\nreader: "), F.col("user_id").cast("string"))
    kv = F.str_to_map(block, F.lit("\n"), F.lit(": "))
    return table(spark, d, "events").select("event_id", kv.alias("kv")).select("event_id", F.col("kv")["op"].alias("op"), F.col("kv")["reader"].cast("long").alias("reader")).where(F.col("op").isin("view", "click", "purchase"))
