"""Aggregation and ranking queries: usage, miss rates, clusters, distributions, audits, gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.lifecycle import normal_importance, usage_target
from ..registry import query
from .common import ACCESS, STORE, access_log, store, table

USAGE = "u AS (SELECT entry_id AS id, count(*) AS uses, max(accessed_at) AS last_at FROM access WHERE accessed_at >= TIMESTAMP '2026-06-03 00:00:00' AND scene IN ('view', 'click') GROUP BY entry_id)"


def usage(access, since):
    return access.where((F.col("accessed_at") >= F.lit(since).cast("timestamp")) & F.col("scene").isin("view", "click")).groupBy(F.col("entry_id").alias("id")).agg(F.count("*").alias("uses"), F.max("accessed_at").alias("last_at"))


@query("a1_usage", f"WITH {ACCESS}, {USAGE} SELECT * FROM u")
def a1(spark, d):
    return usage(access_log(spark, d), "2026-06-03 00:00:00")


@query("a2_importance", f"WITH {STORE}, {ACCESS}, {USAGE}, t AS (SELECT s.id, importance, uses, date_diff('day', CAST(last_at AS DATE), DATE '2026-09-01') AS ago FROM store s JOIN u USING (id)) SELECT id, uses, greatest(importance, least(10, 5 + CASE WHEN uses >= 20 THEN 4 WHEN uses >= 10 THEN 3 WHEN uses >= 5 THEN 2 WHEN uses >= 2 THEN 1 ELSE 0 END + CASE WHEN ago <= 7 THEN 1 ELSE 0 END)) AS importance FROM t")
def a2(spark, d):
    u = usage(access_log(spark, d), "2026-06-03 00:00:00")
    target = usage_target(F.col("uses"), F.datediff(F.lit("2026-09-01").cast("date"), F.col("last_at").cast("date")))
    return store(spark, d).select("id", "importance").join(u, "id").select("id", "uses", F.greatest(normal_importance(F.col("importance")), target).alias("importance"))


def miss_rate(log, since):
    """One row: queries, misses, rate, trigger, of the log since an instant; a query with any hit is a hit."""
    per = log.where(F.col("ts") >= F.lit(since).cast("timestamp")).groupBy("query").agg(F.bool_or("hit").alias("hit"))
    rate = F.count_if(~F.col("hit")) / F.count("*")
    return per.agg(F.count("*").alias("queries"), F.count_if(~F.col("hit")).alias("misses"), F.round(rate, 6).alias("rate"), (rate > 0.2).alias("triggered"))


@query("a3_miss_rate", "WITH q AS (SELECT user_id, bool_or(event_type IN ('click', 'purchase')) AS hit FROM events WHERE ts >= TIMESTAMP '2024-01-23 00:00:00' GROUP BY user_id) SELECT count(*) AS queries, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (NOT hit) / count(*)::DOUBLE, 6) AS rate, count(*) FILTER (NOT hit) / count(*)::DOUBLE > 0.2 AS triggered FROM q")
def a3(spark, d):
    log = table(spark, d, "events").select("ts", F.col("user_id").alias("query"), F.col("event_type").isin("click", "purchase").alias("hit"))
    return miss_rate(log, "2024-01-23 00:00:00")


@query("a4_concerns", "WITH w AS (SELECT user_id % 20 AS concern, count(*) FILTER (ts >= TIMESTAMP '2024-01-23 00:00:00' AND event_type = 'signup') AS recent, count(*) AS ever FROM events GROUP BY 1), t AS (SELECT *, max(recent) OVER () AS any_recent FROM w) SELECT concern, CASE WHEN any_recent > 0 THEN CASE WHEN recent >= 3 THEN 1.0::DOUBLE WHEN recent >= 1 THEN 0.7 ELSE 0.5 END ELSE CASE WHEN ever >= 3 THEN 1.0::DOUBLE WHEN ever >= 1 THEN 0.7 ELSE 0.5 END END AS activity FROM t")
def a4(spark, d):
    e = table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("concern")).agg(F.count_if((F.col("ts") >= F.lit("2024-01-23").cast("timestamp")) & (F.col("event_type") == "signup")).alias("recent"), F.count("*").alias("ever"))
    any_recent = e.agg(F.max("recent").alias("m"))
    n = F.when(F.col("m") > 0, F.col("recent")).otherwise(F.col("ever"))
    return e.crossJoin(F.broadcast(any_recent)).select("concern", F.when(n >= 3, 1.0).when(n >= 1, 0.7).otherwise(0.5).alias("activity"))


@query("a5_arbitration", "SELECT least(l_suppkey, l_partkey % 100 + 1) AS id1, greatest(l_suppkey, l_partkey % 100 + 1) AS id2, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 5")
def a5(spark, d):
    a, b = F.col("l_suppkey"), F.col("l_partkey") % 100 + 1
    return table(spark, d, "lineitem").groupBy(F.least(a, b).alias("id1"), F.greatest(a, b).alias("id2")).agg(F.count("*").alias("n")).where("n >= 5")


@query("a6_clusters", f"WITH {STORE}, t AS (SELECT * FROM store WHERE confidence > 0.6 ORDER BY confidence DESC, id LIMIT 500) SELECT source_agent, count(*) AS n, round(avg(confidence), 6) AS avg_confidence, arg_max(id, (confidence, length(summary), id)) AS representative, array_to_string(list_slice(list_sort(list(id)), 1, 5), ',') AS refs FROM t GROUP BY source_agent HAVING count(*) >= 3")
def a6(spark, d):
    t = store(spark, d).where("confidence > 0.6").orderBy(F.desc("confidence"), "id").limit(500)
    g = t.groupBy("source_agent").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.max_by("id", F.struct("confidence", F.length("summary"), "id")).alias("representative"), F.array_join(F.slice(F.sort_array(F.collect_list("id")), 1, 5), ",").alias("refs"))
    return g.where("n >= 3")


@query("a7_archive_refresh", "WITH r AS (SELECT l_partkey AS entity, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS n FROM lineitem) SELECT entity, count(*) AS entry_count, substr(string_agg(CASE WHEN n <= 3 THEN l_orderkey || '/' || l_linenumber END, '；' ORDER BY n), 1, 500) AS summary FROM r GROUP BY entity")
def a7(spark, d):
    lines = table(spark, d, "lineitem")
    w = Window.partitionBy("entity").orderBy(F.desc("l_orderkey"), F.desc("l_linenumber"))
    top = lines.select(F.col("l_partkey").alias("entity"), "l_orderkey", "l_linenumber").withColumn("n", F.row_number().over(w)).where("n <= 3")
    text = top.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("n", F.concat_ws("/", "l_orderkey", "l_linenumber").alias("t")))).alias("x"))
    counts = lines.groupBy(F.col("l_partkey").alias("entity")).agg(F.count("*").alias("entry_count"))
    return counts.join(text, "entity").select("entity", "entry_count", F.substring(F.array_join(F.transform("x", lambda s: s["t"]), "；"), 1, 500).alias("summary"))


@query("a8_top_entities", "SELECT l_partkey AS entity, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, entity LIMIT 20")
def a8(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("entity")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(20)


@query("a9_k11_dashboard", "SELECT user_id % 10 AS agent, CAST(ts AS DATE) AS day, count(*) AS events, count(*) FILTER (event_type <> 'error') AS passed, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 2) AS pass_pct FROM events GROUP BY 1, 2")
def a9(spark, d):
    ok = F.count_if(F.col("event_type") != "error")
    return table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("agent"), F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("events"), ok.alias("passed"), F.round(100.0 * ok / F.count("*"), 2).alias("pass_pct"))


@query("a10_k12_storms", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'purchase') AS writes, count(*) FILTER (event_type = 'view') AS reads, count(*) FILTER (event_type = 'purchase') > 1 AS write_storm, count(*) FILTER (event_type = 'view') > 3 AS read_storm FROM events GROUP BY 1, 2 HAVING write_storm OR read_storm")
def a10(spark, d):
    g = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count_if(F.col("event_type") == "purchase").alias("writes"), F.count_if(F.col("event_type") == "view").alias("reads"))
    return g.withColumn("write_storm", F.col("writes") > 1).withColumn("read_storm", F.col("reads") > 3).where("write_storm or read_storm")


@query("a11_z4_snapshot", f"WITH {STORE} SELECT type, count(*) AS n, count(*) FILTER (g1_check_passed = 0) AS g0, count(*) FILTER (g1_check_passed = 1) AS g1, count(*) FILTER (g1_check_passed = 2) AS g2, sum(train_eligible)::BIGINT AS eligible, max(updated_at) AS updated, max(timestamp) AS latest FROM store GROUP BY type")
def a11(spark, d):
    return store(spark, d).groupBy("type").agg(F.count("*").alias("n"), *[F.count_if(F.col("g1_check_passed") == i).alias(f"g{i}") for i in range(3)], F.sum("train_eligible").alias("eligible"), F.max("updated_at").alias("updated"), F.max("timestamp").alias("latest"))


@query("a12_a13_drift", f"WITH {STORE}, b AS (SELECT count(*) AS n, sum(g1_check_passed) AS g FROM store WHERE doc_id % 10 <> 0), c AS (SELECT count(*) AS n, sum(g1_check_passed) AS g FROM store) SELECT b.n AS before, c.n AS after, abs(c.n - b.n) / b.n::DOUBLE > 0.005 AS rows_drift, abs(c.g - b.g) > 100 AS g1_drift, abs(c.n - b.n) / b.n::DOUBLE >= 0.1 AS corpus_drift FROM b, c")
def a12(spark, d):
    s = store(spark, d)
    n, g = F.count("*"), F.sum("g1_check_passed")
    both = s.agg(F.count_if(F.col("doc_id") % 10 != 0).alias("before"), n.alias("after"), F.sum(F.when(F.col("doc_id") % 10 != 0, F.col("g1_check_passed"))).alias("gb"), g.alias("ga"))
    change = F.abs(F.col("after") - F.col("before")) / F.col("before")
    return both.select("before", "after", (change > 0.005).alias("rows_drift"), (F.abs(F.col("ga") - F.col("gb")) > 100).alias("g1_drift"), (change >= 0.1).alias("corpus_drift"))


@query("a14_e15_quantiles", "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, any_value(n) AS n, max(value) FILTER (i = n // 4) AS p25, max(value) FILTER (i = n // 2) AS p50, max(value) FILTER (i = 3 * n // 4) AS p75, max(value) FILTER (i = greatest(0, CAST(floor(n * 0.9::DOUBLE) AS BIGINT) - 1)) AS p90, round(avg(value), 6) AS mean FROM r GROUP BY user_id")
def a14(spark, d):
    """Nearest-index quantiles, as sorted lists are indexed."""
    w = Window.partitionBy("user_id")
    r = table(spark, d, "events").withColumn("i", F.row_number().over(w.orderBy("value")) - 1).withColumn("n", F.count("*").over(w))

    def at(i):
        return F.max(F.when(F.col("i") == i, F.col("value")))

    return r.groupBy("user_id").agg(F.max("n").alias("n"), at(F.expr("n div 4")).alias("p25"), at(F.expr("n div 2")).alias("p50"), at(F.expr("3 * n div 4")).alias("p75"), at(F.greatest(F.lit(0), F.floor(F.col("n") * 0.9) - 1)).alias("p90"), F.round(F.avg("value"), 6).alias("mean"))


@query("a15_u4_rank_compare", f"WITH {STORE}, a AS (SELECT id, row_number() OVER (ORDER BY importance DESC, id) AS ra FROM store QUALIFY ra <= 50), b AS (SELECT id, row_number() OVER (ORDER BY confidence DESC, id) AS rb FROM store QUALIFY rb <= 50) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'kept' END AS state, ra - rb AS delta FROM a FULL JOIN b ON a.id = b.id")
def a15(spark, d):
    s = store(spark, d)

    def top(col, name):  # 50 rows come to the window
        return s.orderBy(F.desc(col), "id").limit(50).select("id", F.row_number().over(Window.orderBy(F.desc(col), "id")).alias(name))

    j = top("importance", "ra").join(top("confidence", "rb"), "id", "full")
    state = F.when(F.col("ra").isNull(), "added").when(F.col("rb").isNull(), "removed").otherwise("kept")
    return j.select("id", state.alias("state"), (F.col("ra") - F.col("rb")).cast("long").alias("delta"))


@query("a16_z2_integrity", "SELECT (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)) AS dangling_parts, (SELECT count(*) FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey) AS orders_without_lines, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS suppliers_used, (SELECT count(*) FROM (SELECT l_partkey FROM lineitem UNION SELECT l_suppkey + 100000 FROM lineitem)) AS endpoints")
def a16(spark, d):
    lines, orders, parts = (table(spark, d, t) for t in ("lineitem", "orders", "part"))
    dangling = lines.join(parts, lines.l_partkey == parts.p_partkey, "left_anti").agg(F.count("*").alias("dangling_parts"))
    empty = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_anti").agg(F.count("*").alias("orders_without_lines"))
    used = lines.agg(F.countDistinct("l_suppkey").alias("suppliers_used"))
    ends = lines.select(F.col("l_partkey").alias("e")).union(lines.select(F.col("l_suppkey") + 100000)).distinct().agg(F.count("*").alias("endpoints"))
    return dangling.crossJoin(empty).crossJoin(used).crossJoin(ends)  # four rows of one value


@query("a17_repeats", f"WITH {STORE} SELECT id, source_agent, summary_hash, count(*) OVER (PARTITION BY source_agent, summary_hash) AS repeats FROM store")
def a17(spark, d):
    return store(spark, d).select("id", "source_agent", "summary_hash", F.count("*").over(Window.partitionBy("source_agent", "summary_hash")).alias("repeats"))


@query("a18_w7_stability", "WITH r AS (SELECT user_id % 10 AS bank, CAST(ts AS DATE) AS day, avg(CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS rate FROM events GROUP BY 1, 2), w AS (SELECT *, max(rate) OVER v - min(rate) OVER v AS spread, count(*) OVER v AS n FROM r WINDOW v AS (PARTITION BY bank ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT bank, day, round(spread, 6) AS spread, (n = 3 AND spread <= 0.03) AS stable FROM w")
def a18(spark, d):
    r = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("bank"), F.col("ts").cast("date").alias("day")).agg(F.avg(F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)).alias("rate"))
    w = Window.partitionBy("bank").orderBy("day").rowsBetween(-2, 0)
    spread = F.max("rate").over(w) - F.min("rate").over(w)
    return r.select("bank", "day", F.round(spread, 6).alias("spread"), ((F.count("*").over(w) == 3) & (spread <= 0.03)).alias("stable"))


def checksum(df, key, value):
    """A checksum of all rows that does not depend on their order and needs no global sort: sums of row hashes."""
    h = F.sha2(F.concat_ws("|", key, value), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")) for i in range(2)]
    return df.agg(F.count("*").alias("n"), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 16).alias("checksum"))


@query("a19_k9_checksum", f"WITH {STORE}, h AS (SELECT sha256(concat_ws('|', id, summary)) AS h FROM store), p AS (SELECT count(*) AS n, sum(CAST('0x' || substr(h, 1, 8) AS BIGINT)) AS a, sum(CAST('0x' || substr(h, 9, 8) AS BIGINT)) AS b FROM h) SELECT n, substr(sha256(concat_ws('|', a, b)), 1, 16) AS checksum FROM p")
def a19(spark, d):
    return checksum(store(spark, d), "id", "summary")


def auroc(scores, label, score):
    """Area under the ROC curve by rank sums with mean ranks of ties; ranks come from counts of distinct scores."""
    g = scores.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    w = Window.orderBy(score)  # distinct scores only; round them to bound their number
    r = g.withColumn("below", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return r.agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auroc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


@query("a21_z14_auroc", "WITH s AS (SELECT CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, round(value, 1) AS v FROM events), r AS (SELECT y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r FROM s) SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auroc, count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives FROM r")
def a21(spark, d):
    s = table(spark, d, "events").select(F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("y"), F.round("value", 1).alias("v"))
    return auroc(s, "y", "v").withColumn("auroc", F.round("auroc", 6))


@query("t4_t5_stale", f"WITH {STORE} SELECT id, updated_at, importance FROM store WHERE updated_at < '2026-08-02T00:00:00Z' AND half_life <> 'permanent' ORDER BY importance, id LIMIT 20")
def t4(spark, d):
    return store(spark, d).where("updated_at < '2026-08-02T00:00:00Z' and half_life <> 'permanent'").orderBy("importance", "id").limit(20).select("id", "updated_at", "importance")


@query("t2_u1_pool", "WITH c AS (SELECT user_id, event_id, value FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, event_id, value FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 60)), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM c) SELECT user_id, event_id FROM r WHERE n <= 30")
def t2(spark, d):
    e = table(spark, d, "events")
    seen = e.where("event_type = 'signup' and value > 60").select("user_id").distinct()
    c = e.where("event_type = 'view'").unionByName(e.where("event_type = 'click'").join(seen, "user_id", "left_anti").select(*e.columns))
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return c.withColumn("n", F.row_number().over(w)).where("n <= 30").select("user_id", "event_id")


@query("u2_u3_sets", f"WITH {STORE} SELECT substr(summary, 1, 30) AS prefix FROM store WHERE source_agent = 'src0' INTERSECT SELECT substr(summary, 1, 30) FROM store WHERE source_agent <> 'src0'")
def u2(spark, d):
    s = store(spark, d)
    p = F.substring("summary", 1, 30).alias("prefix")
    return s.where("source_agent = 'src0'").select(p).intersect(s.where("source_agent <> 'src0'").select(p))


@query("w8_first_seen", "SELECT user_id, min(event_id) AS first_event, count(*) AS n FROM events GROUP BY user_id, event_type HAVING event_type = 'view'")
def w8(spark, d):
    return table(spark, d, "events").where("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))
