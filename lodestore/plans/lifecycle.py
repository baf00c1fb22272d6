"""Lifecycle queries: decay, expiry, promotion of importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lifecycle as L
from ..registry import query
from .common import NOW, STORE, store, table

DAYS = "(1788220800 - ts) // 86400"
HALF = "CASE half_life WHEN '30d' THEN 30 WHEN '90d' THEN 90 WHEN '8w' THEN 56 WHEN '6m' THEN 180 WHEN '2y' THEN 730 END"


def decayed(entries, now_seconds):
    """Half-life decay from the base confidence that the audit log keeps, so that a second run changes nothing.

    Rows are due once a half-life has passed; below 0.3 an entry is marked deprecated. entries needs ts (seconds), half_life,
    confidence, audit_log (array of op, value); the first decay_base event, if any, holds the base.
    """
    days = F.floor((F.lit(now_seconds) - F.col("ts")) / 86400)
    hl = L.half_life_days(F.col("half_life"))
    first = F.filter("audit_log", lambda e: e["op"] == "decay_base")
    base = F.coalesce(F.get(first, F.lit(0))["value"], F.col("confidence"))
    due = hl.isNotNull() & (days >= hl)
    new = F.when(due, L.half_life_decay(base, days, hl)).otherwise(F.col("confidence"))
    log = F.when(due & (F.size(first) == 0), F.array_append("audit_log", F.struct(F.lit("decay_base").alias("op"), F.col("confidence").alias("value")))).otherwise(F.col("audit_log"))
    out = entries.withColumn("_new", new).withColumn("_due", due).withColumn("audit_log", log).withColumn("confidence", F.col("_new"))
    return out.withColumn("deprecated", F.when(F.col("_due") & (F.col("_new") < 0.3), 1).otherwise(F.col("deprecated"))).withColumnRenamed("_due", "due").drop("_new")


@query("p18_z15_half_life", f"WITH {STORE}, t AS (SELECT *, {DAYS} AS days, {HALF} AS hl FROM store), n AS (SELECT *, coalesce(hl IS NOT NULL AND days >= hl, false) AS due FROM t), c AS (SELECT *, CASE WHEN due THEN round(greatest(0.05::DOUBLE, confidence * pow(0.5::DOUBLE, days / hl::DOUBLE)), 2) ELSE confidence END AS c2 FROM n) SELECT id, due, c2 AS confidence, CASE WHEN due AND c2 < 0.3 THEN 1 ELSE deprecated END AS deprecated, CASE WHEN due THEN 1 ELSE 0 END AS n_events FROM c")
def p18(spark, d):
    s = store(spark, d).withColumn("audit_log", F.expr("cast(array() as array<struct<op: string, value: double>>)"))
    once = decayed(s, 1788220800).drop("due")
    return decayed(once, 1788220800).select("id", "due", "confidence", "deprecated", F.size("audit_log").alias("n_events"))  # twice: idempotent


@query("p19_trust_decay", f"WITH {STORE} SELECT id, round(greatest(0.1::DOUBLE, trust_score * pow(0.95::DOUBLE, {DAYS})), 2) AS trust_score FROM store WHERE deprecated = 0")
def p19(spark, d):
    return store(spark, d).where("deprecated = 0").select("id", L.trust_decay(F.col("trust_score"), F.expr("(1788220800 - ts) div 86400")).alias("trust_score"))


@query("p20_linear_decay", f"WITH {STORE} SELECT id, round(greatest(0.1::DOUBLE, confidence - 0.1::DOUBLE), 2) AS confidence, greatest(1, importance - 1) AS importance FROM store WHERE updated_at < '2026-08-02T00:00:00Z'")
def p20(spark, d):
    c, i = L.linear_decay(F.col("confidence"), F.col("importance"))
    return store(spark, d).where("updated_at < '2026-08-02T00:00:00Z'").select("id", c.alias("confidence"), i.alias("importance"))


@query("p21_expiry", f"WITH {STORE} SELECT id, CASE WHEN deprecated = 0 AND expires_at <> '' AND substr(expires_at, 1, 19) < substr('{NOW}', 1, 19) THEN 1 ELSE deprecated END AS deprecated, CASE WHEN deprecated = 0 AND expires_at <> '' AND substr(expires_at, 1, 19) < substr('{NOW}', 1, 19) THEN '{NOW}' ELSE '' END AS deprecated_at FROM store")
def p21(spark, d):
    late = (F.col("deprecated") == 0) & (F.col("expires_at") != "") & (F.substring("expires_at", 1, 19) < NOW[:19])
    return store(spark, d).select("id", F.when(late, 1).otherwise(F.col("deprecated")).alias("deprecated"), F.when(late, NOW).otherwise("").alias("deprecated_at"))


@query("p24_distill_chain", f"WITH {STORE}, top AS (SELECT * FROM store WHERE confidence > 0.6 ORDER BY confidence DESC, id LIMIT 500), g AS (SELECT source_agent, count(*) AS n, avg(confidence) AS c FROM top GROUP BY 1 HAVING count(*) >= 3) SELECT substr(md5('pattern:' || source_agent), 1, 16) AS id, 'principle' AS type, least(10, 5 + n // 5) AS importance, round(c, 6) AS confidence FROM g")
def p24(spark, d):
    top = store(spark, d).where("confidence > 0.6").orderBy(F.desc("confidence"), "id").limit(500)
    g = top.groupBy("source_agent").agg(F.count("*").alias("n"), F.avg("confidence").alias("c")).where("n >= 3")
    return g.select(F.substring(F.md5(F.concat(F.lit("pattern:"), "source_agent")), 1, 16).alias("id"), F.lit("principle").alias("type"), F.least(F.lit(10), 5 + F.expr("n div 5")).alias("importance"), F.round("c", 6).alias("confidence"))


@query("z11_open_cards", "WITH new AS (SELECT 'miss ' || user_id AS title, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 5), open AS (SELECT 'miss ' || c_custkey AS title FROM customer WHERE c_custkey % 2 = 0) SELECT title, n FROM new ANTI JOIN open USING (title)")
def z11(spark, d):
    new = table(spark, d, "events").where("event_type = 'error'").groupBy(F.concat(F.lit("miss "), F.col("user_id").cast("string")).alias("title")).agg(F.count("*").alias("n")).where("n >= 5")
    cards = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("miss "), F.col("c_custkey").cast("string")).alias("title"))
    return new.join(cards, "title", "left_anti")
