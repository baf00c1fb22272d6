"""Batch runs of the streaming aggregates, for comparison with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..streaming import logs
from .common import table


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("st1_windowed_usage", "SELECT date_trunc('day', ts) AS day, user_id, count(*) AS uses, max(ts) AS last_at FROM events GROUP BY 1, 2")
def st1(spark, d):
    return logs.windowed_usage(_events(spark, d)).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "user_id", "uses", F.col("last_at").cast("timestamp_ntz").alias("last_at"))


@query("st2_windowed_misses", "WITH w AS (SELECT unnest(range(0, 7)) AS k), e AS (SELECT date_trunc('day', ts) - to_days(CAST(k AS INT)) AS start, event_type IN ('click', 'purchase') AS hit FROM events, w) SELECT start, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM e GROUP BY start")
def st2(spark, d):
    return logs.windowed_misses(_events(spark, d)).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "hits", "misses")


@query("st3_storms", "SELECT date_trunc('hour', ts) AS hour, user_id, count(*) AS ops FROM events GROUP BY 1, 2 HAVING count(*) > 2")
def st3(spark, d):
    return logs.storms(_events(spark, d), 2).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "user_id", "ops")
