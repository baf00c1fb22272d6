"""Streaming forms of the log aggregates: the same columns as the batch forms, over windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())]
)


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", late: str = "1 hour") -> DataFrame:
    """Events as they arrive in a folder, with a watermark on ts."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed_misses(events: DataFrame, width: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Hits and misses of each trailing window."""
    hit = F.col("event_type").isin("click", "purchase")
    return events.groupBy(F.window("ts", width, slide)).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))


def windowed_usage(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Accesses of each entry in each window."""
    return events.groupBy(F.window("ts", width), "user_id").agg(F.count("*").alias("uses"), F.max("ts").alias("last_at"))


def storms(events: DataFrame, most: int = 10) -> DataFrame:
    """Readers with more operations in an hour than allowed."""
    return events.groupBy(F.window("ts", "1 hour"), "user_id").agg(F.count("*").alias("ops")).where(F.col("ops") > most)


def drained(frame: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """All rows that the stream has by now, in complete mode through a memory table."""
    run = frame.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination(300)
    return frame.sparkSession.table(name)
