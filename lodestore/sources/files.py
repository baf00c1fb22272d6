"""File sources and sinks: line logs, whole texts with front matter, asset scanners, versioned snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clip, summary_hash

MISS_LOG = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("query", T.StringType()), T.StructField("hit", T.BooleanType()), T.StructField("search_mode", T.StringType())])


def read_log(spark: SparkSession, path: str, schema: T.StructType = MISS_LOG, since: str | None = None) -> DataFrame:
    """JSON lines; lines that are no JSON object are skipped."""
    log = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return log if since is None else log.where(F.col("ts") >= F.lit(since).cast("timestamp"))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of whole files under a folder."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def asset_type(path: Column, text: Column) -> Column:
    """Type of an asset by its name, else by words of its text."""
    low = F.lower(path)
    rules = [
        (r"/skill\.md$", "skill"), (r"\.(ya?ml|json|toml|conf|ini|plist)$", "config"), (r"workflow", "workflow"), (r"monitor|watch", "monitor"),
        (r"bench|eval", "benchmark"), (r"rule|gate", "rule"), (r"\.(py|sh|js|ts)$", "script"), (r"spec|sop", "spec"),
    ]
    out = F.lit(None).cast("string")
    for pattern, kind in rules:
        out = F.coalesce(out, F.when(low.rlike(pattern), kind))
    words = F.when(F.concat(low, text).rlike(r"(?i)design|architecture|方案|设计"), "design").when(F.concat(low, text).rlike(r"(?i)research|survey|调研"), "research")
    return F.coalesce(out, words, F.lit("reference"))


def first_doc(text: Column) -> Column:
    """The first heading, comment or plain line of a file."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[#/\*\s\"']+", ""))), lambda x: (F.length(x) > 3) & ~x.rlike(r"^(usr/bin|!|-\*-|---)"))
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


def headings(text: Column, most: int = 8) -> Column:
    """Headings of the first two levels among the first 60 lines, joined."""
    lines = F.slice(F.split(text, "\n"), 1, 60)
    found = F.transform(F.filter(lines, lambda x: x.rlike(r"^#{1,2}\s")), lambda x: F.trim(F.regexp_replace(x, r"^#+", "")))
    return F.array_join(F.slice(found, 1, most), "；")


def assets(texts: DataFrame, skip: tuple[str, ...] = ("backup", ".bak", "/.", "/_", "audit", "/logs/")) -> DataFrame:
    """(type, name, summary, content, source_ref, summary_hash) of whole files: one scanner for all kinds of assets."""
    kept = texts
    for word in skip:
        kept = kept.where(~F.regexp_replace("path", "^file:", "").contains(word))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    lead = F.when(F.length(headings(F.col("value"))) > 0, headings(F.col("value"))).otherwise(first_doc(F.col("value")))
    out = kept.select(asset_type(F.col("path"), F.substring("value", 1, 400)).alias("type"), name.alias("name"), clip(F.concat(name, F.lit("："), lead)).alias("summary"), F.col("value").alias("content"), F.col("path").alias("source_ref"))
    return out.withColumn("summary_hash", summary_hash(F.col("summary")))


def scheduled(lines: DataFrame) -> DataFrame:
    """Records of a task listing (line number n, value): a line in brackets starts one, key lines follow; one row each."""
    from pyspark.sql import Window

    start = F.col("value").rlike(r"^\s*\[\w+\]").cast("int")
    numbered = lines.withColumn("rec", F.sum(start).over(Window.partitionBy("path").orderBy("n")))
    kv = numbered.where("rec > 0").select("path", "rec", F.lower(F.trim(F.regexp_extract("value", r"^\s*(Name|Schedule|Script)\s*:", 1))).alias("k"), F.trim(F.regexp_extract("value", r"^\s*\w+\s*:(.*)$", 1)).alias("v")).where("k <> ''")
    return kv.groupBy("path", "rec").pivot("k", ["name", "schedule", "script"]).agg(F.first("v"))


def write_snapshot(store: DataFrame, root: str, version: str) -> None:
    """A version of all columns under a folder of its own; an existing version is never overwritten."""
    store.write.mode("error").parquet(f"{root}/version={version}")


def read_snapshot(spark: SparkSession, root: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root}/version={version}")


def redacted(params: Column, secret: tuple[str, ...] = ("token", "password", "secret", "key")) -> Column:
    """A map of call parameters for the audit: secrets dropped, texts cut to 50 characters."""
    kept = F.map_filter(params, lambda k, _: ~F.lower(k).rlike("|".join(secret)))
    return F.transform_values(kept, lambda _, v: F.when(F.length(v) > 50, F.concat(F.substring(v, 1, 50), F.lit("…"))).otherwise(v))
