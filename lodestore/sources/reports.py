"""Reports that other jobs leave behind, and hits of several sources side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.containment import holding

#: A report of a skill's evaluation: either form of its gate and of a layer's state.
REPORT = "schema string, asset string, label string, version string, gate string, run struct<timestamp: string, ts: string, started_at: string>, layers array<struct<status: string, passed: boolean>>"
# Figures of a weekly report on routes.
ADVICE, ADOPTED, CRYSTAL, RARE = r"建议总数：\*\*(\d+)\*\*", r"采纳率（hit/\(hit\+miss\)）：([\d.]+)%", r"结晶命中总数：\*\*(\d+)\*\*", r"低频提示（命中 ≤\d+ 次）：(.+)|低频提示：(无（无命中|.+)"


def newest(reports: DataFrame, *by: str) -> DataFrame:
    """The newest report (path, modified, value) of each group, by time and path."""
    return reports.groupBy(*by).agg(F.max_by(F.struct("path", "modified", "value"), F.struct("modified", "path")).alias("r")).select(*by, "r.*")


def evaluation(value: Column) -> Column:
    """(asset, gate, run_ts, layers_total, layers_passed) of a JSON report; null for a text that is no JSON object."""
    r = F.from_json(value, REPORT)
    gate = F.when(r["gate"].startswith("{"), F.coalesce(F.get_json_object(r["gate"], "$.decision"), F.get_json_object(r["gate"], "$.verdict"))).otherwise(r["gate"])
    good = F.filter(r["layers"], lambda x: F.coalesce(x["status"] == "pass", F.lit(False)) | F.coalesce(x["passed"], F.lit(False)))
    at = F.coalesce(r["run"]["timestamp"], r["run"]["ts"], r["run"]["started_at"])
    fields = (r["asset"].alias("asset"), gate.alias("gate"), at.alias("run_ts"), F.size(r["layers"]).alias("layers_total"), F.size(good).alias("layers_passed"))
    return F.when(value.rlike(r"(?s)^\s*\{.*\}\s*\z"), F.struct(*fields))


def route_figures(value: Column) -> Column:
    """(advice_total, adoption_rate_pct, crystal_hits, low_freq) of a weekly report in Markdown; what it does not tell is null."""

    def found(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))

    rare = F.trim(F.coalesce(found(RARE), found(RARE, 2)))
    return F.struct(found(ADVICE).cast("int").alias("advice_total"), found(ADOPTED).cast("double").alias("adoption_rate_pct"), found(CRYSTAL).cast("int").alias("crystal_hits"), rare.alias("low_freq"))


def federated_hits(questions: DataFrame, sources: dict[str, DataFrame], limit: int) -> DataFrame:
    """(qid, rank, source, item, score) of questions (qid, text): what each source's rows (item, text, name, newest) hold a question in text or name, whatever the case.

    A source's hits go newest first, ``limit`` of each; the sources stand side by side by rank, and none adds to another's score. All rows of a source are looked at.
    """
    asked = questions.select("qid", F.lower(F.trim("text")).alias("_q")).where("_q <> ''")
    hits = None
    for source, rows in sources.items():
        every = rows.select("item", F.lower("text").alias("text"), F.lower("name").alias("name"))
        # a text and a name are told apart by a character that no question can hold across
        whole = every.select("item", F.concat_ws("\u0000", "name", "text").alias("whole"))
        found = holding(whole, "item", "whole", asked, "qid", "_q").join(rows.select("item", "newest"), "item")
        turn = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("newest"), "item"))
        own = found.withColumn("_n", turn).where(F.col("_n") <= limit).select("qid", F.lit(source).alias("source"), "item", "_n")
        hits = own if hits is None else hits.unionByName(own)
    side = F.row_number().over(Window.partitionBy("qid").orderBy("_n", "source"))
    return hits.select("qid", side.alias("rank"), "source", "item", F.round(1.0 / (F.col("_n") + 60), 6).alias("score"))
