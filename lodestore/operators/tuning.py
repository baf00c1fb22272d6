"""Weights of a search's channels: the best of a grid, and the gates that it must pass to replace the present ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How much worse still counts as equal; by how much a corpus may change before its figures are no baseline any more.
TOLERANCE, CORPUS_DRIFT = 1e-9, 0.10


def scored_grid(channels: dict[str, DataFrame], golden: DataFrame, grid: list[tuple[float, ...]], rrf_k: int = 60, k: int = 5) -> DataFrame:
    """(g, qid, ndcg) of each setting of channel weights and each golden query, in one job: a channel's ranks are computed once and meet the grid, a stated few rows.

    channels (qid, id, rank0); golden (qid, id). The discount is linear; a query without a hit has 0.
    """
    spark, parts = golden.sparkSession, None
    for name, channel in channels.items():
        part = channel.select("qid", "id", "rank0", F.lit(name).alias("c"))
        parts = part if parts is None else parts.unionByName(part)
    settings = F.broadcast(spark.createDataFrame([(g, c, float(w)) for g, own in enumerate(grid) for c, w in zip(channels, own, strict=True)], "g int, c string, w double"))
    wanted = golden.select("qid", "id").distinct()
    each = parts.join(wanted.select("qid").distinct(), "qid", "left_semi").join(settings, "c").groupBy("g", "qid", "id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank0") / F.col("w") + 1)), 9).alias("s"))
    top = each.withColumn("rank0", F.row_number().over(Window.partitionBy("g", "qid").orderBy(F.desc("s"), "id")) - 1).where(F.col("rank0") < k)
    gain = top.join(wanted, ["qid", "id"]).groupBy("g", "qid").agg(F.sum(1.0 / (F.col("rank0") + 2)).alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n")).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / (i + 1))
    asked = wanted.groupBy("qid").agg(F.count("*").alias("n")).select("qid", ideal.alias("ideal")).crossJoin(F.broadcast(spark.range(len(grid)).select(F.col("id").cast("int").alias("g"))))
    return asked.join(gain, ["g", "qid"], "left").select("g", "qid", F.round(F.coalesce("gain", F.lit(0.0)) / F.col("ideal"), 6).alias("ndcg"))


def tuned(scores: DataFrame, current: int, baseline: int | None, trained: Column, history: DataFrame) -> DataFrame:
    """One row: the setting of the best mean over training queries, and whether it may replace the current one.

    It may if its mean over the others is no lower and no query is answered worse, neither of those nor of the history of earlier regressions (qid).
    The baseline is scored but is no candidate; of equal settings the first counts.
    """
    means = scores.where(trained).groupBy("g").agg(F.round(F.avg("ndcg"), 6).alias("train"))
    means = means if baseline is None else means.where(F.col("g") != baseline)
    best = means.agg(F.max(F.struct("train", (-F.col("g")).alias("o"))).alias("b")).select((-F.col("b.o")).alias("candidate"), F.col("b.train").alias("train_ndcg"))
    now = scores.where(F.col("g") == current).select("qid", F.col("ndcg").alias("now"))
    then = scores.join(F.broadcast(best), F.col("g") == F.col("candidate")).select("qid", F.col("ndcg").alias("then"))  # one row
    both = now.join(then, "qid").withColumn("train", trained).join(history.select("qid").distinct().withColumn("known", F.lit(True)), "qid", "left")
    worse, val = F.col("then") < F.col("now") - TOLERANCE, ~F.col("train")
    gate = both.agg(
        F.round(F.avg(F.when(val, F.col("now"))), 6).alias("val_current"), F.round(F.avg(F.when(val, F.col("then"))), 6).alias("val_candidate"),
        F.count_if(val & worse).alias("degraded"), F.count_if(F.col("known") & worse).alias("history_degraded"),
    )
    passed = (F.col("val_candidate") >= F.col("val_current") - TOLERANCE) & (F.col("degraded") == 0) & (F.col("history_degraded") == 0)
    decision = F.when(F.col("candidate") == current, "no_change").when(passed, "gate_pass").otherwise("gate_fail")
    return best.crossJoin(gate).withColumn("decision", decision)  # one row by one


def past_regressions(logs: DataFrame) -> DataFrame:
    """(qid) that any run of a monthly log (lines of JSON with regress_detail: [{id}] or [id]) has told of as worse; lines that are no JSON are skipped."""
    ids = F.coalesce(F.from_json(F.get_json_object("value", "$.regress_detail[*].id"), "array<string>"), F.from_json(F.get_json_object("value", "$.regress_detail"), "array<string>"))
    one = F.array(F.get_json_object("value", "$.regress_detail[0].id"))
    found = logs.select(F.explode(F.coalesce(ids, one)).alias("qid")).where("qid is not null and left(qid, 1) <> '{'")
    return found.distinct()


def monthly_gate(base: DataFrame, now: DataFrame, rows_before: int, rows_now: int, weights_before: dict, weights_now: dict) -> DataFrame:
    """One row from per-query figures (qid, ndcg, p5) of a baseline and of now: means, queries that are worse, and the decision.

    A corpus that has changed by a tenth, or other weights, freezes the comparison: the old figures are no baseline for it. Else both means must be kept and no
    query of both may be worse.
    """
    both = base.select("qid", F.col("ndcg").alias("n0"), F.col("p5").alias("p0")).join(now.select("qid", F.col("ndcg").alias("n1"), F.col("p5").alias("p1")), "qid")
    out = both.agg(
        *[F.round(F.avg(c), 6).alias(n) for c, n in (("n0", "ndcg_before"), ("n1", "ndcg_now"), ("p0", "p5_before"), ("p1", "p5_now"))],
        F.count_if((F.col("n1") < F.col("n0") - TOLERANCE) | (F.col("p1") < F.col("p0") - TOLERANCE)).alias("worse"),
    )
    moved = rows_before == 0 or abs(rows_now - rows_before) / rows_before >= CORPUS_DRIFT
    out = out.withColumns({"corpus_drift": F.lit(moved), "weights_drift": F.lit(weights_before != weights_now)})
    kept = (F.col("ndcg_now") >= F.col("ndcg_before") - TOLERANCE) & (F.col("p5_now") >= F.col("p5_before") - TOLERANCE) & (F.col("worse") == 0)
    return out.withColumn("decision", F.when(F.col("corpus_drift") | F.col("weights_drift"), "freeze").when(kept, "pass").otherwise("block"))


def anchored(cases: DataFrame, answers: DataFrame, least: float = 0.65) -> DataFrame:
    """(qid, best, hit): whether an answer's vector (qid, id, vec) comes close to an anchor of its case (qid, anchor, avec): a sentence or one of its synonyms."""
    dot = F.aggregate(F.zip_with("vec", "avec", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    near = answers.join(cases, "qid").select("qid", F.round(dot / (norm("vec") * norm("avec") + 1e-9), 6).alias("s"))
    best = near.groupBy("qid").agg(F.max("s").alias("best"))
    return cases.select("qid").distinct().join(best, "qid", "left").select("qid", F.coalesce("best", F.lit(0.0)).alias("best"), (F.coalesce("best", F.lit(0.0)) >= least).alias("hit"))
