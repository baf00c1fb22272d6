"""What answers are worth: rules that refuse or mark them, figures checked against the entries found, a judge that must prove itself, gates over golden sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Search
from ..functions.extract import key_data, name_key

# Scores below which an answer is refused or marked, its evidence, a sure entry's confidence and how many entries are looked at; a judge's and two gates' floors.
REFUSED, MARKED, EVIDENCE, SURE, LOOKED_AT = 0.01, 0.03, 0.10, 0.8, 5
CERTIFIED, RELATIONS_FOUND = 0.7, 0.80
#: Grades of a judge's score, best first.
GRADES = ((0.25, "strong"), (0.05, "medium"), (0.01, "low"))


def checked_answers(queries: DataFrame, hits: DataFrame, cfg: Search, known: tuple[str, ...] = ()) -> DataFrame:
    """(qid, action, reasons, would_block, best) of every query (qid), from its hits (qid, rank0, score, mode, source_agent, confidence, evidence).

    Refused: the best score on the common scale is too low (a query without hits, or with the latest entries in their place, has none), or the best evidence
    where there is any. Marked: the score is low, the first hit's source is unknown or empty, or one of the first five is unsure. Queries that words alone
    answer are skipped. Reasons are told in this order.
    """
    norm = F.when(F.col("mode") == "time_desc", 0.0).otherwise(F.col("score") * cfg.weight_factor)
    first = F.max(F.when(F.col("rank0") == 0, F.trim(F.coalesce("source_agent", F.lit("")))))
    g = hits.groupBy("qid").agg(
        F.round(F.max(norm), 9).alias("best"), F.max("evidence").alias("evidence"), first.alias("agent"), F.bool_or(F.col("mode").startswith("fts_only")).alias("words"),
        F.count_if((F.col("rank0") < LOOKED_AT) & (F.col("confidence") < SURE)).alias("unsure"),
    )
    j = queries.select("qid").distinct().join(g, "qid", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    unknown = (F.col("agent") != "") & ~F.col("agent").isin(*known) if known else F.lit(False)
    told = F.array_compact(
        F.array(
            F.when(F.col("best") < REFUSED, "relevance_refuse").when(F.col("best") < MARKED, "relevance_mark"),
            F.when(F.col("evidence") < EVIDENCE, "evidence_refuse"),
            F.when(unknown, "source_domain_unknown").when(F.col("agent") == "", "source_domain_empty"),
            F.when(F.col("unsure") > 0, "low_confidence"),
        )
    )
    skipped = F.coalesce("words", F.lit(False))
    j = j.withColumn("reasons", F.when(skipped, F.array().cast("array<string>")).otherwise(told))
    refused = F.exists("reasons", lambda r: r.endswith("_refuse"))
    action = F.when(skipped, "skipped").when(refused, "refuse").when(F.size("reasons") > 0, "mark").otherwise("pass")
    return j.select("qid", action.alias("action"), "reasons", refused.alias("would_block"), "best")


def enforced(hits: DataFrame, checked: DataFrame) -> DataFrame:
    """The hits that remain when the rules are enforced: none of a refused query; unsure ones of a marked query are told (low_confidence)."""
    kept = hits.join(checked.select("qid", "action"), "qid").where("action <> 'refuse'")
    low = (F.col("action") == "mark") & (F.col("rank0") < LOOKED_AT) & (F.col("confidence") < SURE)
    return kept.withColumn("low_confidence", F.coalesce(low, F.lit(False))).drop("action")


def answer_verdicts(queries: DataFrame, hits: DataFrame, store: DataFrame, radius: int = 40) -> DataFrame:
    """(qid, id, passed, total, passed_all, evidence) of the hits (qid, id) of queries (qid, text) that tell figures: which of them stand in the entry.

    evidence is an array of (type, token, passed, snippet) in the order of the question; conclusions need not be found and have no snippet. Queries without
    figures have no rows, and their hits' texts are not read.
    """
    asked = queries.select("qid", key_data(F.col("text")).alias("keys")).where(F.size("keys") > 0)
    whole = F.concat(F.coalesce("content", F.lit("")), F.lit("\n"), F.coalesce("summary", F.lit("")))
    j = hits.select("qid", "id").join(asked, "qid").join(store.select("id", whole.alias("whole")), "id")

    def verdict(k: Column) -> Column:
        strict, at = k["kind"] != "conclusion", F.call_function("locate", k["value"], F.col("whole"))
        low = F.greatest(at - radius, F.lit(1))
        near = F.when(strict & (at > 0), F.substring(F.col("whole"), low, at + F.length(k["value"]) + radius - low))
        return F.struct(k["kind"].alias("type"), k["value"].alias("token"), (~strict | (at > 0)).alias("passed"), near.alias("snippet"))

    out = j.withColumn("evidence", F.transform("keys", verdict))
    passed = F.size(F.filter("evidence", lambda v: v["passed"]))
    return out.select("qid", "id", passed.alias("passed"), F.size("evidence").alias("total"), (passed == F.size("evidence")).alias("passed_all"), "evidence")


def judges(samples: DataFrame) -> DataFrame:
    """(judge, auroc, certified) from scored samples (judge, positive, score): how often a right pair scores above a wrong one, ties half.

    Scores count to four places, and rows are counted by score first: what is summed in order is a judge's distinct scores. A judge that has only one kind of samples is not certified.
    """
    n = samples.groupBy("judge", F.round("score", 4).alias("score")).agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("judge").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.withColumn("won", F.col("p") * (below + F.col("n") / 2.0))
    both = F.sum("p") * F.sum("n")
    area = n.groupBy("judge").agg(F.round(F.when(both > 0, F.sum("won") / both), 6).alias("auroc"))
    return area.withColumn("certified", F.coalesce(F.col("auroc") >= CERTIFIED, F.lit(False)))


def graded_by(scored: DataFrame, proven: DataFrame) -> DataFrame:
    """scored (judge, score, ...) with a grade; judges that are not certified give none, missing scores are unknown."""
    own = F.lit("weak")
    for floor, name in reversed(GRADES):
        own = F.when(F.col("score") >= floor, name).otherwise(own)
    grade = F.when(~F.coalesce("certified", F.lit(False)), None).when(F.col("score").isNull(), "unknown").otherwise(own)
    return scored.join(proven.select("judge", "certified"), "judge", "left").withColumn("grade", grade).drop("certified")


def hop_gate(found: DataFrame, golden: DataFrame, deprecated: DataFrame, complexity: DataFrame, least: float, k: int = 5) -> DataFrame:
    """One row (n, hit, hit_rate, complex_n, simple_n, verdict) over all answerable queries: found (qid, id, rank0), golden (qid, id), deprecated (id), complexity (qid, level).

    A query is hit if one of its first k is expected and not deprecated; without any query the gate fails.
    """
    valid = golden.select("qid", "id").distinct().join(deprecated.select("id").distinct(), "id", "left_anti")
    hit = found.where(F.col("rank0") < k).join(valid, ["qid", "id"], "left_semi").select("qid").distinct().withColumn("_hit", F.lit(1))
    asked = golden.select("qid").distinct().join(complexity.select("qid", "level"), "qid", "left").join(hit, "qid", "left")
    out = asked.agg(F.count("*").alias("n"), F.count("_hit").alias("hit"), F.count_if(F.col("level") == "complex").alias("complex_n"), F.count_if(F.col("level") == "simple").alias("simple_n"))
    rate = F.coalesce(F.round(F.try_divide(F.col("hit"), F.col("n")), 4), F.lit(0.0))
    return out.select("n", "hit", rate.alias("hit_rate"), "complex_n", "simple_n", F.when((F.col("n") > 0) & (rate >= least), "PASS").otherwise("FAIL").alias("verdict"))


def relation_hits(extracted: DataFrame, golden: DataFrame) -> DataFrame:
    """(id, hit) of golden items: extracted (id, subject, relation, object); golden (id, subject, relation, object), with a null relation where nothing may be found.

    An expected relation is found if one of the same kind has both names equal or one inside the other, without marks and cases; of an event the object decides.
    All that an item expects must be found; an item that expects nothing must have nothing extracted.
    """
    got = extracted.select("id", "relation", name_key(F.col("subject")).alias("s"), name_key(F.col("object")).alias("o"))
    want = golden.withColumn("_n", F.monotonically_increasing_id()).select("id", "_n", F.lower(F.trim("relation")).alias("relation"), name_key(F.col("subject")).alias("ws"), name_key(F.col("object")).alias("wo"))

    def like(a: str, b: str) -> Column:
        return F.contains(a, F.col(b)) | F.contains(b, F.col(a))

    met = want.join(got, ["id", "relation"], "left")
    right = like("o", "wo") & ((F.col("relation") == "event_occurred") | like("s", "ws"))
    each = met.groupBy("id", "_n", "relation").agg(F.coalesce(F.bool_or(right), F.lit(False)).alias("ok"))
    some = extracted.select("id").distinct().withColumn("_some", F.lit(True))
    each = each.join(some, "id", "left").withColumn("ok", F.when(F.col("relation").isNull(), F.col("_some").isNull()).otherwise(F.col("ok")))
    return each.groupBy("id").agg(F.bool_and("ok").alias("hit"))


def relation_accuracy(hits: DataFrame, least: float = RELATIONS_FOUND) -> DataFrame:
    """One row (total, hits, accuracy, passed)."""
    n, ok = F.count("*"), F.count_if("hit")
    rate = F.coalesce(F.round(F.try_divide(ok, n), 4), F.lit(0.0))
    return hits.agg(n.alias("total"), ok.alias("hits"), rate.alias("accuracy"), (rate >= least).alias("passed"))
