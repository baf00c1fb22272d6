"""Distilling: patterns of agents from their surest entries, the knowledge made of them, and the upkeep run around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lifecycle as L
from ..functions.extract import event_date
from ..functions.text import summary_hash
from . import ingest as I
from .retrieval import checked_broadcast

# Confidence above which an entry counts, how many entries are looked at, how many a pattern needs and refers to; entries of one run of decay.
SURE, LOOKED_AT, LEAST, REFERENCES, STALE = 0.6, 500, 3, 5, 20
#: Ids that a target holds are broadcast up to so many.
KNOWN = 1_000_000
# Kinds of curated knowledge by type, insights for all others; least confidence and importance; sources whose entries stay below; a word that asks for review.
CURATED = {"lesson": "avoid", "decision": "principles", "preference": "patterns", "pattern": "patterns", "insight": "insights", "fact": "methods", "correction": "avoid"}
CURATED_SURE, CURATED_IMPORTANT = 0.6, 3
SELF_MEDIA = ("blog", "weibo", "zhihu", "medium", "自媒体", "博客")
DOUBT = "拿不准"


def patterns(store: DataFrame) -> DataFrame:
    """(source_agent, n, confidence, summary, refs, members): what each agent's entries among the surest have in common: their surest, then longest, entry stands for them."""
    top = store.where((F.col("confidence") > SURE) & (F.col("type") != "L4b")).orderBy(F.desc("confidence"), "id").limit(LOOKED_AT)  # one task holds LOOKED_AT rows
    first = F.max_by("summary", F.struct("confidence", F.length("summary"), "id"))
    g = top.groupBy("source_agent").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), first.alias("summary"), F.sort_array(F.collect_list("id")).alias("members"))
    return g.where(F.col("n") >= LEAST).withColumn("refs", F.slice("members", 1, REFERENCES))


def distilled(found: DataFrame, at: str) -> DataFrame:
    """Entries of type L4b made of patterns: the id comes from the agent and the text, so the same pattern is the same entry; importance grows with its entries."""
    key = F.substring(F.md5(F.concat(F.lit("l4b_"), "source_agent", F.lit("_"), "summary")), 1, 16)
    return found.select(key.alias("id"), F.lit("L4b").alias("type"), "summary", "source_agent", "confidence", F.least(F.lit(10), 5 + F.expr("n div 5")).cast("int").alias("importance"), F.lit(at).alias("timestamp"), F.to_json("refs").alias("references"))


def storable(new: DataFrame, stored: DataFrame, threshold: float = 0.9) -> DataFrame:
    """New entries with what the store says to them: known (their id is there: ignored), duplicate (an entry of the store, or a lesser id of the batch that is taken, has
    nearly their summary), or stored."""
    fresh = new.join(stored.select("id"), "id", "left_anti")
    # those of the store come first in the guard's order
    texts = stored.select(F.concat(F.lit("0"), "id").alias("id"), F.col("summary").alias("text")).unionByName(fresh.select(F.concat(F.lit("1"), "id").alias("id"), F.col("summary").alias("text")))
    judged = I.accepted_against(texts.where("id like '1%'"), texts.where("id like '0%'"), threshold)
    said = judged.select(F.substring("id", 2, 1 << 20).alias("id"), "accepted", F.substring("duplicate_of", 2, 1 << 20).alias("duplicate_of"))
    out = new.join(said, "id", "left")
    return out.withColumn("state", F.when(F.col("accepted").isNull(), "known").when(F.col("accepted"), "stored").otherwise("duplicate")).drop("accepted")


def stale(store: DataFrame, before: str) -> DataFrame:
    """The least important entries that nobody has touched since, so many a run; distilled and permanent ones are never stale."""
    return store.where((F.col("updated_at") < before) & ~F.col("type").isin("L4b") & (F.col("half_life") != "permanent")).orderBy("importance", "id").limit(STALE)


def distill_run(store: DataFrame, now: str, before: str) -> DataFrame:
    """(step, id, what): one run of the chain: patterns, distilled entries and what the store says to them, stale entries with what decay leaves of them."""
    found = patterns(store)
    new = storable(distilled(found, now), store)
    c, i = L.linear_decay(F.col("confidence"), F.col("importance"))
    parts = [
        found.select(F.lit("pattern").alias("step"), F.col("source_agent").alias("id"), F.col("n").cast("string").alias("what")),
        new.select(F.lit("store").alias("step"), "id", F.col("state").alias("what")),
        stale(store, before).select(F.lit("decay").alias("step"), "id", F.concat(F.format_number(c, 2), F.lit("/"), i.cast("string")).alias("what")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def expiry(type_: Column, at: Column) -> Column:
    """When an entry of a type ends, from an ISO instant; empty for types that do not end."""
    days = L.default_expiry_days(type_)
    return F.when(days.isNull(), "").otherwise(F.date_format(F.timestamp_seconds(L.epoch(at) + days * 86400), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def promotion(second: DataFrame, third: DataFrame, now: str) -> DataFrame:
    """What promotion of the second layer's entries does to the third: one row an entry that is sure, repeated or asked for, with all it is written with.

    An entry whose summary the third layer holds updates that one, and the least id of several in one batch counts; others are inserted. Either has its reason, its expiry by type, the
    day that its text tells of, the conflict class of an equal summary of another type, and a line for its audit log.
    """
    chosen = I.promoted(second.withColumn("summary_hash", F.coalesce("summary_hash", summary_hash(F.col("summary")))))
    one = chosen.withColumn("_n", F.row_number().over(Window.partitionBy("summary_hash").orderBy("id"))).where("_n = 1").drop("_n")
    held = third.groupBy("summary_hash").agg(F.min("id").alias("into"), F.array_sort(F.collect_set("type")).alias("_types"))
    j = one.join(held, "summary_hash", "left")
    day = event_date(F.concat_ws("\n", "summary", "content"), F.to_date(F.substring("timestamp", 1, 10)))["day"]
    op = F.when(F.col("into").isNull(), "insert").otherwise("update")
    clash = F.when(F.col("into").isNull(), "independent").when(F.array_contains("_types", F.col("type")), "extension").otherwise("conflict")
    audit = F.to_json(F.struct(F.lit(now).alias("at"), op.alias("op"), F.col("reason")))
    return j.select("id", op.alias("op"), F.coalesce("into", "id").alias("into"), "reason", expiry(F.col("type"), F.lit(now)).alias("expires_at"), day.alias("event_date"), clash.alias("conflict_type"), audit.alias("audit"))


def industries(col: Column) -> Column:
    """The industries of an entry: a JSON list of texts, or one name without brackets and quotation marks; empty for none."""
    raw = F.trim(F.coalesce(col, F.lit("")))
    one = F.array(F.regexp_replace(raw, r"""^[\[\] "']+|[\[\] "']+\z""", ""))
    listed = F.when(raw.rlike(r"""^\[\s*"[^"\\]*"(?:\s*,\s*"[^"\\]*")*\s*\]\z"""), F.from_json(raw, "array<string>"))
    return F.when(raw == "", F.array().cast("array<string>")).otherwise(F.coalesce(listed, one))


def curation(entries: DataFrame, held: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(id, target, kind, tags, review, state, duplicate_of) of the third layer's entries that are sure and important enough to be curated.

    An entry with an industry goes to that of its first one (others are tags; entries of self-made media stay below and have no row), one without to its kind. What a target
    holds (id, target, text) comes first, then new entries by importance, confidence and id: one that is there by its id is held, one that repeats the summary
    and content of what its own target has by then is a duplicate, others are stored.
    """
    names = industries(F.col("industry"))
    kinds = F.create_map(*[F.lit(x) for pair in CURATED.items() for x in pair])
    c = entries.where((F.col("confidence") >= CURATED_SURE) & (F.col("importance") >= CURATED_IMPORTANT)).withColumn("_in", names)
    c = c.where((F.size("_in") == 0) | ~F.lower(F.coalesce("source_ref", F.lit(""))).rlike("|".join(SELF_MEDIA)))
    kind = F.coalesce(F.try_element_at(kinds, "type"), F.lit("insights"))
    target = F.when(F.size("_in") > 0, F.concat(F.lit("industry/"), F.trim(F.get("_in", F.lit(0))))).otherwise(kind)
    text = F.concat(F.coalesce("summary", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    # the guard goes by this: what is held, then the most important, then the surest
    turn = F.concat(F.lit("1"), F.format_string("%05d%08d", 99_999 - F.col("importance").cast("int"), (99_999_999 - F.round(F.col("confidence") * 1e6)).cast("int")), F.col("id"))
    tags = F.when(F.size("_in") > 1, F.array_join("_in", ", ")).otherwise("")
    review = (F.size("_in") > 0) & F.coalesce(F.col("summary"), F.lit("")).contains(DOUBT)
    c = c.select("id", target.alias("target"), kind.alias("kind"), tags.alias("tags"), review.alias("review"), text.alias("text"), turn.alias("_turn"))
    known = held.select("id", "target").distinct().withColumn("_held", F.lit(True))
    c = c.join(checked_broadcast(known, KNOWN), ["id", "target"], "left")  # whole texts are not shuffled for it
    there = held.select(F.concat(F.lit("0"), "id").alias("id"), "target", "text")
    judged = I.accepted_against(c.where("_held is null").select(F.col("_turn").alias("id"), "target", "text"), there, threshold, "target").select(F.col("id").alias("_turn"), "accepted", F.col("duplicate_of").alias("_of"))
    out = c.join(judged, "_turn", "left")
    state = F.when(F.col("_held"), "held").when(F.col("accepted"), "stored").otherwise("duplicate")
    of = F.when(F.col("_of").startswith("0"), F.substring("_of", 2, 1 << 20)).otherwise(F.substring("_of", 15, 1 << 20))
    return out.select("id", "target", "kind", "tags", "review", state.alias("state"), of.alias("duplicate_of"))
