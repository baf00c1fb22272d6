"""The archive of entities: what a batch of entries adds to its names, its links and its edges; promotions with a verdict for each candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ENTITY_RELATION_WEIGHTS
from ..functions.extract import entities
from ..functions.text import normal_name

# Type and least confidence of what is promoted.
LESSON, PROMOTED = "lesson", 0.85


def entity_id(name: Column) -> Column:
    """Names of one normal form are one entity."""
    return F.substring(F.sha2(normal_name(name), 256), 1, 16)


def named(entries: DataFrame) -> DataFrame:
    """(entity, name, entry) of the names that entries (id, text) hold, once each: the least spelling of a normal form stands for it in an entry."""
    each = entries.select(F.col("id").alias("entry"), F.explode(entities(F.col("text"))).alias("name"))
    return each.groupBy(entity_id(F.col("name")).alias("entity"), "entry").agg(F.min("name").alias("name"))


def archived(entries: DataFrame, archive: DataFrame, links: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(archive, links, new edges) after a batch of entries (id, text): archive (entity, name, entry_count, first_seen), links (entity, entry).

    Names that the archive lacks are added, others keep their spelling and first day; links are added once, and a count is that of an entity's links.
    The edges are those of entities that share an entry of the batch, with a link that is new: what is held already is not paired again.
    Adding a batch twice changes nothing. Entries' texts are short, so an entry has few names.
    """
    found = named(entries)
    fresh = found.select("entity", "entry").join(links, ["entity", "entry"], "left_anti")
    every = links.select("entity", "entry").unionByName(fresh)
    names = found.groupBy("entity").agg(F.min("name").alias("_name"))
    counts = every.groupBy("entity").agg(F.count("*").alias("_n"))
    j = archive.join(names, "entity", "full").join(counts, "entity", "left")
    grown = j.select("entity", F.coalesce("name", "_name").alias("name"), F.coalesce("_n", F.lit(0)).alias("entry_count"), F.coalesce("first_seen", F.lit(now)).alias("first_seen"))
    return grown, every, shared_edges(every.join(fresh.select("entry").distinct(), "entry", "left_semi"), fresh)


def shared_edges(links: DataFrame, fresh: DataFrame) -> DataFrame:
    """(id1, id2, relation, weight, shared): pairs of entities that share an entry, at least one link of which is fresh, with the number of such entries."""
    mark = fresh.select("entity", "entry").withColumn("new", F.lit(True))
    own = links.select("entity", "entry").join(mark, ["entity", "entry"], "left").withColumn("new", F.coalesce("new", F.lit(False)))
    other = own.select("entry", F.col("entity").alias("id2"), F.col("new").alias("new2"))
    pairs = own.select("entry", F.col("entity").alias("id1"), "new").join(other, "entry").where((F.col("id1") < F.col("id2")) & (F.col("new") | F.col("new2")))
    n = pairs.groupBy("id1", "id2").agg(F.count("*").alias("shared"))
    return n.select("id1", "id2", F.lit("shared_entry").alias("relation"), F.lit(ENTITY_RELATION_WEIGHTS["shared_entry"]).alias("weight"), "shared")


def upserted_relations(held: DataFrame, new: DataFrame) -> DataFrame:
    """Edges (id1, id2, relation, source, weight, updated_at) after an upsert: ends in order, none to itself; one row for a pair, a relation and a source.

    New rows replace held ones; of several new ones the latest counts, then the heaviest.
    """
    key = ["id1", "id2", "relation", "source"]
    rows = new.where("id1 <> id2").select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), "relation", "source", "weight", "updated_at")
    last = rows.groupBy(*key).agg(F.max(F.struct("updated_at", "weight")).alias("r")).select(*key, "r.weight", "r.updated_at")
    return held.join(last.select(*key), key, "left_anti").select(*key, "weight", "updated_at").unionByName(last)


def promotion_verdicts(entries: DataFrame, files: DataFrame, genes: DataFrame) -> DataFrame:
    """(id, verdict, detail, exit_code) of the lessons sure enough to be promoted, surest first: one that has a file (id) or whose summary is a gene's (summary), or an earlier candidate's, is passed over.

    Entries (id, type, summary, confidence) that are no candidates have no row, and so count as not promoted.
    """
    c = entries.where((F.col("type") == LESSON) & (F.col("confidence") >= PROMOTED)).select("id", F.coalesce("summary", F.lit("")).alias("summary"), "confidence")
    c = c.join(files.select("id").distinct().withColumn("_file", F.lit(True)), "id", "left")
    c = c.join(genes.select(F.coalesce("summary", F.lit("")).alias("summary")).distinct().withColumn("_gene", F.lit(True)), "summary", "left")
    # an earlier candidate without a file writes the summary down
    first = c.where("_file is null").groupBy("summary").agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.col("id")))["id"].alias("_first"))
    c = c.join(first, "summary", "left")
    detail = F.when(F.col("_file"), "file").when(F.col("_gene") | (F.col("id") != F.col("_first")), "summary").otherwise("")
    return c.select("id", F.when(detail == "", "promote").otherwise("skip_dedup").alias("verdict"), detail.alias("detail"), F.lit(0).alias("exit_code"))
