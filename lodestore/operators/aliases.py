"""Alias classes of entities: names that mean one thing and earlier merges, resolved to one keeper each, and everything that points at them moved there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_name
from ..scratch import dropped, saved


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of undirected links (a, b): the label is the component's least node.

    In each round a node takes the least label around it and then its label's label, which halves the way to the root: chains and circles of any length end
    after about as many rounds as their logarithm. Each round is a written table.
    """
    both = saved(links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "alias-links")
    state = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "alias-labels")
    while True:
        around = both.join(state.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = state.join(around, "node").select("node", "label", F.least("label", "near").alias("next"))
        # a root that hears of a lesser label takes all that point at it along
        pull = step.where("next < label").groupBy(F.col("label").alias("root")).agg(F.min("next").alias("to"))
        step = step.join(pull, F.col("next") == F.col("root"), "left").select("node", "label", F.least("next", F.coalesce("to", "next")).alias("next"))
        jump = step.select(F.col("node").alias("_n"), F.col("next").alias("_l"))
        step = step.join(jump, F.col("next") == F.col("_n"), "left").select("node", F.col("label").alias("was"), F.least("next", F.coalesce("_l", "next")).alias("label"))
        step = saved(step, "alias-step")
        changed = step.where("label < was").limit(1).count()
        dropped(state)
        if not changed:
            dropped(both)
            return step.select("node", "label")
        state = step.select("node", "label")
        state._lodestore_path = step._lodestore_path  # the table of the round, deleted by the next


def alias_links(entities: DataFrame) -> DataFrame:
    """(a, b) of entities (id, name, merged_to) that are one: names of one normal form, as a star around the least id, and earlier merges."""
    named = entities.select("id", normal_name(F.col("name")).alias("n")).where("n <> ''")
    hubs = named.groupBy("n").agg(F.min("id").alias("hub"), F.count("*").alias("m")).where("m > 1")
    stars = named.join(hubs, "n").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    ids = entities.select(F.col("id").alias("merged_to"))
    chains = entities.where("merged_to is not null").select("id", "merged_to").join(ids, "merged_to", "left_semi").select(F.col("id").alias("a"), F.col("merged_to").alias("b"))
    return stars.unionByName(chains)


def alias_classes(entities: DataFrame) -> DataFrame:
    """(id, keeper, size) of every entity (id, name, entry_count, merged_to): the keeper has most entries, then the least name, then the least id.

    An entity alone is its own keeper. Circles of merges are classes like others; a merge into what does not exist does not count.
    """
    found = components(alias_links(entities))
    every = entities.select("id", "name", "entry_count").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    best = every.groupBy("label").agg(F.min(F.struct((-F.coalesce("entry_count", F.lit(0))).alias("n"), F.col("name"), F.col("id")))["id"].alias("keeper"), F.count("*").alias("size"))
    return every.join(best, "label").select("id", "keeper", "size")


def merged_entities(entities: DataFrame, classes: DataFrame) -> DataFrame:
    """entities with merged_to settled (null for a keeper), and a keeper's aliases: all other names of its class and names that stand in brackets, sorted, once each."""
    own = entities.join(classes, "id")
    bare = F.regexp_extract("name", r"^[《（(](.+)[》）)]$", 1)
    names = own.select("keeper", F.explode(F.array("name", bare)).alias("alias")).where("alias <> ''").distinct()
    kept = entities.select(F.col("id").alias("keeper"), F.col("name").alias("_own"))
    names = names.join(kept, "keeper").where("alias <> _own").groupBy("keeper").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    out = own.drop("merged_to", "aliases").join(names, "keeper", "left")
    alone = F.col("id") == F.col("keeper")
    return out.select(*[c for c in entities.columns if c not in ("merged_to", "aliases")], F.when(~alone, F.col("keeper")).alias("merged_to"), F.when(alone, F.coalesce("aliases", F.array().cast("array<string>"))).alias("aliases"))


def repointed_links(links: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (entity, entry) of keepers, once each."""
    return links.join(classes.select(F.col("id").alias("entity"), "keeper"), "entity").select(F.col("keeper").alias("entity"), "entry").distinct()


def repointed_edges(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (id1, id2, relation, weight) between keepers, the heaviest of each pair and relation; those inside a class give way to alias_of edges of weight 1."""
    a, b = classes.select(F.col("id").alias("id1"), F.col("keeper").alias("_a")), classes.select(F.col("id").alias("id2"), F.col("keeper").alias("_b"))
    moved = edges.join(a, "id1").join(b, "id2").where("_a <> _b")
    moved = moved.groupBy(F.least("_a", "_b").alias("id1"), F.greatest("_a", "_b").alias("id2"), "relation").agg(F.max("weight").alias("weight"))
    alias = classes.where("id <> keeper").select(F.col("keeper").alias("id1"), F.col("id").alias("id2"), F.lit("alias_of").alias("relation"), F.lit(1.0).alias("weight"))
    return moved.unionByName(alias)


def entity_lookup(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(asked, id, redirected): the entities that asked names (asked) mean, by their name or an alias; one that was merged leads to its keeper."""
    known = entities.select("id", F.coalesce("merged_to", "id").alias("keeper"), F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("every"))
    known = known.select("id", "keeper", F.posexplode("every").alias("place", "n"))
    # an alias leads to its keeper anyway: redirected is what only merged entities are called by themselves
    known = known.select(normal_name(F.col("n")).alias("n"), "keeper", F.when(F.col("place") == 0, F.col("id") != F.col("keeper")).alias("moved"))
    found = names.select("asked", normal_name(F.col("asked")).alias("n")).join(known, "n")
    return found.groupBy("asked", F.col("keeper").alias("id")).agg(F.coalesce(F.bool_and("moved"), F.lit(False)).alias("redirected"))


def same_type_edges(members: DataFrame, most: int) -> DataFrame:
    """(id1, id2, type) of entities (entity, type, n) that share a type, ``most`` pairs in all: types by name, in a type the entities of most entries first.

    The pairs of a type are numbered by the places of their ends, so those within the cap are told without making any other.
    """
    own = members.select("entity", "type", "n").distinct()
    sizes = own.groupBy("type").agg(F.count("*").alias("size"))  # a row a type
    sizes = sizes.withColumn("start", F.coalesce(F.sum(F.expr("size * (size - 1) div 2")).over(Window.orderBy("type").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # no pair within the cap has an end beyond this place
    place = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("n"), "entity"))
    own = own.withColumn("_p", place).where(F.col("_p") <= most + 1).withColumn("i", F.col("_p").cast("long") - 1).join(F.broadcast(sizes), "type")
    begun = F.col("start") + F.expr("i * size - i * (i + 1) div 2")
    few = F.least(F.col("size") - F.col("i") - 1, F.lit(most) - begun)
    left = own.withColumn("take", few).where("take > 0").select("type", F.col("entity").alias("_a"), F.explode(F.sequence(F.col("i") + 1, F.col("i") + F.col("take"))).alias("i"))
    pairs = left.join(own.select("type", F.col("entity").alias("_b"), "i"), ["type", "i"])
    return pairs.select(F.least("_a", "_b").alias("id1"), F.greatest("_a", "_b").alias("id2"), "type")
