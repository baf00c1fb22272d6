"""A hierarchy of concepts as intervals, concepts named in queries, and queries expanded by them.

A concept's place in the order of a walk through the tree (``pre``) and the last place below it (``last``) make its subtree a range: everything below a concept
is found by a range join, at any depth, without recursion at query time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .containment import holding

# Concepts of a query that are expanded, words that are appended, characters of an expanded query, neighbours of one layer and in all.
MOST_CONCEPTS, MOST_WORDS, MOST_CHARS, LAYER, TOTAL = 3, 4, 500, 6, 12


def hierarchy(concepts: DataFrame, broader: DataFrame) -> DataFrame:
    """concepts (id, ...) with depth, pre, last and root, from broader (id, parent).

    A concept with several broader ones hangs below the least. Parents that are no concepts do not count. Concepts that only hang below one another in a circle
    are roots each. The number of concepts is that of a vocabulary: places are given in one task.
    """
    spark = concepts.sparkSession
    ids = concepts.select("id").distinct()
    own = broader.join(ids, "id", "left_semi").join(ids.select(F.col("id").alias("parent")), "parent", "left_semi").where("id <> parent").groupBy("id").agg(F.min("parent").alias("parent"))
    roots = ids.join(own.select("id"), "id", "left_anti")
    walked = spark.sql(
        """WITH RECURSIVE walk (id, path) AS (
             SELECT id, array(id) FROM {roots}
             UNION ALL
             SELECT o.id, concat(w.path, array(o.id)) FROM walk w JOIN {own} o ON o.parent = w.id
           ) SELECT id, path FROM walk""",
        roots=roots, own=own,
    )
    circles = ids.join(walked.select("id"), "id", "left_anti").select("id", F.array("id").alias("path"))
    paths = walked.unionByName(circles)
    below = paths.select(F.explode("path").alias("id")).groupBy("id").agg((F.count("*") - 1).alias("_below"))
    placed = paths.withColumn("pre", F.row_number().over(Window.orderBy("path")).cast("long")).join(below, "id")
    places = placed.select("id", (F.size("path") - 1).alias("depth"), "pre", (F.col("pre") + F.col("_below")).alias("last"), F.col("path")[0].alias("root"))
    return concepts.join(places, "id")


def below(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """(top, id) of all concepts in the subtrees of some concepts (id), themselves included."""
    tops = tree.join(ids.select("id").distinct(), "id").select(F.col("id").alias("top"), F.col("pre").alias("_from"), F.col("last").alias("_to"))
    return tops.join(tree.select("id", "pre"), F.col("pre").between(F.col("_from"), F.col("_to"))).select("top", "id")


def search_word(label: Column, alt: Column) -> Column:
    """What to search a concept by: its shortest other name of two characters or more, the first of them, else its label up to a bracket."""
    names = F.filter(F.transform(F.coalesce(alt, F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: F.length(a) >= 2)
    least = F.array_min(F.transform(names, lambda a, i: F.struct(F.length(a).alias("n"), i.alias("i"), a.alias("a"))))
    return F.coalesce(least["a"], F.trim(F.regexp_extract(label, r"^([^（(]*)", 1)))


def named_concepts(queries: DataFrame, concepts: DataFrame, most: int = MOST_CONCEPTS) -> DataFrame:
    """(qid, id, place): the concepts (id, label, alt) whose label or other name stands in a query's text, whatever the case; the longest names first, then by id."""
    names = F.array_distinct(F.concat(F.array("label"), F.coalesce("alt", F.array().cast("array<string>"))))
    strings = concepts.select("id", F.explode(names).alias("name")).where("length(name) >= 2").select(F.struct("id", F.length("name").alias("n")).alias("key"), F.lower("name").alias("name"))
    found = holding(queries.select("qid", F.lower("text").alias("text")), "qid", "text", strings.select(F.to_json("key").alias("key"), "name"), "key", "name")
    kind = dict(concepts.dtypes)["id"]
    found = found.withColumn("k", F.from_json("key", f"id {kind}, n int")).groupBy("qid", "k.id").agg(F.max("k.n").alias("n"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= most).select("qid", "id", "place")


def neighbour_layers(start: DataFrame, links: DataFrame, layers: int = 1, layer: int = LAYER, total: int = TOTAL) -> DataFrame:
    """(qid, id, hop, place) around each query's concepts (qid, id): so many of a layer and in all, each concept at its nearest hop."""
    known = start.select("qid", "id", F.lit(0).alias("hop"), F.lit(0).alias("place"))
    edge = known
    for hop in range(1, layers + 1):
        near = edge.join(links.select(F.col("src").alias("id"), "dst"), "id").select("qid", F.col("dst").alias("id")).distinct().join(known.select("qid", "id"), ["qid", "id"], "left_anti")
        before = known.where("hop > 0").groupBy("qid").agg(F.count("*").alias("_n"))
        near = near.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("id"))).join(before, "qid", "left")
        edge = near.where((F.col("place") <= layer) & (F.col("place") + F.coalesce("_n", F.lit(0)) <= total)).select("qid", "id", F.lit(hop).alias("hop"), "place")
        known = known.unionByName(edge)
    return known.where("hop > 0")


def expanded_queries(queries: DataFrame, concepts: DataFrame, links: DataFrame, layers: int = 1, words: int = MOST_WORDS, chars: int = MOST_CHARS) -> DataFrame:
    """(qid, text, words): the queries with the search words of their concepts and of those around them appended, as many as allowed, cut to a length.

    A word that stands in the query or came before is left out. A query that names no concept stays as it is.
    """
    named = named_concepts(queries, concepts)
    near = neighbour_layers(named, links, layers)
    every = named.select("qid", "id", F.lit(0).alias("hop"), "place").unionByName(near)
    told = every.join(concepts.select("id", search_word(F.col("label"), F.col("alt")).alias("word")), "id").join(queries.select("qid", "text"), "qid")
    told = told.where((F.col("word") != "") & ~F.contains("text", F.col("word"))).groupBy("qid", "word").agg(F.min(F.struct("hop", "place", "id")).alias("at"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("at", "word"))
    few = told.withColumn("n", place).where(F.col("n") <= words).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda s: s["word"]).alias("words"))
    out = queries.select("qid", "text").join(few, "qid", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    longer = F.substring(F.concat_ws(" ", F.array("text"), F.col("words")), 1, chars)
    return out.select("qid", F.when(F.size("words") > 0, longer).otherwise(F.col("text")).alias("text"), "words")


def hop_queries(queries: DataFrame, concepts: DataFrame, links: DataFrame, hops: int = 2) -> DataFrame:
    """(qid, hop, text): each query itself as hop 0, and one sub-query for each layer around its concepts, made of the layer's search words."""
    named = named_concepts(queries, concepts)
    layers = neighbour_layers(named, links, hops).join(concepts.select("id", search_word(F.col("label"), F.col("alt")).alias("word")), "id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda s: s["word"]), " ")
    return queries.select("qid", F.lit(0).alias("hop"), "text").unionByName(layers.groupBy("qid", "hop").agg(text.alias("text")))
