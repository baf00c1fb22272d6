"""Queries of stored and derived knowledge: cached search, approximate vectors, edges, aliases, concepts, snapshots, miss cards."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..config import Search
from ..operators import aliases as A
from ..operators import concepts as C
from ..operators import retrieval as R
from ..operators.cache import ResultCache, channel_tag
from ..operators.graphs import group_means
from ..operators.vectors import VectorIndex, similar_vectors
from ..registry import query
from ..scratch import saved, scratch_path
from ..sources.snapshots import Snapshots
from ..streaming.cards import open_cards, run_cards
from .common import STORE, access_log, bench_queries, entry_vectors, query_vectors, store, table, text_index
from .retrieval import CFG, INDEX, SEARCH

WHOLE = "queries AS (SELECT item_id AS qid, text FROM benchmark)"


def whole_items(spark, d):
    """(qid, text): each benchmark item, whole, as a question."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _search(spark, d, queries):
    return R.search(queries, store(spark, d), access_log(spark, d), query_vectors(spark, d), entry_vectors(spark, d), CFG, text_index(spark, d))


@query("r23_whole_items", SEARCH.replace(SEARCH[SEARCH.index("queries AS ("):SEARCH.index(", access AS")], WHOLE))
def r23_whole(spark, d):
    """The search with whole items as questions."""
    return _search(spark, d, whole_items(spark, d))


@query("x2_x3_p22_cached_search", SEARCH)
def cached(spark, d):
    """The search through its stored results: asked twice, the second answer comes from what the first left."""
    index = text_index(spark, d)
    cache, tag = ResultCache(spark, scratch_path(spark, "results")), channel_tag(CFG)
    ask = lambda now: cache.search(bench_queries(spark, d), lambda q: _search(spark, d, q), tag, f"{d}@{index.version}", now)
    ask("2026-09-01T00:00:00Z")
    return ask("2026-09-01T00:04:00Z")


@query("r3_k6_approximate")
def approximate(spark, d):
    """Vectors through cells and codes: as many cells are opened as the index measured to be needed."""
    index = VectorIndex.build(entry_vectors(spark, d), scratch_path(spark, "vectors"))
    return index.search(query_vectors(spark, d), Search().candidates)


@query("p14_semantic_similar", "WITH f AS (SELECT x.vec_id AS entity, generate_subscripts(y.embedding, 1) AS i, unnest(y.embedding)::DOUBLE AS x FROM embeddings x JOIN embeddings y ON y.vec_id BETWEEN x.vec_id AND x.vec_id + 7), m AS (SELECT entity, i, avg(x) AS m FROM f GROUP BY ALL), v AS (SELECT entity, list(m ORDER BY i) AS vec, sqrt(sum(m * m)) AS n FROM m GROUP BY entity), p AS (SELECT x.entity AS a, y.entity AS b, round(list_sum(list_transform(list_zip(x.vec, y.vec), lambda z: z[1] * z[2])) / (x.n * y.n), 6) AS weight FROM v x JOIN v y ON x.entity < y.entity) SELECT * FROM p WHERE weight >= 0.8")
def semantic(spark, d):
    """Entities that are alike: each is the mean of the vectors of its entries, eight in a row from its own number on."""
    e = table(spark, d, "embeddings")
    links = e.select(F.explode(F.sequence(F.col("vec_id") - 7, F.col("vec_id"))).alias("id"), F.col("embedding").alias("vec")).join(e.select(F.col("vec_id").alias("id")), "id", "left_semi")
    return similar_vectors(group_means(links, "id", "vec").withColumnRenamed("mean", "vec"), 0.8).withColumnRenamed("cosine", "weight")


@query("p14_same_type", "WITH m AS (SELECT c_custkey AS entity, c_mktsegment AS type, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 8000 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, entity) AS i FROM m), p AS (SELECT x.entity AS a, y.entity AS b, type, row_number() OVER (ORDER BY type, x.i, y.i) AS k FROM r x JOIN r y USING (type) WHERE x.i < y.i) SELECT least(a, b) AS id1, greatest(a, b) AS id2, type FROM p WHERE k <= 5000")
def same_type(spark, d):
    c, o = table(spark, d, "customer").where("c_acctbal > 8000"), table(spark, d, "orders")
    m = c.join(o, c.c_custkey == o.o_custkey, "left").groupBy(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("type")).agg(F.count("o_orderkey").alias("n"))
    return A.same_type_edges(m, 5000)


ENTITIES = "ent AS (SELECT p_partkey AS id, p_name || ' ' || p_brand AS name, p_partkey - p_size AS merged_to, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS entry_count FROM part), near AS (SELECT p_partkey AS a, p_partkey - p_size AS b FROM part WHERE p_size <= 2)"
CLASSES = r"""
named AS (SELECT id, regexp_replace(lower(name), '\s+', '', 'g') AS n FROM ent),
l AS (SELECT x.id AS a, y.id AS b FROM named x JOIN named y ON x.n = y.n AND x.id <> y.id UNION SELECT a, b FROM near WHERE b IN (SELECT id FROM ent) UNION SELECT b, a FROM near WHERE b IN (SELECT id FROM ent)),
reach (id, label) AS (SELECT id, id FROM ent UNION SELECT r.id, l.b FROM reach r JOIN l ON l.a = r.label),
cls AS (SELECT id, min(label) AS label FROM reach GROUP BY id),
classes AS (SELECT id, first_value(id) OVER (PARTITION BY label ORDER BY entry_count DESC, name, id) AS keeper, count(*) OVER (PARTITION BY label) AS size FROM cls JOIN ent USING (id))"""


def _entities(spark, d):
    """Parts as entities: merged into a nearby one where their size is small."""
    p, lines = table(spark, d, "part"), table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    into = F.when(F.col("p_size") <= 2, F.col("p_partkey") - F.col("p_size"))
    return p.join(lines, p.p_partkey == lines.l_partkey, "left").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), into.alias("merged_to"), F.coalesce("n", F.lit(0)).alias("entry_count"))


@query("p13_alias_classes", f"WITH RECURSIVE {ENTITIES}, {CLASSES} SELECT * FROM classes")
def alias_classes(spark, d):
    return A.alias_classes(_entities(spark, d))


@query("p13_repointed", f"WITH RECURSIVE {ENTITIES}, {CLASSES}, k AS (SELECT DISTINCT keeper, l_orderkey FROM lineitem JOIN classes ON l_partkey = id), a AS (SELECT keeper, count(*) AS links FROM k GROUP BY keeper), n AS (SELECT c.keeper, string_agg(DISTINCT e.name, '|' ORDER BY e.name) FILTER (e.name <> o.name) AS aliases FROM classes c JOIN ent e USING (id) JOIN ent o ON o.id = c.keeper GROUP BY c.keeper) SELECT n.keeper AS id, coalesce(aliases, '') AS aliases, coalesce(links, 0) AS links FROM n LEFT JOIN a USING (keeper)")
def repointed(spark, d):
    """Keepers with their aliases and how many links point at them after the merge."""
    e = _entities(spark, d)
    classes = saved(A.alias_classes(e), "alias-classes")
    links = A.repointed_links(table(spark, d, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("entry")), classes).groupBy(F.col("entity").alias("id")).agg(F.count("*").alias("links"))
    kept = A.merged_entities(e, classes).where("merged_to is null").select("id", F.array_join("aliases", "|").alias("aliases"))
    return kept.join(links, "id", "left").select("id", "aliases", F.coalesce("links", F.lit(0)).alias("links"))


@query("p13_repointed_edges", f"WITH RECURSIVE {ENTITIES}, {CLASSES}, e AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS id1, greatest(l_partkey, l_suppkey) AS id2, 'keyword_overlap' AS relation, CAST((l_partkey * 7 + l_suppkey * 3) % 10 AS DOUBLE) / 10 AS weight FROM lineitem) SELECT least(x.keeper, y.keeper) AS id1, greatest(x.keeper, y.keeper) AS id2, relation, max(weight) AS weight FROM e JOIN classes x ON x.id = id1 JOIN classes y ON y.id = id2 WHERE x.keeper <> y.keeper GROUP BY ALL UNION ALL SELECT keeper, id, 'alias_of', 1.0::DOUBLE FROM classes WHERE id <> keeper")
def repointed_edges(spark, d):
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    edges = table(spark, d, "lineitem").select(F.least(a, b).alias("id1"), F.greatest(a, b).alias("id2"), F.lit("keyword_overlap").alias("relation"), (((a * 7 + b * 3) % 10).cast("double") / 10).alias("weight")).distinct()
    return A.repointed_edges(edges, saved(A.alias_classes(_entities(spark, d)), "alias-classes"))


@query("r32_redirects", f"WITH RECURSIVE {ENTITIES}, {CLASSES} SELECT e.name AS asked, keeper AS id, bool_and(e.id <> keeper) AS redirected FROM classes c JOIN ent e USING (id) JOIN ent o ON o.id = c.keeper GROUP BY ALL")
def redirects(spark, d):
    """What every part's name leads to: the entity itself, or the keeper that it was merged into."""
    e = _entities(spark, d)
    merged = saved(A.merged_entities(e, A.alias_classes(e)), "merged-entities")
    return A.entity_lookup(e.select(F.col("name").alias("asked")).distinct(), merged)


CONCEPTS = r"""
c AS (SELECT item_id AS id, w[1] AS label, list_slice(w, 2, 2) AS alt FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark)),
up AS (SELECT id, id // 5 AS parent FROM c WHERE id > 0),
links AS (SELECT id AS src, parent AS dst FROM up UNION SELECT parent, id FROM up),
q AS (SELECT item_id AS qid, lower(text) AS text FROM benchmark),
names AS (SELECT DISTINCT id, unnest(list_concat([label], alt)) AS name FROM c),
named AS (SELECT qid, id, 0 AS hop, row_number() OVER (PARTITION BY qid ORDER BY max(length(name)) DESC, id) AS place FROM q JOIN names ON length(name) >= 2 AND contains(text, name) GROUP BY qid, id QUALIFY place <= 3),
one AS (SELECT qid, id, 1 AS hop, row_number() OVER (PARTITION BY qid ORDER BY id) AS place FROM (SELECT DISTINCT n.qid, dst AS id FROM named n JOIN links ON src = n.id) ANTI JOIN named USING (qid, id) QUALIFY place <= 6),
two AS (SELECT qid, id, 2 AS hop, row_number() OVER (PARTITION BY qid ORDER BY id) AS place FROM (SELECT DISTINCT n.qid, dst AS id FROM one n JOIN links ON src = n.id) ANTI JOIN named USING (qid, id) ANTI JOIN one USING (qid, id) QUALIFY place <= 6),
words AS (SELECT id, CASE WHEN length(alt[1]) >= 2 THEN alt[1] ELSE label END AS word FROM c)"""


def _concepts(spark, d):
    """Items as concepts, named by their first words, in a tree of five to a node: concepts, links both ways, broader."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)
    c = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), w.alias("w")).select("id", F.col("w")[0].alias("label"), F.slice("w", 2, 1).alias("alt"))
    up = c.where("id > 0").select("id", F.expr("id div 5").alias("parent"))
    links = up.select(F.col("id").alias("src"), F.col("parent").alias("dst")).union(up.select("parent", "id")).distinct()
    return c, links, up


@query("r16_concept_expansion", f"WITH {CONCEPTS}, told AS (SELECT qid, word, min((hop, place, id)) AS rk FROM (SELECT * FROM named UNION ALL SELECT * FROM one) JOIN words USING (id) JOIN q USING (qid) WHERE word <> '' AND NOT contains(text, word) GROUP BY ALL), few AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rk, word) AS n FROM told QUALIFY n <= 4), s AS (SELECT qid, string_agg(word, ' ' ORDER BY n) AS ws FROM few GROUP BY qid) SELECT qid, CASE WHEN ws IS NULL THEN text ELSE substr(text || ' ' || ws, 1, 500) END AS text, coalesce(ws, '') AS words FROM q LEFT JOIN s USING (qid)")
def expansion(spark, d):
    c, links, _ = _concepts(spark, d)
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.lower("text").alias("text"))
    return C.expanded_queries(q, c, links).withColumn("words", F.array_join("words", " "))


@query("r18_concept_hops", f"WITH {STORE}, {CONCEPTS}, hops AS (SELECT qid, 0 AS hop, text FROM q UNION ALL SELECT qid, hop, string_agg(word, ' ' ORDER BY place) FROM (SELECT * FROM one UNION ALL SELECT * FROM two) JOIN words USING (id) GROUP BY qid, hop), queries AS (SELECT qid * 3 + hop AS qid, text FROM hops), {INDEX}, pool AS (SELECT qid // 3 AS qid, id, max(\"full\") AS score FROM bm GROUP BY 1, 2) SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) - 1 AS rank0 FROM pool QUALIFY rank0 < 5")
def concept_hops(spark, d):
    """Two hops around each question's concepts, searched in one batch; an entry keeps its best score of any hop."""
    c, links, _ = _concepts(spark, d)
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.lower("text").alias("text"))
    hops = C.hop_queries(q, c, links, 2).select((F.col("qid") * 3 + F.col("hop")).alias("qid"), "text")
    found = R.top_bm25(hops, text_index(spark, d), 5, places=6).groupBy(F.expr("qid div 3").alias("qid"), "id").agg(F.max("full").alias("score"))
    return R.ranked(found, F.desc("score"), F.col("id"), limit=5)


@query("z3_r30_concept_tree", f"WITH RECURSIVE {CONCEPTS}, t (id, path) AS (SELECT id, [id] FROM c ANTI JOIN up USING (id) UNION ALL SELECT up.id, list_append(path, up.id) FROM t JOIN up ON up.parent = t.id) SELECT t.id, label, len(path) - 1 AS depth, row_number() OVER (ORDER BY path) AS pre, (SELECT count(*) FROM t u WHERE list_contains(u.path, t.id)) + row_number() OVER (ORDER BY path) - 1 AS last, CASE len(path) WHEN 1 THEN 'root' WHEN 2 THEN 'group' ELSE 'concept' END AS bucket, row_number() OVER (PARTITION BY CASE len(path) WHEN 1 THEN 'root' WHEN 2 THEN 'group' ELSE 'concept' END ORDER BY label, t.id) AS n FROM t JOIN c USING (id)")
def concept_tree(spark, d):
    """The tree in its order, each concept with the range below it, and its place by label in one of three buckets."""
    from pyspark.sql import Window

    c, _, up = _concepts(spark, d)
    bucket = F.when(F.col("depth") == 0, "root").when(F.col("depth") == 1, "group").otherwise("concept")
    t = C.hierarchy(c, up).withColumn("bucket", bucket)
    return t.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy("label", "id")).cast("long")).select("id", "label", F.col("depth").cast("long").alias("depth"), "pre", "last", "bucket", "n")


@query("r29_below_concepts", f"WITH RECURSIVE {CONCEPTS}, t (top, id) AS (SELECT id, id FROM c UNION ALL SELECT top, up.id FROM t JOIN up ON up.parent = t.id) SELECT top, id FROM t")
def below(spark, d):
    """Everything below every concept, by ranges."""
    c, _, up = _concepts(spark, d)
    tree = saved(C.hierarchy(c, up), "concept-tree")
    return C.below(tree, tree.select("id"))


def _then(spark, d):
    """Orders as they were: fewer of them, and some with another status."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return o.where("o_orderkey % 11 <> 3").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 5, "X").otherwise(F.col("o_orderstatus")))


@query("k9_snapshot_changes", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 3 THEN 'delete' ELSE 'update' END AS op FROM orders WHERE o_orderkey % 11 = 3 OR (o_orderkey % 13 = 5 AND o_orderstatus <> 'X')")
def snapshot_changes(spark, d):
    """What going back to a snapshot would do to the orders of now."""
    snaps = Snapshots(spark, scratch_path(spark, "snapshots"), "o_orderkey")
    name = snaps.create(_then(spark, d), "before", "2026-09-01T00:00:00Z")
    return snaps.changes(name, table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"))


@query("k9_upsert_restore", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 3 AND o_orderkey % 13 = 5 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def snapshot_restore(spark, d):
    """Orders after a restore that leaves later rows in place."""
    snaps = Snapshots(spark, scratch_path(spark, "snapshots"), "o_orderkey")
    name = snaps.create(_then(spark, d), "before", "2026-09-01T00:00:00Z")
    return snaps.restore(name, table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), exact=False)


@query("k2_z11_miss_cards", "WITH m AS (SELECT 'miss ' || user_id AS title, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error') SELECT title, ts AS opened FROM m WHERE n = 5")
def miss_cards(spark, d):
    """Cards that stand open after all misses went through the stream, none of them quiet for long enough to close."""
    stream = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").option("pathGlobFilter", "events*.parquet").parquet(d)
    misses = stream.where("event_type = 'error'").select(F.concat(F.lit("miss "), F.col("user_id").cast("string")).alias("title"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 hour")
    root = scratch_path(spark, "cards")
    events = run_cards(misses, f"{root}/out", f"{root}/checkpoint", 5, dt.timedelta(days=4000))
    return open_cards(events).select("title", F.col("opened").cast("timestamp_ntz").alias("opened"))
