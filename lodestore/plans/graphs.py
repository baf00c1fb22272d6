"""Graph, entity and join queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import GRAPH_RELATIONS
from ..functions.text import tokens
from ..operators import graphs as G
from ..operators.retrieval import dot
from ..registry import query
from .common import EDGES, STORE, edges, store, table

BOTH = "d AS (SELECT id1 AS src, id2 AS dst, weight FROM edges UNION ALL SELECT id2, id1, weight FROM edges)"
SEEDS = "seeds AS (SELECT s_suppkey + 100000 AS id FROM supplier)"


def _seeds(spark, d):
    return table(spark, d, "supplier").select((F.col("s_suppkey") + 100000).alias("id"))


@query("j2_neighbours", f"WITH {EDGES}, {BOTH}, {SEEDS} SELECT src AS seed, dst AS id, max(weight) AS weight FROM d WHERE src IN (SELECT id FROM seeds) GROUP BY ALL")
def j2(spark, d):
    return G.neighbours(_seeds(spark, d), edges(spark, d))


@query("j3_j4_w2_expand", f"WITH {EDGES}, {BOTH}, {SEEDS}, n AS (SELECT src AS seed, dst AS id, max(weight) AS weight FROM d WHERE src IN (SELECT id FROM seeds) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY weight DESC, id) AS n FROM n) SELECT id, max(weight) AS weight, arg_max(seed, (weight, -seed)) AS seed FROM r WHERE n <= 3 GROUP BY id")
def j3(spark, d):
    return G.expanded(_seeds(spark, d), edges(spark, d), 3, GRAPH_RELATIONS)


@query("j5_shared_entries", "WITH l AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS m FROM lineitem) SELECT x.m AS a, y.m AS b, count(*) AS n FROM l x JOIN l y ON x.g = y.g AND x.m < y.m GROUP BY ALL")
def j5(spark, d):
    return G.shared_pairs(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("j6_r32_entity", "SELECT s_suppkey AS entity, s_name, l_orderkey, o_orderdate FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) ON l_suppkey = s_suppkey LEFT JOIN orders ON o_orderkey = l_orderkey QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY o_orderdate DESC, l_orderkey) <= 5")
def j6(spark, d):
    links = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey").distinct()
    s, o = table(spark, d, "supplier"), table(spark, d, "orders")
    j = s.join(links, s.s_suppkey == links.l_suppkey, "left").join(o, links.l_orderkey == o.o_orderkey, "left")
    w = Window.partitionBy("s_suppkey").orderBy(F.desc("o_orderdate"), "l_orderkey")
    return j.withColumn("n", F.row_number().over(w)).where("n <= 5").select(F.col("s_suppkey").alias("entity"), "s_name", "l_orderkey", "o_orderdate")


@query("j7_r33_two_hops", "WITH h AS (SELECT DISTINCT l_suppkey AS e, l_partkey AS p FROM lineitem WHERE l_quantity >= 49), one AS (SELECT DISTINCT x.e AS a, y.e AS b FROM h x JOIN h y ON x.p = y.p AND x.e <> y.e), two AS (SELECT DISTINCT x.a, y.b FROM one x JOIN one y ON x.b = y.a AND x.a <> y.b) SELECT a, b FROM two ANTI JOIN one USING (a, b)")
def j7(spark, d):
    h = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("p")).distinct()
    one = h.join(h.withColumnRenamed("a", "b"), "p").where("a <> b").select("a", "b").distinct()
    two = one.join(one.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").where("a <> c").select("a", F.col("c").alias("b")).distinct()
    return two.join(one, ["a", "b"], "left_anti")


@query("j8_same_agent", "WITH e AS (SELECT event_id, user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s FROM events) SELECT x.event_id AS a, y.event_id AS b FROM e x JOIN e y ON x.user_id = y.user_id AND x.event_id < y.event_id AND abs(x.s - y.s) <= 3600")
def j8(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    pairs = G.within_seconds(e.withColumnRenamed("event_id", "a"), e.select("user_id", F.col("event_id").alias("b"), F.col("s").alias("s2")), "user_id", "s", "s2", 3600)
    return pairs.where("a < b").select("a", "b")


@query("j9_p14_keyword_overlap", "WITH t AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM benchmark), k AS (SELECT * FROM t WHERE length(w) >= 5) SELECT x.item_id AS a, y.item_id AS b, count(*) AS shared FROM k x JOIN k y ON x.w = y.w AND x.item_id < y.item_id GROUP BY ALL HAVING count(*) >= 2")
def j9(spark, d):
    k = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("w")).where("length(w) >= 5")
    return G.shared_pairs(k, "w", "item_id").where("n >= 2").withColumnRenamed("n", "shared")


@query("j12_golden", "WITH g AS (SELECT o_custkey AS qid, o_orderkey AS expected FROM orders WHERE o_totalprice > 300000), r AS (SELECT o_custkey AS qid, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) SELECT g.qid, expected, rank FROM g LEFT JOIN r ON g.qid = r.qid AND g.expected = r.id AND rank <= 5")
def j12(spark, d):
    o = table(spark, d, "orders")
    g = o.where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("qid")).agg(F.collect_list("o_orderkey").alias("expected5"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    r = o.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("expected"), "rank")
    return g.select("qid", F.explode("expected5").alias("expected")).join(r, ["qid", "expected"], "left")


@query("j15_p10_cross_agent", f"WITH {STORE}, p AS (SELECT source_agent, substr(summary, 1, 30) AS prefix, avg(confidence) AS c, count(*) AS n FROM store GROUP BY ALL) SELECT x.source_agent AS agent_a, y.source_agent AS agent_b, x.prefix, round((x.c + y.c) / 2, 6) AS confidence FROM p x JOIN p y ON x.prefix = y.prefix AND x.source_agent < y.source_agent")
def j15(spark, d):
    p = store(spark, d).groupBy("source_agent", F.substring("summary", 1, 30).alias("prefix")).agg(F.avg("confidence").alias("c"))
    x, y = p.select(F.col("source_agent").alias("agent_a"), "prefix", F.col("c").alias("ca")), p.select(F.col("source_agent").alias("agent_b"), "prefix", F.col("c").alias("cb"))
    return x.join(y, "prefix").where("agent_a < agent_b").select("agent_a", "agent_b", "prefix", F.round((F.col("ca") + F.col("cb")) / 2, 6).alias("confidence"))


@query("j16_common_queries", "SELECT DISTINCT a.text FROM (SELECT lower(text) AS text FROM documents WHERE source = 'src0') a JOIN (SELECT lower(text) AS text FROM documents WHERE source <> 'src0') b USING (text)")
def j16(spark, d):
    """Texts that two banks share, whole: the documents of one source and those of all others."""
    t, docs = F.lower("text").alias("text"), table(spark, d, "documents")
    return docs.where("source = 'src0'").select(t).distinct().join(docs.where("source <> 'src0'").select(t), "text", "left_semi")


@query("p13_w4_alias_merge", "WITH e AS (SELECT p_partkey AS entity, regexp_replace(lower(p_name), '\\s+', '', 'g') AS name, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL), r AS (SELECT *, first_value(entity) OVER (PARTITION BY name ORDER BY n DESC, entity) AS keeper FROM e) SELECT entity, keeper, n FROM r WHERE entity <> keeper")
def p13(spark, d):
    p, lines = table(spark, d, "part"), table(spark, d, "lineitem")
    counts = lines.groupBy("l_partkey").agg(F.count("*").alias("n"))
    e = p.join(counts, p.p_partkey == counts.l_partkey, "left").select(F.col("p_partkey").alias("entity"), F.regexp_replace(F.lower("p_name"), r"\s+", "").alias("name"), F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.partitionBy("name").orderBy(F.desc("n"), "entity")
    return e.withColumn("keeper", F.first("entity").over(w)).where("entity <> keeper").select("entity", "keeper", "n")


@query("a20_r7_r8_group_means", "WITH f AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM f GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM m GROUP BY label), g AS (SELECT label, list(m / norm ORDER BY i) AS mean FROM m JOIN n USING (label) GROUP BY label) SELECT e.vec_id, e.label, round(list_sum(list_transform(list_zip(e.embedding, g.mean), lambda z: CAST(z[1] AS DOUBLE) * z[2])), 6) + 0.0 AS similarity FROM embeddings e JOIN g USING (label)")
def a20(spark, d):
    e = table(spark, d, "embeddings")
    return e.join(G.group_means(e, "label", "embedding"), "label").select("vec_id", "label", (F.round(dot(F.col("embedding"), F.col("mean")), 6) + 0.0).alias("similarity"))


@query("r6_graph_channel", f"WITH {EDGES}, {BOTH}, {SEEDS}, n AS (SELECT src AS seed, dst AS id, max(weight) AS weight FROM d WHERE src IN (SELECT id FROM seeds) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY weight DESC, id) AS n FROM n), m AS (SELECT id, max(weight) AS weight FROM r WHERE n <= 3 AND id NOT IN (SELECT id FROM seeds) GROUP BY id) SELECT id, weight FROM m WHERE weight >= 0.35 ORDER BY weight DESC, id LIMIT 15")
def r6(spark, d):
    seeds = _seeds(spark, d)
    near = G.expanded(seeds, edges(spark, d), 3, GRAPH_RELATIONS).join(seeds, "id", "left_anti")
    return near.where("weight >= 0.35").orderBy(F.desc("weight"), "id").limit(15).select("id", "weight")


@query("r16_r17_z3_concepts", "WITH b AS (SELECT n_nationkey AS a, n_regionkey + 1000 AS b FROM nation), d AS (SELECT a AS src, b AS dst FROM b UNION ALL SELECT b, a FROM b), h1 AS (SELECT DISTINCT n_nationkey AS c0, dst AS c FROM nation JOIN d ON src = n_nationkey), h2 AS (SELECT DISTINCT c0, dst AS c FROM h1 JOIN d ON src = c WHERE dst <> c0), u AS (SELECT c0, c, min(hop) AS hop FROM (SELECT c0, c, 1 AS hop FROM h1 UNION ALL SELECT c0, c, 2 FROM h2) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c0 ORDER BY hop, c) AS n FROM u) SELECT c0, c, hop FROM r WHERE n <= 12")
def r16(spark, d):
    n = table(spark, d, "nation")
    tree = n.select(F.col("n_nationkey").alias("id1"), (F.col("n_regionkey") + 1000).alias("id2"), F.lit("broader").alias("relation"), F.lit(1.0).alias("weight"))
    return concept_hops(n.select(F.col("n_nationkey").alias("c0")), G.directed(tree).select("src", "dst"), 12)


def concept_hops(seeds, links, total):
    """Concepts within two hops of each seed, nearest first, so many in all. Two joins: hops are bounded by three."""
    one = seeds.join(links, F.col("c0") == F.col("src")).select("c0", F.col("dst").alias("c"), F.lit(1).alias("hop")).distinct()
    two = one.join(links, F.col("c") == F.col("src")).where("dst <> c0").select("c0", F.col("dst").alias("c"), F.lit(2).alias("hop")).distinct()
    near = one.unionByName(two).groupBy("c0", "c").agg(F.min("hop").alias("hop"))
    w = Window.partitionBy("c0").orderBy("hop", "c")
    return near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= total).select("c0", "c", "hop")
