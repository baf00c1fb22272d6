"""Layers, the register, used injections and instructions behind the rest."""

import pytest
from pyspark.sql import functions as F

from lodestore.config import Search
from lodestore.functions import text as X
from lodestore.operators import retrieval as R
from lodestore.sources import layers as L


def test_register_adds_once(spark, tmp_path):
    path = f"file://{tmp_path}/auth"
    rows = [("s1", "a", "web", "one", "me", "2026-01-01", "r1"), ("s1", "b", "web", "again", "me", "2026-01-02", "r2"), ("s2", "a", "db", "two", "me", "2026-01-01", None), (None, "a", "x", "none", "me", "", "")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in L.REGISTER.names[:-1]))
    assert {(r["source_id"], r["label"], r["registered_at"]) for r in L.register(df, path, "t1").collect()} == {("s1", "one", "t1"), ("s2", "two", "t1")}
    more = df.unionByName(df.where("source_id = 's2'").withColumn("source_id", F.lit("s3")))
    assert sorted((r["source_id"], r["registered_at"]) for r in L.register(more, path, "t2").collect()) == [("s1", "t1"), ("s2", "t1"), ("s3", "t2")]
    assert L.register(df.limit(0), path, "t3").count() == 3


def test_layers_are_written_once(spark, tmp_path):
    root = f"file://{tmp_path}/layer"
    df = spark.createDataFrame([("7", "x", "first"), ("7", "x", "second"), ("b c", "x", "other agent"), ("b c", "y", None)], "agent string, id string, summary string")
    L.write_layer(df, root)
    L.write_layer(df.withColumn("summary", F.lit("later")).unionByName(spark.createDataFrame([("b c", "z", "new")], df.schema)), root)
    got = {(r["agent"], r["id"]): r["summary"] for r in L.read_layer(spark, root).collect()}
    assert got == {("7", "x"): "first", ("b c", "x"): "other agent", ("b c", "y"): None, ("b c", "z"): "new"}
    own = L.read_layer(spark, root, "b c")
    assert {r["id"] for r in own.collect()} == {"x", "y", "z"} and "PartitionFilters: [isnotnull(agent" in own._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="agent"):
        L.write_layer(spark.createDataFrame([(None, "x", "s")], df.schema), root)


def test_used(spark):
    rows = [("Port 80", "the PORT 80 is open", True), ("a", None, False), ("", None, True), (None, "x", None), ("端口", "用端口", True)]
    assert [r["u"] for r in spark.createDataFrame([r[:2] for r in rows], "e string, a string").select(X.used(F.col("e"), F.col("a")).alias("u")).collect()] == [r[2] for r in rows]


def test_instructions_go_behind_the_rest(spark):
    hits = [(q, f"e{n}", 10.0 - n, "instruction" if n in (0, 2) else "fact", 0.95 if n != 2 else 0.5, t) for q, t in ((1, "如何部署"), (2, "deploy"), (3, None)) for n in range(6)]
    df = spark.createDataFrame(hits, "qid int, id string, score double, type string, confidence double, text string")
    got = R.instruction_tail(df, F.desc("score"), F.col("id"), top_k=5)
    by = {q: [r["id"] for r in sorted(got.where(f"qid = {q}").collect(), key=lambda r: r["rank0"])] for q in (1, 2, 3)}
    assert by == {1: ["e1", "e2", "e3", "e4", "e5", "e0"], 2: [f"e{n}" for n in range(5)], 3: [f"e{n}" for n in range(5)]}


def test_search_with_instructions_behind(spark):
    from lodestore.plans.common import access_log, bench_queries, entry_vectors, query_vectors, store

    d = "/root/testdata/sf0.001"
    q = bench_queries(spark, d)
    sure = F.col("doc_id") % 10 == 3  # the small table has next to no sure instructions of its own
    entries = store(spark, d).withColumns({"type": F.when(sure, "instruction").otherwise("fact"), "confidence": F.when(sure, 0.95).otherwise(F.col("confidence"))})
    asked = q.withColumn("text", F.concat("text", F.lit(" 规则")))
    answers = []
    for queries, switch in ((q, False), (q, True), (asked, True)):
        out = R.search(queries, entries, access_log(spark, d), query_vectors(spark, d), entry_vectors(spark, d), Search(instructions=switch))
        answers.append(sorted((r["qid"], r["rank"], r["id"], r["type"]) for r in out.collect()))
    assert answers[0] == answers[1]  # no query asks for rules
    assert len(answers[2]) > len(answers[1]) and {a[0] for a in answers[2]} == {a[0] for a in answers[1]}
    assert any(a[3] == "instruction" and a[1] == 0 for a in answers[1]) and not any(a[3] == "instruction" and a[1] < 5 for a in answers[2])
