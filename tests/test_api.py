"""The serving surface over a small store."""

from pyspark.sql import functions as F

from lodestore.__main__ import main
from lodestore.api import TOOLS, Engine
from lodestore.plans.common import edges, store

SMALL = "/root/testdata/sf0.001"


def engine(spark):
    concepts = spark.createDataFrame([("c1", "Vector store", ["index"]), ("c2", "Inverted index", []), ("c3", "Index", ["list"])], "id string, label string, alt array<string>")
    return Engine(spark, store(spark, SMALL), edges=edges(spark, SMALL), concepts=concepts)


def test_all_tools_exist_and_deletion_is_refused(spark):
    e = engine(spark)
    assert all(callable(getattr(e, t)) for t in TOOLS) and len(TOOLS) == 7
    assert e.hard_delete_memory("m00000001").first()["reason"] == "reserved_not_implemented"
    assert e.store.where("id = 'm00000001'").count() == 1


def test_search_track_types_and_fall_back(spark):
    e = engine(spark)
    rows = e.search_memories(["the and of", "zzzzqqqq"], top_k=3).collect()
    assert {r["mode"] for r in rows if r["qid"] == 1} == {"time_desc"} and sum(r["qid"] == 1 for r in rows) == 3
    tracked = e.search_memories(["the and of"], track="episodic").select("id").join(e.store, "id").select("memory_track").distinct().collect()
    assert [r[0] for r in tracked] == ["episodic"]
    kinds = e.search_memories(["the and of"], types="fact, lesson").select("type").distinct().collect()
    assert {r[0] for r in kinds} <= {"fact", "lesson"}


def test_look_ups(spark):
    e = engine(spark)
    assert {r["id"]: r["error"] for r in e.expand_entry(["m00000002", "nope"]).collect()} == {"m00000002": None, "nope": "not_found"}
    assert [r["id"] for r in e.concept_query("index").collect()] == ["c3", "c1", "c2"]
    assert e.ontology_explore().where("enumeration = 'type'").count() == 25
    assert e.entity_knowledge([100001]).count() > 0
    assert e.timeline("2026-01-01", "2026-12-31", 7).count() == 7
    texts = spark.createDataFrame([("a", "《长期记忆》")], "id string, text string")
    assert e.entity_extract(texts).first()["name"] == "长期记忆"
    claim = e.store.where("id = 'm00000001'").select("id", F.lit("about 987654 of 5%").alias("text"))
    assert tuple(e.verify(claim).first()) == ("m00000001", 0, 2)


def test_answers_are_checked_and_verified(spark):
    rows = [("a", "rate of the gateway", "the rate is 37% of all", "src1", 0.9), ("b", "port of the gateway", "8080 and more", "src9", 0.3)]
    s = spark.createDataFrame(rows, "id string, summary string, content string, source_agent string, confidence double").selectExpr(
        "*", "'fact' as type", "id as summary_hash", "'2026-08-30T00:00:00Z' as timestamp", "'2026-08-30T00:00:00Z' as created_at", "0 as deprecated", "'' as expires_at", "cast(null as date) as event_date"
    )
    e = Engine(spark, s)
    free = e.checked_search(["rate of the gateway", "zzzz"], known_agents=("src1",)).collect()
    assert {r["qid"]: r["action"] for r in free} == {0: "skipped", 1: "refuse"} and {r["id"] for r in free if r["qid"] == 1} == {"a", "b"}
    kept = e.checked_search(["rate of the gateway", "zzzz"], known_agents=("src1",), enforce=True).collect()
    assert {r["qid"] for r in kept} == {0}
    got = {r["id"]: (r["passed"], r["total"]) for r in e.verify_search(["is the rate of the gateway 37%", "no figures of the gateway"]).collect()}
    assert got == {"a": (1, 1), "b": (0, 1)}


def test_command_line(spark, tmp_path, capsys):
    store(spark, SMALL).write.parquet(str(tmp_path / "s.parquet"))
    assert main(["search", str(tmp_path / "s.parquet"), "the", "--top-k", "2"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 2
    assert main(["timeline", str(tmp_path / "s.parquet"), "1999", "1999"]) == 2
    capsys.readouterr()
    assert main(["verify", str(tmp_path / "s.parquet"), "the", "99.5%"]) == 0
    assert all('"total": 1' in line for line in capsys.readouterr().out.splitlines())
    assert main(["verify", str(tmp_path / "s.parquet"), "the"]) == 2
    assert main(["expand", str(tmp_path / "missing"), "x"]) == 3
