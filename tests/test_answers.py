"""Rules over answers, judges, gates, questions, time windows, the archive, promotions and reports, by literal fixtures and brute force."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestore.config import Search
from lodestore.functions import extract as X
from lodestore.operators import answers as W
from lodestore.operators import archive as A
from lodestore.operators import retrieval as R
from lodestore.sources import reports as P

HIT = "qid long, rank0 long, score double, mode string, source_agent string, confidence double, evidence double"


def checked(spark, hits, known=("a",), asked=range(9)):
    queries = spark.createDataFrame([(i,) for i in asked], "qid long")
    return W.checked_answers(queries, spark.createDataFrame(hits, HIT), Search(), known)


def test_answers_are_refused_marked_passed_or_skipped(spark):
    hits = [
        (0, 0, 0.2, "dual_rrf", "a", 0.9, None), (0, 1, 0.1, "dual_rrf", "z", 0.8, None),  # only the first hit's source counts
        (1, 0, 0.002, "dual_rrf", "a", 0.9, None),
        (2, 0, 0.02, "dual_rrf", "b", 0.5, 0.05),
        (3, 0, 0.2, "fts_only", None, 0.1, 0.0),
        (4, 0, 0.5, "time_desc", " ", None, None),
        (6, 0, 0.2, "dual_rrf_rerank", "a", 0.9, 0.3), *[(6, i, 0.1, "dual_rrf_rerank", "a", 0.9 if i < 5 else 0.1, 0.3) for i in range(1, 7)],
        (7, 0, 0.02, "dual_rrf", None, 0.9, None),
    ]
    got = {r["qid"]: (r["action"], list(r["reasons"])) for r in checked(spark, hits, asked=range(8)).collect()}
    assert got == {
        0: ("pass", []),
        1: ("refuse", ["relevance_refuse"]),
        2: ("refuse", ["relevance_mark", "evidence_refuse", "source_domain_unknown", "low_confidence"]),
        3: ("skipped", []),
        4: ("refuse", ["relevance_refuse", "source_domain_empty"]),
        5: ("refuse", ["relevance_refuse"]),
        6: ("pass", []),
        7: ("mark", ["relevance_mark", "source_domain_empty"]),
    }


def test_without_known_sources_none_is_unknown_and_enforcing_cuts(spark):
    hits = [(0, 0, 0.2, "dual_rrf", "b", 0.5, None), (0, 1, 0.2, "dual_rrf", "b", 0.9, None), (1, 0, 0.0, "dual_rrf", "b", 0.9, None)]
    c = checked(spark, hits, known=(), asked=(0, 1))
    assert {r["qid"]: (r["action"], r["would_block"]) for r in c.collect()} == {0: ("mark", False), 1: ("refuse", True)}
    left = W.enforced(spark.createDataFrame(hits, HIT), c).select("qid", "rank0", "low_confidence").collect()
    assert sorted(map(tuple, left)) == [(0, 0, True), (0, 1, False)]


def test_no_hits_at_all(spark):
    assert [r["action"] for r in checked(spark, [], asked=(3,)).collect()] == ["refuse"]


def test_figures_of_a_question_are_looked_for_in_the_entries(spark):
    queries = spark.createDataFrame([(0, "涨了 37% 到 1200元，通过"), (1, "no figures"), (2, None)], "qid long, text string")
    store = spark.createDataFrame([("x", "sum", "x" * 90 + "1200元" + "y" * 90), ("y", "37%", None), ("z", None, None)], "id string, summary string, content string")
    hits = queries.select("qid").crossJoin(store.select("id"))
    got = {(r["qid"], r["id"]): r for r in W.answer_verdicts(queries, hits, store).collect()}
    assert set(got) == {(0, "x"), (0, "y"), (0, "z")}
    x = got[0, "x"]
    assert (x["passed"], x["total"], x["passed_all"]) == (2, 3, False)
    assert [(e["type"], e["token"], e["passed"]) for e in x["evidence"]] == [("percent", "37%", False), ("money", "1200元", True), ("conclusion", "通过", True)]
    assert x["evidence"][1]["snippet"] == "x" * 40 + "1200元" + "y" * 40 and x["evidence"][2]["snippet"] is None
    assert [got[0, i]["passed"] for i in "yz"] == [2, 1]


def test_judges_prove_themselves(spark):
    r = random.Random(3)
    rows = [(j, r.random() < 0.4, round(r.random() + 0.0, 1)) for j in ("a", "b") for _ in range(60)]
    rows += [("good", True, 0.9), ("good", True, 0.5), ("good", False, 0.5), ("good", False, 0.1), ("one", True, 0.4)]
    got = {x["judge"]: (x["auroc"], x["certified"]) for x in W.judges(spark.createDataFrame(rows, "judge string, positive boolean, score double")).collect()}
    for j in ("a", "b", "good"):
        pos, neg = ([s for k, p, s in rows if k == j and p is kind] for kind in (True, False))
        area = round(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)), 6)
        assert got[j] == (pytest.approx(area, abs=1e-6), area >= 0.7)
    assert got["one"] == (None, False)
    scored = spark.createDataFrame([("good", 0.3), ("good", 0.06), ("good", 0.02), ("good", 0.0), ("good", None), ("one", 0.9), ("none", 0.9)], "judge string, score double")
    proven = W.judges(spark.createDataFrame(rows, "judge string, positive boolean, score double"))
    assert sorted(map(tuple, W.graded_by(scored, proven).select("judge", "score", "grade").collect()), key=str) == sorted(
        [("good", 0.3, "strong"), ("good", 0.06, "medium"), ("good", 0.02, "low"), ("good", 0.0, "weak"), ("good", None, "unknown"), ("one", 0.9, None), ("none", 0.9, None)], key=str
    )


def test_hop_gate(spark):
    found = spark.createDataFrame([(0, "a", 0), (1, "b", 4), (2, "c", 5), (3, "d", 0)], "qid long, id string, rank0 long")
    golden = spark.createDataFrame([(0, "a"), (0, "q"), (1, "b"), (2, "c"), (3, "d")], "qid long, id string")
    gone = spark.createDataFrame([("d",)], "id string")
    level = spark.createDataFrame([(0, "complex"), (1, "simple"), (2, "simple")], "qid long, level string")
    assert tuple(W.hop_gate(found, golden, gone, level, 0.5).first()) == (4, 2, 0.5, 1, 2, "PASS")
    assert W.hop_gate(found, golden, gone, level, 0.6).first()["verdict"] == "FAIL"
    assert tuple(W.hop_gate(found, golden.where("false"), gone, level, 0.0).first()) == (0, 0, 0.0, 0, 0, "FAIL")


def test_relations_of_golden_items(spark):
    schema = "id long, subject string, relation string, object string"
    got = spark.createDataFrame([(0, "支付 系统", "uses", "SQLite-3"), (1, "甲", "uses", "乙方"), (2, "谁", "event_occurred", "发布会 召开"), (4, "x", "uses", "y")], schema)
    want = spark.createDataFrame(
        [(0, "支付系统", "USES ", "sqlite"), (1, "甲", "uses", "乙方"), (1, "丙", "uses", "丁"), (2, "no matter", "event_occurred", "发布会"), (3, None, None, None), (4, None, None, None), (5, "a", "uses", "b")], schema
    )
    hits = W.relation_hits(got, want)
    assert {r["id"]: r["hit"] for r in hits.collect()} == {0: True, 1: False, 2: True, 3: True, 4: False, 5: False}
    assert tuple(W.relation_accuracy(hits).first()) == (6, 3, 0.5, False)
    assert tuple(W.relation_accuracy(hits.where("false")).first())[:3] == (0, 0, 0.0)


@pytest.mark.parametrize(
    ("text", "names", "level"),
    [
        ("为什么 cron 还是 launchd", ["cron", "launchd"], "complex"),
        ("向量检索和全文检索的区别", ["全文检索的区别", "向量检索"], "complex"),
        ("怎么备份数据库", ["备份数据库"], "simple"),
        ("SQLite vs. DuckDB、Spark", ["DuckDB", "SQLite", "Spark", "vs."], "complex"),  # a joining word in Latin letters counts, as surveyed
        ("a", [], "simple"), ("", [], "simple"), (None, [], "simple"), ("如何如何", [], "simple"),
        ("缓存与 L3 状态。\n", ["L3", "状态。\n", "缓存"], "complex"),
    ],
)
def test_subjects_of_questions(spark, text, names, level):
    df = spark.createDataFrame([(text,)], "q string")
    r = df.select(X.question_subjects(F.col("q")).alias("n"), X.question_complexity(F.col("q")).alias("c")).first()
    assert (list(r["n"]), r["c"]["level"]) == (names, level)
    more = df.select(X.question_complexity(F.col("q"), 3).alias("c")).first()["c"]
    assert more["level"] == "complex" and more["entities"] == len(names) + 3


def test_content_words_and_told_names(spark):
    df = spark.createDataFrame([("怎么 backup 数据库 to s3 的 Kafka", "Atlas（项目）和《蓝图》用 检索引擎")], "a string, b string")
    r = df.select(X.content_words(F.col("a")).alias("w"), X.entities(F.col("b")).alias("n")).first()
    assert list(r["w"]) == ["backup", "数据库", "Kafka"] and list(r["n"]) == ["Atlas（项目）", "蓝图", "检索引擎"]


def test_window_channel_against_brute_force(spark):
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "规则", "delta"]
    store = [(f"m{i:03}", " ".join(r.sample(words, 2)), r.choice([None, "", "beta 规则们"]), None if i % 9 == 0 else f"2026-03-{r.randint(1, 28):02}") for i in range(300)]
    asked = [(0, "alpha 规则", "2026-03-05", "2026-03-11"), (1, "beta", "2026-03-07", "2026-03-07"), (2, None, "2026-03-01", "2026-03-28"), (3, "x", "2026-02-31", "2026-03-02"), (4, "x", None, None), (5, "x", "2030-01-01", "2030-01-02")]
    s = spark.createDataFrame(store, "id string, summary string, content string, d string").withColumn("event_date", F.to_date("d"))
    got = R.window_channel(spark.createDataFrame(asked, "qid long, text string, t1 string, t2 string"), s, Search())
    want = []
    for qid, text, t1, t2 in asked[:3]:
        near = sorted((x for x in store if x[3] and t1 <= x[3] <= t2), key=lambda x: (-int(x[3][-2:]), x[0]))[:15]
        span, ws = max(int(t2[-2:]) - int(t1[-2:]), 1), (text or "").split()
        score = lambda x: round(0.05 + 0.85 * max(0, 1 - (int(x[3][-2:]) - int(t1[-2:])) / span) + 0.1 * sum(w in f"{x[1] or ''} {x[2] or ''}" for w in ws) / max(len(ws), 1), 9)
        want += [(qid, x[0], score(x), n) for n, x in enumerate(sorted(near, key=lambda x: (-score(x), x[0])))]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_batch_added_twice_changes_nothing_and_pairs_only_what_is_new(spark):
    def batch(rows):
        return spark.createDataFrame(rows, "id string, text string")

    def names(archive):
        return {r["entity"]: (r["name"], r["entry_count"], r["first_seen"]) for r in archive.collect()}

    archive, links = spark.createDataFrame([], "entity string, name string, entry_count long, first_seen string"), spark.createDataFrame([], "entity string, entry string")
    one = batch([("m1", "《甲乙》与《丙丁》"), ("m2", "《甲乙》《甲 乙》"), ("m3", None), ("m4", "")])
    archive, links, edges = A.archived(one, archive, links, "t1")
    assert sorted(names(archive).values()) == [("丙丁", 1, "t1"), ("甲乙", 2, "t1")] and [r["shared"] for r in edges.collect()] == [1]
    again = A.archived(one, archive, links, "t2")
    assert names(again[0]) == names(archive) and again[1].count() == links.count() and again[2].count() == 0
    two = A.archived(batch([("m1", "《戊己》"), ("m5", "《甲乙》")]), archive, links, "t2")
    assert sorted(names(two[0]).values()) == [("丙丁", 1, "t1"), ("戊己", 1, "t2"), ("甲乙", 3, "t1")]
    own = {n: e for e, (n, _, _) in names(two[0]).items()}
    pairs = {frozenset((r["id1"], r["id2"])) for r in two[2].collect()}
    assert pairs == {frozenset((own["戊己"], own["甲乙"])), frozenset((own["戊己"], own["丙丁"]))}


def test_relations_are_put_in_order_and_replaced(spark):
    schema = "id1 string, id2 string, relation string, source string, weight double, updated_at string"
    held = spark.createDataFrame([("a", "b", "uses", "s", 0.1, "1"), ("a", "c", "uses", "s", 0.1, "1")], schema)
    new = spark.createDataFrame([("b", "a", "uses", "s", 0.5, "2"), ("a", "b", "uses", "s", 0.7, "2"), ("b", "a", "uses", "t", 0.2, "2"), ("d", "d", "uses", "s", 1.0, "2"), (None, "d", "uses", "s", 1.0, "2")], schema)
    got = sorted(map(tuple, A.upserted_relations(held, new).collect()))
    assert got == [("a", "b", "uses", "s", 0.7, "2"), ("a", "b", "uses", "t", 0.2, "2"), ("a", "c", "uses", "s", 0.1, "1")]


def test_promotion_verdicts_against_the_run_in_order(spark):
    r = random.Random(8)
    rows = [(f"m{i:02}", r.choice(["lesson", "lesson", "fact"]), r.choice(["p", "q", "r", None, ""]) if i % 2 else f"s{i}", r.choice([0.8, 0.85, 0.9, 0.95])) for i in range(60)]
    files, genes = {"m03", "m05", "m10"}, {"q", "s4"}
    known, want = set(genes), []
    for i, kind, summary, sure in sorted(rows, key=lambda x: (-x[3], x[0])):
        if kind != "lesson" or sure < 0.85:
            continue
        detail = "file" if i in files else "summary" if (summary or "") in known else ""
        if not detail:
            known.add(summary or "")
        want.append((i, "skip_dedup" if detail else "promote", detail, 0))
    got = A.promotion_verdicts(
        spark.createDataFrame(rows, "id string, type string, summary string, confidence double"), spark.createDataFrame([(f,) for f in files], "id string"), spark.createDataFrame([(g,) for g in genes], "summary string")
    )
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_reports(spark):
    full = json.dumps({"schema": "s/2", "asset": "a", "gate": {"decision": "go", "verdict": "old"}, "run": {"started_at": "t"}, "layers": [{"status": "pass"}, {"passed": True}, {"status": "fail"}, {}]})
    rows = [("g", "a", 1, full), ("g", "b", 1, json.dumps({"asset": "b", "gate": "hold", "layers": []})), ("h", "a", 2, full), ("i", "a", 3, "no json"), ("j", "a", 1, json.dumps({"gate": {"verdict": "hold"}}))]
    r = spark.createDataFrame(rows, "who string, path string, modified long, value string")
    got = {x["who"]: x["e"] and tuple(x["e"]) for x in P.newest(r, "who").select("who", P.evaluation(F.col("value")).alias("e")).collect()}
    assert got == {"g": ("b", "hold", None, 0, 0), "h": ("a", "go", "t", 4, 2), "i": None, "j": (None, "hold", None, None, None)}
    body = "建议总数：**12**\n采纳率（hit/(hit+miss)）：83.5%\n结晶命中总数：**7**\n低频提示（命中 ≤2 次）：x, y \n"
    two = spark.createDataFrame([(0, body), (1, "低频提示：无（无命中）\n"), (2, "")], "i long, v string").select("i", P.route_figures(F.col("v")).alias("f"))
    assert {x["i"]: tuple(x["f"]) for x in two.collect()} == {0: (12, 83.5, 7, "x, y"), 1: (None, None, None, "无（无命中"), 2: (None, None, None, None)}


def test_federated_hits_against_brute_force(spark):
    r = random.Random(2)
    terms = ["ab", "Ba", "aab", "zz", " ", None]
    rows = {s: [(i, "".join(r.choice("abAB") for _ in range(6)) if i % 7 else None, r.choice(["ab/x", "y", None]), r.randint(0, 5)) for i in range(40)] for s in ("store", "files")}
    sources = {s: spark.createDataFrame(v, "item long, text string, name string, newest long") for s, v in rows.items()}
    got = P.federated_hits(spark.createDataFrame(list(enumerate(terms)), "qid long, text string"), sources, 4)
    want = []
    for qid, t in enumerate(terms):
        if not (t or "").strip():
            continue
        hits = {s: sorted((x for x in v if t.lower() in (x[1] or "").lower() or t.lower() in (x[2] or "").lower()), key=lambda x: (-x[3], x[0]))[:4] for s, v in rows.items()}
        flat = sorted(((n + 1, s, x[0]) for s, v in hits.items() for n, x in enumerate(v)), key=lambda x: x[:2])
        want += [(qid, k + 1, s, i, round(1 / (n + 60), 6)) for k, (n, s, i) in enumerate(flat)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert list(itertools.islice(got.columns, 5)) == ["qid", "rank", "source", "item", "score"]


def test_search_looks_into_a_window_of_several_days(spark):
    store = [(f"m{i}", f"entry {i}", f"2026-03-{i:02}") for i in range(1, 29)]
    s = spark.createDataFrame(store, "id string, summary string, d string").select(
        "id", "summary", F.lit("").alias("content"), F.col("id").alias("summary_hash"), F.lit("fact").alias("type"), F.lit(0.5).alias("confidence"), F.concat("d", F.lit("T00:00:00Z")).alias("timestamp"),
        F.concat("d", F.lit("T00:00:00Z")).alias("created_at"), F.lit(0).alias("deprecated"), F.lit("").alias("expires_at"), F.to_date("d").alias("event_date"),
    )
    q = spark.createDataFrame([(0, "从 2026-03-10 到 2026年3月12日"), (1, "zz 2026-03-20 zz")], "qid long, text string")
    access = spark.createDataFrame([], "entry_id string, scene string, accessed_at timestamp")
    out = R.search(q, s, access, None, None, Search(time=True)).collect()
    assert [r["id"] for r in sorted(out, key=lambda r: r["rank"]) if r["qid"] == 0] == ["m10", "m11", "m12"]
    assert [r["id"] for r in sorted(out, key=lambda r: r["rank"]) if r["qid"] == 1][0] == "m20"


def test_fused_channels_are_shuffled_before_they_are_grouped(spark):
    """Channels that each stand by query are not taken to stand so together: read twice in a plan, the adaptive planner split them differently, and one of them was not seen."""
    spark.conf.unset("spark.sql.unionOutputPartitioning")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(q, f"m{i}", float(i)) for q in range(3) for i in range(5)], "qid long, id string, score double")
        channels = {name: R.ranked(rows.repartition(3), F.desc("score"), F.col("id"), limit=4) for name in ("fts", "emb")}
        store = spark.createDataFrame([(f"m{i}", 0.5) for i in range(5)], "id string, confidence double")
        found = R.fused(channels, store, Search())
        lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    union = next(i for i, line in enumerate(lines) if "Union" in line)
    assert "HashAggregate" in lines[union - 1] and "Exchange hashpartitioning(qid" in lines[union - 2]
    assert len(got) == 12 and {r["n_channels"] for r in got} == {2}
