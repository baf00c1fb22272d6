"""Bounds of ratios, promotion, distilling, tuning gates, layers under two writers."""

import datetime as dt
import difflib
import random

import pytest
from pyspark.sql import functions as F

from lodestore.functions import text as X
from lodestore.operators import distill as D
from lodestore.operators import ingest as I
from lodestore.operators import tuning as T
from lodestore.plans.filters import ingest_flags
from lodestore.sources import layers as L
from lodestore.versions import Conflict, Versions


def test_no_ratio_exceeds_its_bound(spark):
    r = random.Random(4)
    rows = [("".join(r.choice("abcdé文 ") for _ in range(r.randrange(0, 30))), "".join(r.choice("abcdé文 ") for _ in range(r.randrange(0, 30)))) for _ in range(1500)] + [("", "a"), ("abc", "abc"), ("ab", "ba")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", X.ratio_bound(F.col("a"), F.col("b")).alias("bound")).collect()
    for row in got:
        ratio = difflib.SequenceMatcher(None, row["a"], row["b"]).ratio() if row["a"] and row["b"] else 0.0
        assert ratio <= row["bound"] + 1e-9, row
    assert sum(row["bound"] < 0.85 for row in got) > 0.7 * len(got)


def test_most_pairs_of_a_hash_prefix_never_reach_python(spark):
    r = random.Random(1)
    text = lambda: " ".join(r.choice(["amber", "brick", "cloud", "delta", "ember", "flint"]) + str(r.randrange(99)) for _ in range(8))
    known = [(f"k{i:03d}", text(), "c", "abcdefgh01") for i in range(60)]
    incoming = [(f"n{i:03d}", known[i][1] + "." if i < 10 else text(), "c", "abcdefgh02") for i in range(60)]
    schema = "id string, summary string, content string, summary_hash string"
    out = {x["id"]: x["redundant_of"] for x in ingest_flags(spark.createDataFrame(incoming, schema), spark.createDataFrame(known, schema)).collect()}
    want = {i: min((k for k, t, _, _ in known if difflib.SequenceMatcher(None, s, t).ratio() >= 0.85), default=None) for i, s, _, _ in incoming}
    assert out == want and sum(v is not None for v in out.values()) >= 10
    pairs = [(s, t) for _, s, _, _ in incoming for _, t, _, _ in known]
    asked = spark.createDataFrame(pairs, "a string, b string").where(X.ratio_bound(F.col("a"), F.col("b")) >= 0.85).count()
    assert asked < 0.35 * len(pairs)


def test_promotion_writes_everything(spark):
    schema = "id string, type string, summary string, content string, confidence double, source_agent string, summary_hash string, timestamp string"
    at = "2026-08-31T10:00:00Z"
    second = [
        ("a1", "fact", "sure and dated 2026-08-01", "", 0.9, "x", "h1", at), ("a2", "record", "twice", "", 0.1, "x", "h2", at), ("a3", "record", "twice", "", 0.1, "x", "h2", at), ("a4", "idea", "unsure", "", 0.1, "x", "h3", at),
        ("a5", "rule", "asked", "请记住 yesterday", 0.1, "x", "h4", at), ("a6", "fact", "held", "", 0.95, "y", "h5", at), ("a7", "fact", "clashing", "", 0.95, "y", "h6", at), ("a8", "info", "no hash", None, 0.8, "y", None, at),
    ]
    third = [("t9", "fact", "held", "", 0.5, "z", "h5", at), ("t1", "fact", "held too", "", 0.5, "z", "h5", at), ("t3", "rule", "clashing", "", 0.5, "z", "h6", at)]
    out = {r["id"]: r for r in D.promotion(spark.createDataFrame(second, schema), spark.createDataFrame(third, schema), "2026-09-01T00:00:00Z").collect()}
    assert set(out) == {"a1", "a2", "a5", "a6", "a7", "a8"}
    assert out["a1"]["event_date"] == dt.date(2026, 8, 1) and out["a5"]["event_date"] == dt.date(2026, 8, 30) and out["a2"]["event_date"] is None
    assert (out["a1"]["expires_at"], out["a2"]["expires_at"], out["a5"]["expires_at"]) == ("2026-11-30T00:00:00Z", "2026-10-01T00:00:00Z", "")
    assert [(out[i]["op"], out[i]["into"], out[i]["conflict_type"]) for i in ("a1", "a6", "a7")] == [("insert", "a1", "independent"), ("update", "t1", "extension"), ("update", "t3", "conflict")]
    assert out["a5"]["reason"] == "keyword" and out["a2"]["audit"] == '{"at":"2026-09-01T00:00:00Z","op":"insert","reason":"repeat"}'


def test_a_batch_is_held_against_what_is_stored(spark):
    long = "a long enough summary about the storage engine and its index number "
    stored = [("s1", long + "one"), ("s2", long + "one!"), ("s3", "something else entirely that nobody repeats")]
    new = [("n1", long + "onE"), ("n2", "fresh words that stand alone in this batch of texts"), ("n3", "fresh words that stand alone in this batch of texts."), ("s3", "something"), ("n4", long + "one不")]
    out = {r["id"]: (r["state"], r["duplicate_of"]) for r in D.storable(spark.createDataFrame(new, "id string, summary string"), spark.createDataFrame(stored, "id string, summary string")).collect()}
    assert out == {"n1": ("duplicate", "s1"), "n2": ("stored", None), "n3": ("duplicate", "n2"), "s3": ("known", None), "n4": ("stored", None)}
    judged = I.accepted_against(spark.createDataFrame(new[:3], "id string, text string"), spark.createDataFrame([], "id string, text string"))
    assert {r["id"]: r["accepted"] for r in judged.collect()} == {"n1": True, "n2": True, "n3": False}


def test_a_chain_run_lists_its_steps(spark):
    rows = [(f"e{i:02d}", "fact", f"summary {i} of agent", "agent", 0.61 + i / 100, 5, "2026-01-01T00:00:00Z", "30d") for i in range(8)] + [("p", "fact", "x", "agent", 0.2, 1, "2026-01-01T00:00:00Z", "permanent"), ("L", "L4b", "y", "agent", 0.99, 1, "2026-01-01T00:00:00Z", "30d")]
    store = spark.createDataFrame(rows, "id string, type string, summary string, source_agent string, confidence double, importance int, updated_at string, half_life string")
    out = D.distill_run(store, "2026-09-01T00:00:00Z", "2026-08-01T00:00:00Z").collect()
    assert [(r["id"], r["what"]) for r in out if r["step"] == "pattern"] == [("agent", "8")]
    assert [r["what"] for r in out if r["step"] == "store"] == ["duplicate"]  # the pattern's summary is that of its surest entry
    assert len([r for r in out if r["step"] == "decay"]) == 8 and ("e00", "0.51/4") in {(r["id"], r["what"]) for r in out}


def scores(spark, table):
    return spark.createDataFrame([(g, q, float(s)) for g, own in enumerate(table) for q, s in enumerate(own)], "g int, qid long, ndcg double")


@pytest.mark.parametrize(
    ("table", "history", "decision"),
    [
        ([[1, 1, 1, 1], [0, 0, 1, 1], [9, 9, 9, 9]], [], "no_change"),
        ([[0, 0, 1, 1], [1, 1, 1, 1], [9, 9, 9, 9]], [0, 1], "gate_pass"),
        ([[0, 0, 1, 1], [1, 1, 1, 0.5], [9, 9, 9, 9]], [], "gate_fail"),
        ([[0.5, 0, 1, 1], [0.4, 1, 1, 1], [9, 9, 9, 9]], [0], "gate_fail"),
        ([[0.5, 0, 1, 1], [0.4, 1, 1, 1], [9, 9, 9, 9]], [1], "gate_pass"),
    ],
)
def test_weights_must_pass_their_gates(spark, table, history, decision):
    past = spark.createDataFrame([(q,) for q in history], "qid long")
    row = T.tuned(scores(spark, table), 0, 2, F.col("qid") < 2, past).first()
    assert row["decision"] == decision and row["candidate"] == (0 if decision == "no_change" else 1)


def test_a_drifted_corpus_freezes_the_comparison(spark):
    base = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.5, 0.5)], "qid long, ndcg double, p5 double")
    worse = base.withColumn("p5", F.when(F.col("qid") == 1, 0.9).otherwise(0.4))
    say = lambda now, rows=100, w={"a": 1}: T.monthly_gate(base, now, 100, rows, {"a": 1}, w).first()["decision"]  # noqa: B006, E731
    assert [say(base), say(worse), say(base, 110), say(base, 109), say(base, 100, {"a": 2})] == ["pass", "block", "freeze", "pass", "freeze"]


def test_a_log_s_regressions_are_united(spark):
    lines = ['{"regress_detail": [{"id": "q1"}, {"id": "q2"}]}', '{"regress_detail": ["q3"]}', '{"regress_detail": [{"id": "q1"}]}', "no json", '{"other": 1}', '{"regress_detail": []}']
    assert {r["qid"] for r in T.past_regressions(spark.createDataFrame([(x,) for x in lines], "value string")).collect()} == {"q1", "q2", "q3"}


def test_two_writers_of_a_layer_repeat_nothing(spark, tmp_path, monkeypatch):
    root, plain, other = f"file://{tmp_path}/layer", Versions.commit, []
    rows = spark.createDataFrame([("a", "1", "mine"), ("a", "2", "mine")], "agent string, id string, summary string")

    def commit(self, base, state):
        if not other:  # another writer comes first, with one of the same ids
            other.append(1)
            L.write_layer(spark.createDataFrame([("a", "2", "theirs"), ("b", "1", "theirs")], rows.schema), root)
        return plain(self, base, state)

    monkeypatch.setattr(Versions, "commit", commit)
    L.write_layer(rows, root)
    assert sorted(map(tuple, L.read_layer(spark, root).select("agent", "id", "summary").collect())) == [("a", "1", "mine"), ("a", "2", "theirs"), ("b", "1", "theirs")]
    register = spark.createDataFrame([("s1",)], "source_id string")
    pages = spark.createDataFrame([("p1", "s1"), ("p2", "s2"), ("p3", None)], "page string, source string")
    assert {r["page"] for r in L.unregistered(pages, register, "source").collect()} == {"p2", "p3"}
    assert issubclass(Conflict, RuntimeError)


def test_large_groups_are_joined_in_blocks(spark, monkeypatch):
    from lodestore.operators import graphs as G

    r = random.Random(3)
    links = [(g, r.randrange(60)) for g in range(12) for _ in range(r.choice([1, 2, 40]))] + [(None, 1), (3, None)]
    groups = {}
    for g, m in links:
        if g is not None and m is not None:
            groups.setdefault(g, set()).add(m)
    want = {}
    for own in groups.values():
        for a in own:
            for b in own:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    df = spark.createDataFrame(links, "g long, m long")
    for block in (512, 7):
        monkeypatch.setattr(G, "BLOCK", block)
        got = G.shared_pairs(df, "g", "m").collect()
        assert {(x["a"], x["b"]): x["n"] for x in got} == want and len(got) == len(want)


def test_conflict_candidates_of_long_runs(spark):
    rows = [(f"n{i}", s, f"2026-01-{i + 1:02d}") for i, s in enumerate(["alphabeta gamma", "xx" * 2000 + "alphabetaxx", "gammaray only", "数据系统 abc", "新数据系统"])]
    notes = spark.createDataFrame(rows, "id string, summary string, timestamp string")
    pairs = {tuple(r) for r in I.conflict_candidates(notes).collect()}
    assert {("n0", "n1"), ("n0", "n2"), ("n3", "n4"), ("n4", "n3")} <= pairs and ("n2", "n3") not in pairs


def test_windows_of_questions(spark):
    from lodestore.functions import extract as E

    cases = [("2026-08-01", "2026-08-01", "2026-08-01"), ("2026年8月", "2026-08-01", "2026-08-01"), ("2026-08 和 2026/7", "2026-07-01", "2026-08-01"), ("2026.12.31 到 2025年1月2日, 2024-05", "2025-01-02", "2026-12-31"), ("2026-13-01", None, None), ("2026年13月", None, None), ("1900-01-01", None, None), ("", None, None), (None, None, None), ("x12026-08-01", None, None)]
    t1, t2 = E.asked_window(F.col("q"))
    got = spark.createDataFrame([(c[0],) for c in cases], "q string").select(t1.alias("a"), t2.alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [c[1:] for c in cases]


def test_relations_are_traced_once_and_become_edges(spark):
    rows = [("e1", "检索模块依赖向量库", "", None), ("e2", "检索模块依赖向量库，很快", None, ""), ("e3", "nothing here", "", None), ("e4", "缓存使用内存", "", '[{"subject":"甲","relation":"uses","object":"乙丙","confidence":0.5}]'), ("", "缓存使用内存", "", None), ("e5", "x", "", "[]")]
    out = I.traced_relations(spark.createDataFrame(rows, "id string, content string, summary string, relations string"))
    told = {r["id"]: r["relations"] for r in out.collect()}
    assert told["e3"] == "[]" and told["e5"] == "[]" and told[""] is None and "依赖" not in told["e1"] and "向量库" in told["e1"]
    assert sorted(map(tuple, I.relation_edges(out).collect())) == [("检索模块", "向量库", "depends_on", 0.9, 2), ("甲", "乙丙", "uses", 0.5, 1)]


def test_the_gravest_conflict_marks_an_entry(spark):
    pairs = [("a", "b", "conflict_event_fact"), ("a", "c", "conflict_rule_semantic"), ("a", "d", "extension"), ("b", "a", "conflict_event_fact"), ("c", "d", "independent")]
    out = I.conflict_marks(spark.createDataFrame(pairs, "id string, other string, class string")).collect()
    assert {(r["id"], r["conflict_type"], tuple(r["others"])) for r in out} == {("a", "conflict_rule_semantic", ("b", "c")), ("b", "conflict_event_fact", ("a",))}
