"""Literal fixtures and invariants of the engine's functions."""

import random

import pytest
from pyspark.sql import functions as F

from lodestore.config import SEMANTIC_RELATIONS, VALID_TYPES, Search
from lodestore.functions import extract as E
from lodestore.functions import lifecycle as L
from lodestore.functions import text as X
from lodestore.operators import graphs as G
from lodestore.operators import ingest as I
from lodestore.operators import retrieval as R
from lodestore.plans.filters import ingest_flags, write_problems
from lodestore.plans.retrieval import route
from lodestore.sources import files
from lodestore.streaming import logs


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def lit(x):
    return F.lit(x)


def test_trust_decay(spark):
    assert one(spark, L.trust_decay(lit(1.0), lit(7)), L.trust_decay(lit(0.5), lit(365)), L.trust_decay(lit(0.8), lit(0))) == (round(0.95**7, 2), 0.1, 0.8)


@pytest.mark.parametrize(("summary", "content", "confidence", "ok"), [("", "", 0.9, False), ("valid one", "", 0.1, False), ("valid one", "x" * 10001, 0.9, False), ("test", "", 0.9, False), ("飞书Token限流经验", "", 0.9, True)])
def test_write_filter(spark, summary, content, confidence, ok):
    assert (one(spark, F.size(write_problems(lit(summary), lit(content), lit(confidence))))[0] == 0) is ok


def test_topic_similarity(spark):
    def sim(a, b):
        def split(t):
            spaced = F.regexp_replace(F.regexp_replace(lit(t), r"([\x{4e00}-\x{9fff}])([a-zA-Z0-9])", "$1 $2"), r"([a-zA-Z0-9])([\x{4e00}-\x{9fff}])", "$1 $2")
            return X.keywords(spaced)

        return one(spark, X.overlap(split(a), split(b)))[0]

    assert sim("飞书Token限流", "今天天气很好") < 0.3
    assert sim("飞书Token限流500次", "飞书Token限流500次") == 1.0


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("今日上海天气晴朗气温25度", "服务器部署完成后CPU占用率下降", "independent"),
        ("数据库备份策略：每日全量备份保留30天", "数据库备份策略：每日凌晨2点全量备份到本地磁盘", "extension"),
        ("规则：开发环境应该允许直接连接生产数据库", "规则：开发环境必须禁止直接连接生产数据库", "conflict_rule_semantic"),
    ],
)
def test_conflict_classes(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a string, b string").withColumn("s", F.greatest(X.ratio("a", "b"), X.jaccard(X.ngrams(X.normal_text(F.col("a")), 3), X.ngrams(X.normal_text(F.col("b")), 3))))
    got = row.select(I.conflict_class(F.col("a"), F.col("b"), F.col("s")).alias("c")).first()["c"]
    assert got == want


def test_conflict_candidates_hold_any_keyword(spark):
    texts = ["a cat database", "old databases stay", "so on: a CAT", "数据库备份策略", "每日备份", "冲突 is on", "no tie", "", None, *[f"x{i} vector index" for i in range(9)], "an index, vectorised"]
    rows = [(f"m{i:02}", t, f"2026-01-{1 + i * 7 % 20:02}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, summary string, timestamp string")
    keys = {r["id"]: r["k"] for r in df.select("id", I.conflict_keywords(F.col("summary")).alias("k")).collect()}
    assert keys["m00"] == ["database", "cat"] and keys["m03"] == sorted(["数据", "据库", "库备", "备份", "份策", "策略"])[:3] and keys["m05"] == ["冲突"]
    newest = sorted(rows, key=lambda r: r[0])
    newest.sort(key=lambda r: r[2], reverse=True)
    want = {i: [o for o, t, _ in newest if o != i and any(k in (t or "").lower() for k in keys[i])][:5] for i, *_ in rows}
    got = {(r["id"], r["other"]) for r in I.conflict_candidates(df).collect()}
    assert got == {(i, o) for i, others in want.items() for o in others}
    assert ("m00", "m01") in got and ("m00", "m02") in got and ("m02", "m00") in got and ("m01", "m00") not in got


def test_similarity_dedup(spark):
    texts = [("a", "看板任务状态的查看方法"), ("b", "看板任务状态查看方法"), ("c", "系统每周六上午10点自动执行备份任务"), ("d", "系统每周六上午10点不自动执行备份任务"), ("e", "服务器机柜温度监控方案")]
    found = {(r["a"], r["b"]) for r in I.duplicates(spark.createDataFrame(texts, "id string, text string"), 0.8).collect()}
    assert ("a", "b") in found and ("c", "d") not in found and not any("e" in p for p in found)


def test_guard_accepts_in_order(spark):
    r = random.Random(9)
    base = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(80))
    texts = [(0, base)]
    for i in range(1, 25):  # each a little further from the first: copies of refused texts pass again
        x = list(texts[-1][1])
        for at in r.sample(range(80), 2):
            x[at] = r.choice("0123456789")
        texts.append((i, "".join(x)))
    texts += [(30, "tiny"), (31, "tiny"), (32, base), (33, None), (34, "")]

    def dice(a, b):
        x, y = ({t[i : i + 2] for i in range(len(t) - 1)} for t in (a, b))
        return 2 * len(x & y) / (len(x) + len(y))

    kept, want = [], {}
    for i, t in texts:
        like = [k for k in kept if len(t or "") >= 8 and len(texts_by[k]) >= 8 and dice(t, texts_by[k]) >= 0.9] if (texts_by := {j: u or "" for j, u in texts}) else []
        want[i] = (not like, min(like, default=None))
        if not like:
            kept.append(i)
    got = {x["id"]: (x["accepted"], x["duplicate_of"]) for x in I.accepted(spark.createDataFrame(texts, "id int, text string")).collect()}
    assert got == want and sum(ok for ok, _ in want.values()) > 4


def test_duplicates_are_judged_on_whole_notes(spark, tmp_path):
    opening = "The quarterly report on warehouse automation was published today by"
    r = random.Random(1)
    body = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(400))
    texts = [f"{opening} zebra jumping quickly over vexed gnomes 123", f"{opening} {body}", f"Once edited, this begins anew: {body}", f"My altered copy of it goes so: {body}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    import __spark_entry__

    got = {(int(r["a"][1:]), int(r["b"][1:])) for r in __spark_entry__.queries()["p6_x19_duplicates"](spark, str(tmp_path)).collect()}
    assert (2, 3) in got and not any(0 in p for p in got)


def test_key_data_of_whole_contents(spark, tmp_path):
    spark.createDataFrame([(0, "plain words " * 200 + "on 2026-08-26 some 37% of it")], "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    import __spark_entry__

    row = __spark_entry__.queries()["x7_x9_r21_verify"](spark, str(tmp_path)).first()
    assert row["n_keys"] == row["passed"] == row["total"] == 2


def test_similar_pairs_are_complete(spark):
    words = ["alpha beta gamma", "alpha beta gamme", "alpha bета", "delta", "alphabeta gamma", "zzz", "", "delta!"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id int, text string")
    g = df.select("id", X.ngrams(X.normal_text(F.col("text")), 2).alias("g")).where("size(g) > 0")
    want = {(r["a"], r["b"]) for r in g.select(F.col("id").alias("a"), F.col("g").alias("x")).crossJoin(g.select(F.col("id").alias("b"), F.col("g").alias("y"))).where("a < b").where(X.dice(F.col("x"), F.col("y")) >= 0.8).collect()}
    assert {(r["a"], r["b"]) for r in I.similar_pairs(df, 0.8).collect()} == want


def test_ingest_filter(spark):
    new = spark.createDataFrame([("x", "好的", "", "h1"), ("y", "a long enough summary of things", "c", "abcdefgh1234")], "id string, summary string, content string, summary_hash string")
    old = spark.createDataFrame([("k", "a long enough summary of thing", "c", "abcdefgh9999")], "id string, summary string, content string, summary_hash string")
    got = {r["id"]: (r["state"], r["redundant_of"]) for r in ingest_flags(new, old).collect()}
    assert got == {"x": ("low_value", None), "y": ("redundant", "k")}


def test_types():
    assert len(VALID_TYPES) == 25 and "fake_type" not in VALID_TYPES


def test_router(spark):
    def mode(q):
        m, sure = route(lit(q))
        return one(spark, m, sure)

    assert mode("sqlite 报错 怎么办") == ("fts", 0.9)
    assert mode("怎么 修复 sqlite") == ("dual", 0.85)
    assert mode("今天天气") == ("fts", 0.8)
    assert mode("hello there") == ("dual", 0.5)


def test_dates(spark):
    anchor = lit("2026-09-10").cast("date")

    def day(text):
        d = one(spark, E.event_date(lit(text), anchor))[0]
        return d and (str(d["day"]), d["confidence"])

    assert day("on 2026-08-05 we met") == ("2026-08-05", 0.95)
    assert day("2026年8月5日上线") == ("2026-08-05", 0.95)
    assert day("seen yesterday") == ("2026-09-09", 0.85)
    assert day("3 days ago, in 2026") == ("2026-09-07", 0.85)
    assert day("2天前发生") == ("2026-09-08", 0.85)
    assert day("nothing") is None
    assert day("decomposition. 2 of them in 2026") == ("None", None)
    want = {"on Sept 3rd": "2026-09-03", "Dec 24 was cold": "2025-12-24", "met last tuesday": "2026-09-08", "last Thursday": "2026-09-03", "in 2 weeks": "2026-09-24", "5 months ago": "2026-04-13", "3 个月前": "2026-06-12", "2周后": "2026-09-24", "上周": "2026-09-03", "上个月": "2026-08-11", "去年": "2025-09-10", "tonight": "2026-09-10", "last night": "2026-09-09", "前天": "2026-09-08"}
    assert {t: day(t) for t in want} == {t: (d, 0.85) for t, d in want.items()}
    assert day("March 5, 2024, a week ago") == ("2024-03-05", 0.95)


def test_extraction(spark):
    assert E.scan_triples("检索模块依赖向量库，很快。") == [("检索模块", "depends_on", "向量库", 0.9)]
    assert E.key_tokens("26.7% 与 500万，2026-08-26 通过 42") == [("percent", "26.7%"), ("money", "500万"), ("date", "2026-08-26"), ("conclusion", "通过"), ("number", "42")]
    assert one(spark, E.entities(lit("《长期记忆》和检索引擎")))[0][0] == "长期记忆"
    assert sum(map(len, E.VERBS.values())) == 61 and set(E.VERBS) == set(SEMANTIC_RELATIONS)
    assert E.scan_triples("团队已决定采用新框架，并且启动迁移") == [("团队已", "decides", "采用新框架", 0.9)]
    assert E.scan_triples("小组确认完成部署。系统使用系统") == []
    assert E.scan_triples("缓存层复用连接池以及线程池") == [("缓存层", "uses", "连接池", 0.85)]
    assert E.scan_triples(None) == [] and E.key_tokens(None) == []


def test_half_life(spark):
    assert one(spark, *[L.half_life_days(lit(x)) for x in ("permanent", "30d", "8w", "6m", "2y", "zz")]) == (None, 30, 56, 180, 730, None)


def test_fusion_is_symmetric_in_channels(spark):
    store = spark.createDataFrame([("a", 0.5), ("b", None), ("c", 0.9)], "id string, confidence double")
    x = spark.createDataFrame([(1, "a", 3.0, 0), (1, "b", 2.0, 1)], "qid int, id string, score double, rank0 int")
    y = spark.createDataFrame([(1, "c", 0.9, 0), (1, "b", 0.8, 1)], "qid int, id string, score double, rank0 int")
    cfg = Search()
    rows = [[(r["id"], r["score"]) for r in R.fused(ch, store, cfg).orderBy("rank0").collect()] for ch in ({"fts": x, "emb": y}, {"emb": y, "fts": x})]
    assert rows[0] == rows[1] and {i for i, _ in rows[0]} == {"a", "b", "c"}
    alone = [(r["id"], r["score"]) for r in R.fused({"fts": x}, store, cfg).orderBy("rank0").collect()]
    assert alone == [("a", 3.0), ("b", 2.0)]


def test_stored_index_answers_like_the_store(spark, tmp_path):
    from lodestore.operators.index import TextIndex

    texts = [("a", "the red house", "a house by the sea"), ("b", None, "red red wine"), ("c", "sea", ""), ("d", "", None), ("e", "文字 text", "more text, Text")]
    store = spark.createDataFrame(texts, "id string, summary string, content string")
    index = TextIndex.build(store, f"file://{tmp_path}/index")
    queries = spark.createDataFrame([(1, "red house"), (2, "text 文字 sea"), (3, "nowhere"), (4, "")], "qid long, text string")
    found = R.bm25(queries, TextIndex.open(spark, index.root))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, R.bm25(queries, store).collect())) and index.docs == 5
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(lower(coalesce(summary" not in plan and "tf_full" in plan
    empty = TextIndex.build(store.limit(0), f"file://{tmp_path}/none")
    assert R.bm25(queries, empty).count() == 0


def test_vector_tasks_pass_on_their_best_only(spark):
    r = random.Random(4)
    vecs = [(f"m{i:04}", [float(r.randrange(3)) for _ in range(4)]) for i in range(3000)]  # many ties
    entries = spark.createDataFrame(vecs, "id string, vec array<float>").repartition(3)
    asked = spark.createDataFrame([(q, [float(r.randrange(3)) for _ in range(4)]) for q in range(5)], "qid long, qvec array<float>")
    cfg = Search(candidates=7)
    out = R.vectors(asked, entries, cfg)
    got = {(x["qid"], x["rank0"]): x["id"] for x in out.collect()}
    for q, v in asked.collect():
        want = sorted(vecs, key=lambda e: (-sum(a * b for a, b in zip(v, e[1], strict=True)), e[0]))[:7]
        assert [got[q, n] for n in range(7)] == [e[0] for e in want]
    best = R.Best(5, 7)
    for at in range(0, 3000, 500):
        part = vecs[at : at + 500]
        import numpy as np

        best.add(np.array([e[0] for e in part], object), np.array([e[1] for e in part]) @ np.array([list(v) for _, v in asked.collect()]).T)
    assert len(best.cut()[0]) == 5 * 7


def test_search_switches(spark):
    from lodestore.operators.contradictions import contradict, greedy_contradictions, losers

    rows = [
        {"id": "a", "summary": "the port of the gateway is 8080 for all", "content": "", "summary_hash": "aaaaaaaa1111", "confidence": 0.9, "timestamp": "2026", "score": 1.0},
        {"id": "b", "summary": "the port of the gateway 不是 that: choose nine thousand", "content": "", "summary_hash": "aaaaaaaa2222", "confidence": 0.5, "timestamp": "2026", "score": 0.9},
        {"id": "c", "summary": "quite another matter", "content": "", "summary_hash": "cccccccc", "confidence": 0.1, "timestamp": "2026", "score": 0.8},
    ]
    assert contradict(rows[0], rows[1]) and not contradict(rows[0], rows[2]) and losers(rows) == {1} and losers(rows[::-1]) == {1}
    assert losers([rows[0], rows[0] | {"id": "d"}]) == set()  # both say the same
    df = spark.createDataFrame([(7, n, *r.values(), int(r["id"] == "c")) for n, r in enumerate(rows)], "qid int, rank0 int, id string, summary string, content string, summary_hash string, confidence double, timestamp string, score double, deprecated int")
    assert [r["id"] for r in greedy_contradictions(df).collect()] == ["a"]
    from lodestore.plans.common import access_log, bench_queries, entry_edges, entry_vectors, query_vectors, store

    d = "/root/testdata/sf0.001"
    q = bench_queries(spark, d).unionByName(spark.createDataFrame([(99_999, "what was on 2026-03-05"), (99_998, "error in config-42 now")], "qid long, text string"))
    for switches in ({"time": True}, {"router": True}, {"contradictions": True}, {"router": True, "gate": True, "time": True, "graph": True, "contradictions": True}):
        out = R.search(q, store(spark, d), access_log(spark, d), query_vectors(spark, d), entry_vectors(spark, d), Search(**switches), None, entry_edges(spark, d)).collect()
        by = {x["qid"] for x in out}
        assert by == {r["qid"] for r in q.collect()} and all(sum(x["qid"] == i for x in out) <= 5 for i in by)
        if switches.get("time"):
            assert {x["mode"] for x in out if x["qid"] == 99_999} & {"time_only", "dual_rrf_time4th", "dual_rrf_time4th_graph"}


def test_containment(spark):
    from lodestore.operators.containment import holding

    texts = spark.createDataFrame([(1, "one two"), (2, "two three"), (3, None), (4, "")], "id long, text string")
    strings = spark.createDataFrame([("x", "two"), ("y", ""), ("z", None), ("w", "two"), ("v", "four")], "k string, s string")
    assert {tuple(r) for r in holding(texts, "id", "text", strings, "k", "s").collect()} == {("x", 1), ("x", 2), ("w", 1), ("w", 2), ("y", 1), ("y", 2), ("y", 4)}


def test_prefix_pairs_are_complete(spark):
    r = random.Random(2)
    sets = [(i, sorted({min(r.randrange(20), r.randrange(20)) for _ in range(r.randrange(1, 9))})) for i in range(60)]
    df = spark.createDataFrame(sets, "id int, ks array<int>")
    got = {tuple(x) for x in I.prefix_pairs(df, F.greatest(F.lit(1), F.ceil(0.5 * F.col("n")))).collect()}
    want = {(a, b) for a, x in sets for b, y in sets if a < b and 2 * len({*x} & {*y}) >= max(len(x), len(y))}
    every = {(a, b) for a, x in sets for b, y in sets if a < b and {*x} & {*y}}
    assert want <= got < every


def test_neighbours_of_named_entries(spark):
    edges = spark.createDataFrame([("a", "b", "same_agent", 0.5), ("c", "b", "same_agent", 0.5), ("d", "c", "same_agent", 0.1)], "id1 string, id2 string, relation string, weight double")
    seeds = spark.createDataFrame([("c",), ("a",)], "id string")
    assert {tuple(r) for r in G.expanded(seeds, edges).collect()} == {("b", 0.5, "a"), ("d", 0.1, "c")}


def test_neighbours_and_plan(spark):
    edges = spark.createDataFrame([(1, 2, "same_agent", 0.5), (3, 1, "same_agent", 0.9), (2, 4, "same_type", 1.0)], "id1 int, id2 int, relation string, weight double")
    seeds = spark.createDataFrame([(1,)], "id int")
    got = {(r["id"], r["weight"]) for r in G.expanded(seeds, edges, 3, ("same_agent",)).collect()}
    assert got == {(2, 0.5), (3, 0.9)}
    plan = G.neighbours(seeds, edges)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_snapshot_log_and_stream(spark, tmp_path):
    df = spark.range(5).withColumn("v", F.col("id") * 2)
    files.write_snapshot(df, str(tmp_path / "snap"), "1")
    assert files.read_snapshot(spark, str(tmp_path / "snap"), "1").count() == 5
    with pytest.raises(Exception):
        files.write_snapshot(df, str(tmp_path / "snap"), "1")
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text('{"ts":"2026-01-02T00:00:00Z","query":"q","hit":true}\n{broken\n{"ts":"2025-01-02T00:00:00Z","query":"r","hit":false}\n')
    assert [r["query"] for r in files.read_log(spark, str(tmp_path / "log"), since="2026-01-01").collect()] == ["q"]
    events = logs.event_stream(spark, "/root/testdata/sf0.001")
    got = logs.drained(logs.windowed_usage(events), "usage", str(tmp_path / "cp"))
    assert got.agg(F.sum("uses")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, 1), (2, 2)], "k int, v int")
    new = spark.createDataFrame([(2, 9), (3, 3)], "k int, v int")
    once = I.merged(base, new, "k", ["v"]).drop("op")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, I.merged(once, new, "k", ["v"]).drop("op").collect())) == [(1, 1), (2, 9), (3, 3)]
