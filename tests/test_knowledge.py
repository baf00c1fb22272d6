"""Cached results, cells of vectors, similar vectors, alias classes, concepts, snapshots and the stateful stream of miss cards."""

import datetime as dt
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestore.api import Engine
from lodestore.config import Search
from lodestore.operators import aliases as A
from lodestore.operators import concepts as C
from lodestore.operators import retrieval as R
from lodestore.operators import vectors as V
from lodestore.operators.cache import ResultCache
from lodestore.operators.index import TextIndex
from lodestore.sources.snapshots import Snapshots
from lodestore.sources.store import store
from lodestore.streaming.cards import CARDS, open_cards, run_cards, write_once, written

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# results kept


def test_a_repeated_search_reads_no_postings_and_a_write_invalidates(spark, tmp_path, monkeypatch):
    whole = store(spark, SMALL)
    index = TextIndex.build(whole.where("doc_id < 150"), f"file://{tmp_path}/index")
    engine = Engine(spark, whole, index=index, cache=ResultCache(spark, f"file://{tmp_path}/results"), now="2026-09-01T00:00:00Z")
    asked = ["the first words", "of a question", "nothingness of zzz"]
    first = rows(engine.search_memories(asked))
    calls = []
    plain = R.best_bm25
    monkeypatch.setattr(R, "best_bm25", lambda *a, **k: calls.append(1) or plain(*a, **k))
    assert rows(engine.search_memories(["the  first\nwords ", "of a question", "nothingness of zzz"])) == first and not calls
    assert len(rows(engine.search_memories(asked[:1]))) == len([r for r in first if r[0] == 0]) and not calls
    engine.search_memories(asked[:1], top_k=2).count()
    assert len(calls) == 1  # other settings are another key
    rows(engine.search_memories([*asked, "one more"]))
    assert len(calls) == 2
    engine.now = "2026-09-01T00:06:00Z"
    assert rows(engine.search_memories(asked)) == first and len(calls) == 3  # too old
    engine.index = index.add(whole.where("doc_id >= 150"))
    assert rows(engine.search_memories(asked)) == rows(Engine(spark, whole, index=engine.index).search_memories(asked)) and len(calls) == 5
    assert engine.cache.swept("2026-09-01T00:06:01Z") == 3


# vectors


@pytest.fixture(scope="module")
def crowd():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 3000)] + 0.5 * rng.normal(size=(3000, 24))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("k", [20, 200])
def test_cells_hold_most_of_the_exact_top(spark, crowd, tmp_path, k):
    entries = spark.createDataFrame([(f"m{i:05d}", v.tolist()) for i, v in enumerate(crowd)], "id string, vec array<float>")
    asked = spark.createDataFrame([(i, crowd[i * 60].tolist()) for i in range(40)], "qid long, qvec array<float>")
    index = V.VectorIndex.build(entries, f"file://{tmp_path}/v{k}")
    again = V.VectorIndex.open(spark, index.root)
    assert again.probes == index.probes < len(index.cells)
    exact = {(r["qid"], r["id"]): r["score"] for r in R.vectors(asked, entries, Search(candidates=k)).collect()}
    found = {(r["qid"], r["id"]): r["score"] for r in again.search(asked, k).collect()}
    common = exact.keys() & found.keys()
    assert len(common) >= 0.9 * len(exact) and len(found) == len(exact)
    assert all(abs(exact[p] - found[p]) < 1e-6 for p in common)
    opened = again._rows([0, 1])
    assert "PartitionFilters: [cell" in opened._jdf.queryExecution().executedPlan().toString()


def test_recall_on_the_given_vectors(spark, tmp_path):
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pylist()
    entries = spark.createDataFrame([(r["vec_id"], r["embedding"]) for r in table], "id long, vec array<float>")
    asked = spark.createDataFrame([(r["vec_id"], r["embedding"]) for r in table if r["vec_id"] % 50 == 0], "qid long, qvec array<float>")
    index = V.VectorIndex.build(entries, f"file://{tmp_path}/given")
    exact = {(r["qid"], r["id"]) for r in R.vectors(asked, entries, Search()).collect()}
    found = {(r["qid"], r["id"]) for r in index.search(asked, 200).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_similar_vectors_equal_brute_force(spark, crowd, monkeypatch):
    x = np.concatenate([crowd[:300], crowd[:40], np.zeros((2, 24))])  # copies and zero vectors
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, vec array<float>")
    y = V.unit(np.float32(x).astype(np.float64))
    cosine = np.round(y @ y.T, 6)
    want = {(i, j): cosine[i, j] for i in range(340) for j in range(i + 1, 340) if cosine[i, j] >= 0.8}
    for block in (1024, 16):  # a bucket of several blocks
        monkeypatch.setattr(V, "BLOCK", block)
        got = V.similar_vectors(df).collect()
        assert {(r["a"], r["b"]): r["cosine"] for r in got} == pytest.approx(want) and len(got) == len(want) > 300


# aliases


def test_chains_and_circles_of_merges_have_one_keeper(spark):
    e = [(i, f"name {i}", i % 5, i + 1 if i < 30 else None) for i in range(1, 31)]
    e += [(101, "a", 1, 102), (102, "b", 1, 103), (103, "c", 9, 101), (200, "Ｘ Atlas", 1, None), (201, "XAtlas", 2, None), (202, "《X Atlas》", 0, None), (300, "lost", 0, 999)]
    entities = spark.createDataFrame(e, "id long, name string, entry_count long, merged_to long")
    classes = A.alias_classes(entities)
    keeper = {r["id"]: r["keeper"] for r in classes.collect()}
    assert {keeper[i] for i in range(1, 31)} == {14}  # most entries, then the least name
    assert keeper[101] == keeper[102] == keeper[103] == 103 and keeper[200] == keeper[201] == 201 and keeper[300] == 300
    merged = A.merged_entities(entities, classes)
    state = {r["id"]: r for r in merged.collect()}
    assert state[103]["aliases"] == ["a", "b"] and state[101]["merged_to"] == 103 and state[201]["merged_to"] is None and state[202]["aliases"] == ["X Atlas"]
    asked = spark.createDataFrame([("a",), ("c",), ("X Atlas",), ("nobody",)], "asked string")
    assert {(r["asked"], r["id"], r["redirected"]) for r in A.entity_lookup(asked, merged).collect()} >= {("a", 103, True), ("c", 103, False)}
    links = spark.createDataFrame([(101, 7), (102, 7), (103, 8), (300, 1)], "entity long, entry long")
    assert rows(A.repointed_links(links, classes)) == [(103, 7), (103, 8), (300, 1)]
    edges = spark.createDataFrame([(101, 300, "r", 0.2), (102, 300, "r", 0.7), (101, 102, "r", 0.9)], "id1 long, id2 long, relation string, weight double")
    moved = [r for r in rows(A.repointed_edges(edges, classes)) if r[2] == "r"]
    assert moved == [(103, 300, "r", 0.7)]


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(100)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    assert {r["node"]: r["label"] for r in A.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == {x: root(x) for x in up}


@pytest.mark.parametrize("most", [0, 3, 17, 1000])
def test_same_type_pairs_stop_at_the_cap(spark, most):
    members = [(i, f"t{i % 3}", i % 4) for i in range(20)]
    want = []
    for t in ("t0", "t1", "t2"):
        own = sorted((m for m in members if m[1] == t), key=lambda m: (-m[2], m[0]))
        want += [(min(a[0], b[0]), max(a[0], b[0]), t) for i, a in enumerate(own) for b in own[i + 1 :]]
    assert rows(A.same_type_edges(spark.createDataFrame(members, "entity long, type string, n long"), most)) == sorted(want[:most], key=str)


# concepts


def test_subtrees_are_ranges(spark):
    concepts = spark.createDataFrame([(1, "root", []), (2, "kid one", ["k1"]), (3, "kid two", None), (4, "leaf (old)", ["l", "lf"]), (7, "x", []), (8, "y", [])], "id long, label string, alt array<string>")
    broader = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (4, 3), (7, 8), (8, 7), (4, 99), (3, 3)], "id long, parent long")
    tree = C.hierarchy(concepts, broader)
    assert {(r["id"], r["depth"], r["pre"], r["last"], r["root"]) for r in tree.collect()} == {(1, 0, 1, 4, 1), (2, 1, 2, 3, 1), (4, 2, 3, 3, 1), (3, 1, 4, 4, 1), (7, 0, 5, 5, 7), (8, 0, 6, 6, 8)}
    assert rows(C.below(tree, spark.createDataFrame([(2,), (7,)], "id long"))) == [(2, 2), (2, 4), (7, 7)]
    links = broader.select(F.col("id").alias("src"), F.col("parent").alias("dst")).union(broader.select("parent", "id"))
    queries = spark.createDataFrame([(0, "tell of kid one now"), (1, "nothing"), (2, "x" * 600 + " KID TWO"), (3, None)], "qid long, text string")
    out = {r["qid"]: (r["text"], r["words"]) for r in C.expanded_queries(queries, concepts, links).collect()}
    assert out[0] == ("tell of kid one now k1 root lf", ["k1", "root", "lf"]) and out[1] == ("nothing", []) and out[3] == (None, [])
    assert len(out[2][0]) == 500 and out[2][1][:2] == ["kid two", "root"]
    hops = {(r["qid"], r["hop"]): r["text"] for r in C.hop_queries(queries.limit(1), concepts, links, 2).collect()}
    assert hops[0, 0] == "tell of kid one now" and hops[0, 1] == "root lf" and hops[0, 2].split() == ["kid", "two"]


# snapshots


def test_snapshots_share_what_has_not_changed(spark, tmp_path):
    now = [(i, f"text {i}", None if i % 3 else "x") for i in range(400)]
    table = lambda r: spark.createDataFrame(r, "id long, text string, mark string")
    snaps = Snapshots(spark, f"file://{tmp_path}/snaps", buckets=16)
    first = snaps.create(table(now), "first", "2026-09-01")
    later = [r if r[0] != 5 else (5, "changed", None) for r in now if r[0] != 9] + [(1000, "new", None)]
    second = snaps.create(table(later), "second", "2026-09-02")
    listed = {r["note"]: r for r in snaps.list().collect()}
    assert listed["first"]["written"] == 16 and listed["second"]["written"] <= 3 and listed["second"]["rows"] == 400
    assert rows(snaps.read(first)) == rows(table(now)) and rows(snaps.read(second)) == rows(table(later))
    assert rows(snaps.restore(first, table(later))) == rows(table(now))
    assert rows(snaps.restore(first, table(later), exact=False)) == sorted([*now, (1000, "new", None)], key=str)
    assert {(r["id"], r["op"]) for r in snaps.changes(first, table(later)).collect()} == {(5, "update"), (9, "insert"), (1000, "delete")}
    back = snaps.restore(first, table(later))
    opened = [f for f in back.inputFiles() if "_bucket=" in f]
    assert opened  # all folders are listed, but the scan is told which buckets to open
    plan = back._jdf.queryExecution().executedPlan().toString()
    odd = sorted(snaps.differing(first, table(later)))
    assert len(odd) <= 3 and "PartitionFilters: [_bucket" in plan
    assert snaps.restore(second, table(later)).inputFiles() == [] and not snaps.differing(second, table(later))
    assert snaps.create(table(later[::-1]), "again", "2026-09-03") and snaps.list().first()["written"] == 0
    assert snaps.keep(1) and rows(snaps.read(snaps.list().first()["name"])) == rows(table(later))


# stream


def test_cards_open_once_close_when_quiet_and_replays_change_nothing(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    folder, n = tmp_path / "in", Counter()

    def arrive(*misses):
        n["f"] += 1
        spark.createDataFrame([(t, start + dt.timedelta(hours=h)) for t, h in misses], "title string, ts timestamp").coalesce(1).write.parquet(f"file://{folder}/{n['f']}")

    def run():
        stream = spark.readStream.schema("title string, ts timestamp").parquet(f"file://{folder}/*").withWatermark("ts", "1 hour")
        return run_cards(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ck", 3, dt.timedelta(days=2))

    arrive(*[("a", h) for h in range(5)], ("b", 1))
    assert [(r["title"], r["event"]) for r in run().collect()] == [("a", "open")]
    arrive(("a", 6), ("b", 7))
    assert [(r["title"], r["event"]) for r in run().collect()] == [("a", "open")]  # still open: no second card
    assert [r["title"] for r in open_cards(run()).collect()] == ["a"]
    arrive(("c", 24 * 9))
    events = run()
    assert {(r["title"], r["event"]) for r in events.collect()} == {("a", "open"), ("a", "closed")} and open_cards(events).count() == 0
    arrive(*[("a", 24 * 9 + h) for h in range(3)])
    assert [(r["title"], r["event"]) for r in run().orderBy("at").collect()] == [("a", "open"), ("a", "closed"), ("a", "open")]
    sink, batch = write_once(f"file://{tmp_path}/replay"), events
    for number in (0, 1, 1, 0):  # a micro-batch that is run again writes its own folder anew
        sink(batch.where("event = 'open'") if number == 0 else batch.where("event = 'closed'"), number)
    assert written(spark, f"file://{tmp_path}/replay", CARDS).count() == 2
