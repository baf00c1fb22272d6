"""Embedders that fail, the fall-back, activity, routed and reranked searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestore.config import Search
from lodestore.operators import embedding as E
from lodestore.operators import retrieval as R
from lodestore.plans.common import access_log, entry_vectors, store

SMALL = "/root/testdata/sf0.001"


def test_a_failing_embedder_is_tried_and_then_replaced(spark):
    texts = spark.createDataFrame([(f"e{i}", f"text {i}" if i else None) for i in range(10)], "id string, text string").coalesce(1)

    def broken(batch):
        raise TimeoutError

    def odd(batch):
        return [[0.5] * 8 if t.endswith("1") else [float("nan")] * 8 if t.endswith("2") else [0.1] * 7 if t.endswith("3") else np.ones(8) for t in batch]

    def short(batch):
        return [[1.0] * 8]

    local = lambda batch: E.hashed(batch, 8)
    rows = {r["id"]: r for r in E.embedded(texts, broken, local, dims=8, pause=0).collect()}
    assert {r["source"] for r in rows.values()} == {"fallback"} and {r["tries"] for r in rows.values()} == {3} and all(len(r["vec"]) == 8 for r in rows.values())
    assert rows["e0"]["vec"] == [0.0] * 8 and abs(np.linalg.norm(rows["e1"]["vec"]) - 1) < 1e-6
    rows = {r["id"]: r["source"] for r in E.embedded(texts, odd, local, dims=8, pause=0).collect()}
    assert rows["e1"] == "embedder" and rows["e2"] == rows["e3"] == "fallback" and rows["e4"] == "embedder"
    rows = {r["id"]: r["vec"] for r in E.embedded(texts, short, None, dims=8, pause=0).collect()}
    assert len(rows) == 10 and set(map(str, rows.values())) == {"None"}  # a wrong number of vectors fits no text


def test_missing_vectors_and_activity(spark):
    s = store(spark, SMALL)
    have = s.where("doc_id % 3 = 0").select("id", F.array(F.lit(1.0)).alias("vec"))
    gone = E.missing(s, have)
    assert gone.count() == s.where("doc_id % 3 <> 0").count() and gone.agg(F.max(F.length("text"))).first()[0] <= 1000
    after, log = E.touched(s, spark.createDataFrame([("m00000003",), ("m00000003",), ("nobody",)], "id string"), "2026-09-01T00:00:00Z", "recall")
    assert [tuple(r) for r in log.collect()] == [("2026-09-01T00:00:00Z", "m00000003", "recall")]
    assert after.where("updated_at = '2026-09-01T00:00:00Z'").count() == 1 and after.count() == s.count()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(0, "zzqq_x-1234 nowhere.py"), (1, "the and of"), (2, "and")], "qid long, text string")


def test_a_routed_query_without_good_hits_is_asked_in_full(spark, asked):
    s, access = store(spark, SMALL), access_log(spark, SMALL)
    vectors = entry_vectors(spark, SMALL)
    own = asked.join(vectors.orderBy("id").limit(1).select(F.col("vec").alias("qvec"))).select("qid", "qvec")
    modes = {(r["qid"], r["mode"]) for r in R.search(asked, s, access, own, vectors, Search(router=True)).collect()}
    assert (0, "embed_only") in modes and not any(q == 0 and m == "time_desc" for q, m in modes)
    low = {(r["qid"], r["mode"]) for r in R.search(asked, s, access, own, vectors, Search(router=True, soft_line=0.0)).collect()}
    assert {m for q, m in low if q == 1} == {m for q, m in modes if q == 1}


def test_a_second_ranking_by_shared_words(spark, asked):
    s, access = store(spark, SMALL), access_log(spark, SMALL)
    first = R.search(asked, s, access, None, None, Search(top_k=20))
    again = R.search(asked, s, access, None, None, Search(top_k=5, rerank=True, rerank_pool=20)).collect()
    assert {r["mode"] for r in again if r["qid"] == 1} == {"fts_only_rerank"} and {r["mode"] for r in again if r["qid"] == 0} == {"time_desc"}
    words = lambda t: set("".join(c if c.isalnum() else " " for c in t.lower()).split())
    whole = {r["id"]: r["summary"] for r in s.select("id", "summary").collect()}
    pool = [(r["id"], r["rank"]) for r in first.where("qid = 1").collect()]
    shared = lambda i: round(len(words(whole[i]) & {"the", "and", "of"}) / max(len(words(whole[i])), 3), 6)
    want = [i for i, _ in sorted(pool, key=lambda x: (-shared(x[0]), x[1], x[0]))[:5]]
    assert [r["id"] for r in sorted((r for r in again if r["qid"] == 1), key=lambda r: r["rank"])] == want


def test_entries_with_vectors_go_by_whole_numbers(spark, tmp_path):
    """Numbers of more than eight digits: the last digit of an id is not that of its vector."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    import __spark_entry__ as entry

    docs = [{"doc_id": i, "text": f"entry number {i}", "lang": "en", "source": "s"} for i in (1, 2, 123456780, 987654321)]
    pq.write_table(pa.Table.from_pylist(docs), tmp_path / "documents.parquet")
    pq.write_table(pa.Table.from_pylist([{"vec_id": i, "embedding": [1.0, 0.0], "label": 0} for i in (2, 123456781, 987654321, 987654330)]), tmp_path / "embeddings.parquet")
    with duckdb.connect() as duck:
        for name in ("documents", "embeddings"):
            duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
        want = sorted(duck.execute(entry.oracle_sql()["k7_z18_backfilled"]).fetchall())
    got = sorted(map(tuple, entry.queries()["k7_z18_backfilled"](spark, str(tmp_path)).select("id", "source", "dims", "unit").collect()))
    assert got == want and {w[0] for w in want} == {"m00000001", "m12345678", "m98765432"}


def test_every_vector_of_the_backfill_has_unit_length(spark, tmp_path):
    """Two words whose signed counts cancel each other out, texts without words and without anything: before, their vectors were zeros."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    import __spark_entry__ as entry

    assert not np.any(E.hashed([""])[0]) and all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in E.hashed(["Of fa.", "que f", "!?", " "]))
    texts = ["Of fa.", "Of fa", "que f", "!?", "!?!", "", None, "This.", "of fa and more"]
    pq.write_table(pa.Table.from_pylist([{"doc_id": i, "text": t, "lang": "en", "source": "s"} for i, t in enumerate(texts)]), tmp_path / "documents.parquet")
    pq.write_table(pa.Table.from_pylist([{"vec_id": 100, "embedding": [1.0, 0.0], "label": 0}]), tmp_path / "embeddings.parquet")
    with duckdb.connect() as duck:
        for name in ("documents", "embeddings"):
            duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
        want = sorted(duck.execute(entry.oracle_sql()["k7_z18_backfilled"]).fetchall())
    got = sorted(map(tuple, entry.queries()["k7_z18_backfilled"](spark, str(tmp_path)).select("id", "source", "dims", "unit").collect()))
    assert got == want and len(want) == len(texts)
