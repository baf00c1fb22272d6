"""The corpus pipeline against a brute-force account of each stage."""

from collections import Counter

import corpus_pipeline as P
from lodestore.llm.decontamination import plain_bytes


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = P.documents(spark, sf)
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [plain_bytes(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in P.STAGES:
        before = docs.collect()
        docs = P.saved(stage(spark, docs, sf), f"test-{name}")
        after = docs.collect()
        if name != "sharding":
            assert docs.columns == columns
        ids, old = Counter(r["doc_id"] for r in after), Counter(r["doc_id"] for r in before)
        if name == "quality_classifier":
            bad = [i for i in old if labels.get(i) == 0]
            good = [i for i in old if labels.get(i) == 1]
            assert sum(i in ids for i in good) > 0.98 * len(good) and sum(i in ids for i in bad) < 0.1 * len(bad)
        elif name == "minhash_near_dedup":
            texts = [r["text"] for r in after]
            assert len(set(texts)) == len(texts) and set(ids) < set(old)
        elif name == "benchmark_decontamination":
            leaking = [r["doc_id"] for r in before if any(t in plain_bytes(r["text"]) for t in items)]
            assert leaking and not set(leaking) & set(ids) and len(old) - len(ids) <= 2 * len(leaking)
        elif name == "mixing":
            assert max(ids.values()) <= 3 and set(ids) <= set(old)
        else:
            sizes = Counter(r["shard"] for r in after)
            assert len(after) == len(before) and max(sizes.values()) - min(sizes.values()) <= 1


def test_run_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_tables(spark, odd_docs, odd_rows, tmp_path):
    """Nulls, repeated rows, shared ids, clashing columns: every stage keeps the columns and takes only rows it was given."""
    item = "which of these four rivers runs through the largest number of countries in the region"
    spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (None, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd_docs.unionByName(spark.createDataFrame([(i, f"x {item} y {i}", *odd_rows[0][2:]) for i in (None, 300, 5)], odd_docs.schema))
    for name, stage in P.STAGES:
        given = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, str(tmp_path))
        if name == "sharding":
            assert out.count() == len(given)
            break
        rows = [tuple(r) for r in out.collect()]
        assert out.columns == docs.columns and set(rows) <= set(given)
        if name == "minhash_near_dedup":
            texts = [r[1] for r in rows if (r[1] or "").split()]
            assert len(texts) == len(set(texts))
        if name == "benchmark_decontamination":
            assert Counter(rows) == Counter(r for r in given if item not in (r[1] or ""))
        docs = P.saved(out, "test-odd")
