"""The ten operators against brute force, and on odd and empty tables."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestore.llm import components as CC
from lodestore.llm import decontamination as D
from lodestore.llm import licenses as LI
from lodestore.llm import line_dedup as LD
from lodestore.llm import mixing as MX
from lodestore.llm import near_dedup as ND
from lodestore.llm import quality as Q
from lodestore.llm import sharding as SH
from lodestore.llm import simhash as SM
from lodestore.llm import token_counts as TC
from lodestore.llm import toxicity as TX
from lodestore.llm.shingles import shingle_hashes

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# 1: token counts


def test_tree_equals_full_encoding():
    counter = TC.Counter(TC.load_ranks())
    texts = ["", "a", "  it's  42 things,\n\n and more " * 40, "x" * 3000, "éà 文字 \t\t end  "]
    rng = np.random.default_rng(3)
    for text in texts:
        tree, now = TC.TokenTree(text, counter), text
        for _ in range(25):
            a = int(rng.integers(0, len(now) + 1))
            b = min(len(now), a + int(rng.choice([0, 1, 5, 300])))
            put = str(rng.choice(["", " ", "'s", "new words here", "\n\n", "9", "z" * 900]))
            tree.edit(a, b, put)
            now = now[:a] + put + now[b:]
            assert tree.text == now and tree.total == len(counter.encoding.encode_ordinary(now))


def test_edit_touches_little():
    counter = TC.Counter(TC.load_ranks())
    tree = TC.TokenTree("some words stand here. " * 5000, counter)
    tree.edit(40_000, 40_005, "other")
    assert tree.reencoded < 40


def test_token_counts_of_odd_rows(spark, odd_docs, no_docs, odd_rows):
    out = TC.token_counts(TC.routine_edits(odd_docs)).collect()
    assert len(out) == len(odd_rows)
    encoding = TC.Counter(TC.load_ranks()).encoding
    want = sorted(len(encoding.encode_ordinary(r[1] or "")) for r in odd_rows)
    assert sorted(r["n_tokens"] for r in out) == want
    assert TC.token_counts(TC.routine_edits(no_docs)).count() == 0
    edits = spark.createDataFrame([(73, 1, -5, None, "zero "), (73, 2, 999, 1000, " end"), (12345, 1, 0, 0, "x")], "doc_id long, seq int, start long, stop long, insert string")
    row = TC.token_counts(TC.with_edits(odd_docs, edits)).where("doc_id = 73").first()
    assert row["n_edits"] == 2 and row["n_tokens_edited"] == len(encoding.encode_ordinary("zero one end"))


def test_kept_trees_take_one_batch_after_another(spark, odd_docs, odd_rows):
    encoding = TC.Counter(TC.load_ranks()).encoding
    long = [(1000 + i, "some words stand here, and 42 more. " * 900) for i in range(3)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(long, "doc_id long, text string"))
    texts = [[r[0], r[1] or ""] for r in [*odd_rows, *long]]
    state = TC.saved(TC.kept_trees(docs), "test-trees")
    batches = [[(1000, 1, 9000, 9005, "others"), (1001, 1, 0, 0, "first "), (40, 2, 3, 5, "xyz")], [(1000, 1, 9002, 9002, "'s"), (1000, 2, 40, 7000, None), (40, 1, 0, 999999, None)]]
    for edits in batches:
        for doc_id, _, start, stop, insert in sorted(edits, key=lambda e: e[1]):
            for row in texts:
                if row[0] == doc_id:
                    row[1] = row[1][:start] + (insert or "") + row[1][max(start, stop) :]
        table = spark.createDataFrame(edits, "doc_id long, seq int, start long, stop long, insert string")
        state = TC.saved(TC.edited(TC.with_edits(state, table)), "test-trees")
        rows = state.select("doc_id", "text", TC.total("tokens").alias("n"), "n_edits", "n_reencoded").collect()
        assert Counter((r["doc_id"], r["text"] or "", r["n"]) for r in rows) == Counter((i, t, len(encoding.encode_ordinary(t))) for i, t in texts)
        assert all(r["n_reencoded"] <= 60 * r["n_edits"] for r in rows)


# 2: sharding


def test_curve_is_a_walk():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    index = SH.hilbert_index(points, 3)
    assert sorted(index) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_shards(odd_docs, no_docs, odd_rows):
    rows = SH.hilbert_shards(odd_docs, 7).collect()
    assert len(rows) == len(odd_rows)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and set(by) == set(range(7))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert [r["curve"] for r in sorted(own, key=lambda r: r["slot"])] == sorted(r["curve"] for r in own)
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert SH.hilbert_shards(no_docs, 7).count() == 0


def test_written_shards(spark, small, tmp_path):
    SH.write_shards(small, str(tmp_path / "s"), 5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == small.count() and back.select("shard").distinct().count() == 5


def test_written_shards_of_odd_rows(spark, odd_docs, no_docs, odd_rows, tmp_path):
    folder = SH.write_shards(odd_docs, str(tmp_path / "s"), 5)
    assert folder == "_shard"  # odd_docs has a column shard of its own
    files = [str(p) for p in (tmp_path / "s").glob("_shard=*/*.parquet")]
    back = spark.read.parquet(*files)  # folders that begin with an underscore are read by name
    assert Counter(map(tuple, back.select(*odd_docs.columns).collect())) == Counter(odd_rows)
    sizes = [spark.read.parquet(str(p)).count() for p in (tmp_path / "s").glob("_shard=*")]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    SH.write_shards(no_docs, str(tmp_path / "none"), 5)
    assert not list((tmp_path / "none").glob("_shard=*"))


def test_bins_hold_about_equal_counts(spark):
    counts = [("a", 10), ("b", 10), ("c", 10), ("d", 10)]
    bins = {r["v"]: r["bin"] for r in SH.value_bins(spark.createDataFrame(counts, "v string, _n long"), "v", "bin").collect()}
    assert bins == {"a": 4, "b": 12, "c": 20, "d": 28}
    many = [(f"v{i:04}", 1 + i % 3) for i in range(2000)] + [(None, 5)]
    rows = SH.value_bins(spark.createDataFrame(many, "v string, _n long"), "v", "bin").collect()
    held = Counter()
    for r in rows:
        held[r["bin"]] += dict(many)[r["v"]]
    assert set(held) == set(range(32)) and max(held.values()) - min(held.values()) <= 6
    order = [r["bin"] for r in sorted(rows, key=lambda r: (r["v"] is not None, r["v"] or ""))]
    assert order == sorted(order)


# 3: licenses


def brute_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    hits = [(i, label) for phrase, label in LI.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({label for _, label in hits}))


def test_base_places(odd_docs, no_docs, odd_rows):
    got = Counter((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in LI.license_scan(odd_docs).collect())
    assert got == Counter(brute_places(r[1]) for r in odd_rows)
    assert LI.license_scan(no_docs).count() == 0


def test_fuzzy_notices():
    n, base, *_, labels, score, spans = LI.scan_text("x GNU Genral Public-Licence y. Licensed under the Apche License, Version 2.0")
    assert base == 0 and set(labels.split(",")) >= {"gpl", "apache-2"} and 0.8 < score < 1 and n == 14
    assert ("gpl", 1, 5, 2) in [(s[0], s[1], s[2], s[3]) for s in spans]
    assert LI.scan_text("apache license version 3 0")[5] == "apache"  # digits tell versions apart
    assert LI.scan_text("quiet words about clouds")[5:7] == ("", 0.0)


def test_seeds_find_every_place_in_budget():
    rng = np.random.default_rng(1)
    for phrase, label in (LI.BASE | LI.NOTICES).items():
        for _ in range(20):
            x = list(phrase)
            for _ in range(int(rng.integers(0, LI.edit_budget(phrase) + 1))):
                at = int(rng.integers(1, len(x) - 1))
                if not x[at].isdigit() and x[at] != " ":
                    x[at] = "q"
            assert label in {s[0] for s in LI.fuzzy_spans("aa " + "".join(x) + " bb")}, "".join(x)


def test_fuzzy_notices_equal_brute_force():
    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j - 1] + (x != y), last[j] + 1, now[-1] + 1))
            last = now
        return last[-1]

    r = random.Random(3)
    assert LI.scan_text("qmit license")[5] == "mit"
    for phrase, label in (LI.BASE | LI.NOTICES).items():
        k, digits = LI.edit_budget(phrase), re.sub(r"\D", "", phrase)
        for _ in range(40):
            x = list(phrase)
            for _ in range(r.randrange(k + 2)):
                at = r.randrange(len(x))
                x[at : at + r.randrange(2)] = r.choice(["", "q", "s", " "])
            words = f"{r.choice(['', 'aa', 'zz mit'])} {''.join(x)} {r.choice(['', 'bb', 'y z'])}".split()
            text = " ".join(words)
            spans = [" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)]
            near = any(abs(len(c) - len(phrase)) <= k and re.sub(r"\D", "", c) == digits and distance(c, phrase) <= k for c in spans)
            found = [s for s in LI.fuzzy_spans(text) if s[0] == label]
            assert not near or found, (phrase, text)
            for _, a, b, edits, _ in found:
                assert any(distance(text[a:b], p) == edits for p, own in (LI.BASE | LI.NOTICES).items() if own == label)


# 4: line dedup


def brute_lines(rows, least):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)

    df = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} if k)
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if df[key(x)] < least or not key(x)]
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 4), (5, 2)])
def test_line_dedup(odd_docs, no_docs, odd_rows, batches, fanout):
    out = LD.drop_frequent_lines(odd_docs, 10, batches, fanout).withColumn("kept_sha256", F.sha2("kept_text", 256))
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in out.collect())
    assert got == brute_lines(odd_rows, 10)
    assert LD.drop_frequent_lines(no_docs).count() == 0


def test_repeated_rows_count_each(spark):
    rows = [(1, "often\nonce")] * 10 + [(None, "nameless")] * 6 + [(2, "nameless\nhere")] * 4 + [(3, "nine\nNINE")] * 9 + [(4, "own")]
    out = LD.drop_frequent_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 10)
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect())
    assert got == {(1, 2, 2, ""): 10, (None, 1, 1, ""): 6, (2, 2, 1, "here"): 4, (3, 2, 0, "nine\nNINE"): 9, (4, 1, 0, "own"): 1}


def test_runs_are_levelled(spark):
    runs = LD.LineRuns(spark, min_docs=3, fanout=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(i, 0, 1, 1), (i, 0, 2, i)], "_d long, _t long, _a long, _b long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert [tuple(r) for r in runs.frequent().collect()] == [(1, 1)]
    assert runs.unseen(spark.createDataFrame([(2, 3), (9, 9)], "_a long, _b long")).count() == 1


def test_runs_are_opened_again_and_never_shuffled(spark, tmp_path):
    root = f"file://{tmp_path}/runs"

    def batch(i):
        return spark.range(300).select((F.col("id") + i * 1000).alias("_d"), F.lit(0).alias("_t"), (F.col("id") % (100 + i)).alias("_a"), (F.col("id") % (100 + i) * 7).alias("_b"))

    first = LD.LineRuns(spark, min_docs=8, fanout=3, root=root)
    first.add(batch(0))
    first.add(batch(1))
    first.close()
    again = LD.LineRuns.open(spark, root)
    assert again.names() == first.names() and again.version == 2 and again.min_docs == 8
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        own = batch(2).groupBy("_a", "_b").agg(F.count("*").alias("_n"))
        plan = again.merged(own)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 2 and "Bucketed: true" in plan
    again.add(batch(2))
    want = Counter(x % (100 + i) for i in range(3) for x in range(300))
    assert {r["_a"] for r in again.frequent().collect()} == {a for a, n in want.items() if n >= 8}
    assert [len(level) for level in LD.LineRuns.open(spark, root).levels] == [0, 1]
    again.close(delete_files=True)
    assert not (tmp_path / "runs").exists()


# 5: decontamination


def test_alignment_equals_brute_force():
    def brute(a, b):
        last = [0] * (len(b) + 1)
        for i in range(1, len(a) + 1):
            now = [i]
            for j in range(1, len(b) + 1):
                now.append(min(last[j - 1] + (a[i - 1] != b[j - 1]), last[j] + 1, now[-1] + 1))
            last = now
        return min(last)

    rng = np.random.default_rng(2)
    for _ in range(200):
        a = bytes(rng.choice(list(b"abc "), int(rng.integers(15, 40))).astype(np.uint8))
        x = bytearray(a)
        for _ in range(int(rng.integers(0, 6))):
            at = int(rng.integers(0, len(x)))
            x[at : at + int(rng.integers(0, 2))] = b"x" * int(rng.integers(0, 2))
        text = b"yz" * int(rng.integers(0, 3)) + bytes(x) + b"zy" * int(rng.integers(0, 3))
        found, want = D.banded_alignment(a, text, 5), brute(a, text)
        assert (found is None and want > 5) or (found[0] == want and brute(a, text[found[1] : found[2]]) == want)


def test_planted_items_are_found(spark, small, odd_docs, no_docs):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = {r["item_id"]: D.plain_bytes(r["text"]) for r in bench.collect()}
    rng = np.random.default_rng(4)
    rows = []
    for n, (i, text) in enumerate(items.items()):
        x = bytearray(text)
        for _ in range(D.budget(len(text)) * (n % 2)):
            at = int(rng.integers(0, len(x)))
            x[at] = ord("z") if x[at] < 128 else x[at]
        rows.append((i, ("Leading words. " * 30) + bytes(x).decode("utf-8", "ignore") + " trailing words" * 30))
    rows.append((10_000, "clean words only " * 50))
    long = {i: t for i, t in items.items() if len(t) >= 200}
    for i, t in long.items():
        cut = t[len(t) // 5 : len(t) // 5 + 155].decode("utf-8", "ignore")
        rows.append((20_000 + i, "Other words before. " * 9 + cut + " and after" * 9))
    found = {(r["doc_id"], r["item_id"]) for r in D.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert long and found >= {(i, i) for i in items} | {(20_000 + i, i) for i in long} and not any(d == 10_000 for d, _ in found)
    exact = {(r["doc_id"], i) for r in small.collect() for i, t in items.items() if t in D.plain_bytes(r["text"])}
    assert exact <= {(r["doc_id"], r["item_id"]) for r in D.contaminated(small, bench).collect()}
    assert D.contaminated(odd_docs, bench.unionByName(spark.createDataFrame([(None, "x"), (900, None), (901, "short")], "item_id long, text string"))).count() == 0
    assert D.contaminated(no_docs, bench).count() == 0 and D.contaminated(odd_docs, bench.limit(0)).count() == 0
    assert D.clean_documents(odd_docs, bench).count() == odd_docs.count()


def test_passages_are_found_at_any_offset():
    rng = np.random.default_rng(6)
    for m in (60, 67, 80, 100, 149, 150, 333):
        item = bytes(rng.choice(list(b"abcdefghijklmnop "), m).astype(np.uint8))
        index = D.Index([(7, item)])
        w = min(D.WINDOW, int(m * D.SHARE))
        for at in range(m - w + 1):
            text = b"other words 0123 " * 5 + item[at : at + w] + b" 4567 and after" * 5
            assert [x[0] for x in D.find_items(text, index)] == [0], (m, at)
        assert D.find_items(b"other words 0123 " * 30, index) == []


def test_items_equal_full_alignment():
    """Whole items with insertions, deletions and substitutions around their budget: found if and only if full alignment finds them."""

    def least(item, text):
        last = [0] * (len(text) + 1)
        for i, x in enumerate(item, 1):
            now = [i]
            for j, y in enumerate(text, 1):
                now.append(min(last[j - 1] + (x != y), last[j] + 1, now[-1] + 1))
            last = now
        return min(last)

    r = random.Random(1)
    other = D.plain_bytes("".join(r.choice("abcdefghij klmno") for _ in range(70)))
    seen = Counter()
    for _ in range(250):
        letters = r.choice(["ab", "abcdefghij klmno", "a b"])

        def some(n):
            return "".join(r.choice(letters) for _ in range(n))

        item = D.plain_bytes(some(r.choice([12, 20, 25, 37, 59, 60, 80, 130])))
        if len(item) < D.Q:
            continue
        x = list(item.decode())
        for _ in range(r.randrange(D.budget(len(item)) + 3)):
            at = r.randrange(len(x))
            x[at : at + r.randrange(2)] = r.choice(["", "a", "z"])
        text = D.plain_bytes(some(r.randrange(60)) + "".join(x) + some(r.randrange(60)))
        want = least(item, text)
        got = [f[3] for f in D.find_items(text, D.Index([(5, item), (6, other)])) if f[0] == 0 and f[4] == 1]
        assert got == ([want] if want <= D.budget(len(item)) else []), (item, text)
        seen[bool(got)] += 1
    assert min(seen.values()) > 20


def test_repetitive_texts_take_little():
    began = time.time()
    for item, text, whole in ((b"a" * 120, b"a" * 300_000, 1), (b"a" * 60 + b"b" * 60, b"a" * 200_000, None), (b"ab cd " * 300, b"ab cd " * 20_000, 1), (b"a" * 110 + b"b" * 10, b"a" * 100_000, 0)):
        assert [f[4] for f in D.find_items(text, D.Index([(1, item)]))] == ([] if whole is None else [whole])
    assert time.time() - began < 20


def test_long_texts_are_searched_in_pieces(monkeypatch):
    rng = np.random.default_rng(8)
    items = [(i, bytes(rng.choice(list(b"abcdefghij klmno"), int(rng.integers(60, 400))).astype(np.uint8))) for i in range(30)]
    text = b" filler words 123 ".join(items[int(i)][1][: int(rng.integers(50, 400))] for i in rng.integers(0, 30, 200))
    whole = D.find_items(text, D.Index(items))
    monkeypatch.setattr(D, "HITS", 50)
    monkeypatch.setattr(D, "SPAN", 600)
    assert whole and [(f[0], f[3], f[4]) for f in D.find_items(text, D.Index(items))] == [(f[0], f[3], f[4]) for f in whole]


def test_rows_without_an_id_are_judged_by_their_text(spark, monkeypatch):
    item = "which of these four rivers runs through the largest number of countries in the region"
    rows = [(None, f"before {item} after"), (None, "clean words"), (1, f"also {item}"), (1, "clean too"), (2, "tiny bit of it"), (3, "a tinybit"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(10, item), (None, item), (11, "tiny bit"), (12, None), (13, " \n ")], "item_id long, text string")
    want = {(i, j) for i, own in ((None, (10, None)), (1, (10, None)), (2, (11,))) for j in own}
    assert {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, bench).collect()} == want
    left = Counter((r["doc_id"], r["text"]) for r in D.clean_documents(docs, bench).collect())
    assert left == Counter([rows[1], rows[3], *rows[5:]])
    monkeypatch.setattr(D, "BLOCK_BYTES", 50)  # several passes
    again = D.clean_documents(docs, bench)
    assert Counter((r["doc_id"], r["text"]) for r in again.collect()) == left and again.columns == docs.columns


# 6 and 10: classifiers


def held_out_accuracy(rows, labels, name):
    y = {r["doc_id"]: r[name] for r in labels}
    pairs = [(r["predicted"], y[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in y]
    return np.mean([p == t for p, t in pairs])


@pytest.mark.parametrize(("score", "name", "fold"), [(Q.quality_scores, "quality", (5, 0)), (TX.toxicity_scores, "toxic", (3, 1))])
def test_classifiers(spark, odd_docs, no_docs, labels, odd_rows, score, name, fold):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs, known).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold[0] == fold[1]) for r in rows)
    assert held_out_accuracy(rows, known.collect(), name) > 0.93
    again = score(docs, known).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    # held-out labels teach nothing: with them turned about, no score moves
    turned = known.withColumn(name, F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold[0])) == fold[1], 1 - F.col(name)).otherwise(F.col(name)))
    assert sorted(map(repr, score(docs, turned).collect())) == sorted(map(repr, rows))
    assert score(odd_docs, labels).count() == len(odd_rows)
    assert score(no_docs, labels).count() == 0
    none = score(odd_docs, labels.limit(0)).collect()
    assert len({r["score"] for r in none}) == 1 and len(none) == len(odd_rows)


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = Q.AdditiveModel().fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_chain_marginals_equal_brute_force():
    chain = TX.Chain()
    chain.moves = np.array([[0.4, -0.3], [-0.2, 0.7]])
    e = np.array([0.5, -1.0, 2.0, 0.1])
    weight = {}
    for path in itertools.product((0, 1), repeat=4):
        weight[path] = np.exp(sum(e[i] for i in range(4) if path[i]) + sum(chain.moves[path[i], path[i + 1]] for i in range(3)))
    want = [sum(w for p, w in weight.items() if p[i]) / sum(weight.values()) for i in range(4)]
    assert np.allclose(chain.marginals(TX.sequences(e)).ravel()[:4], want)


def test_chains_are_whole():
    """Texts of many segments: marginals and expected transitions as one chain has them."""
    chain = TX.Chain()
    chain.moves = np.array([[0.4, -0.9], [-0.7, 1.1]])
    rng, t = np.random.default_rng(0), np.exp(chain.moves)
    texts = [rng.normal(size=n) * 2 for n in (1, 63, 64, 65, 128, 500, 10)]
    rows = [TX.sequences(x) for x in texts]
    p, moved = chain.marginals(np.concatenate(rows), True, TX.heads(rows))
    p, at, want = p.ravel(), 0, np.zeros((2, 2))
    for x in texts:
        em = np.stack([np.ones(len(x)), np.exp(x)], axis=1)
        f, b = [em[0]], [np.ones(2)]
        for i in range(1, len(x)):
            f.append(TX.unit((f[-1] @ t) * em[i]))
            b.insert(0, TX.unit(t @ (em[-i] * b[0])))
        assert np.allclose(TX.unit(np.array(f) * np.array(b))[:, 1], p[at : at + len(x)])
        at += -(-len(x) // TX.SEGMENT) * TX.SEGMENT
        for i in range(len(x) - 1):
            pair = f[i][:, None] * t * (em[i + 1] * b[i + 1])[None]
            want += pair / pair.sum()
    assert np.allclose(want, moved)


def test_repeated_rows_do_not_enlarge_the_sample(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    rows = Q.training_rows(docs, labels, "quality", F.lit(False), 2).collect()
    assert len(rows) == 2 and len({r["doc_id"] for r in rows}) == 2


def test_toxic_spans(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r["spans"] for r in TX.toxicity_scores(docs, known).where("predicted = 1").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = Counter(texts[i][s["start"] : s["end"]].lower() for i, own in rows.items() for s in own)
    assert {"idiot", "moron", "scum"} & set(found)


def test_fitting_reads_whole_texts(spark, monkeypatch):
    read = []

    def seen(texts, y):
        read.extend(t[-4:] for t in texts)
        raise InterruptedError

    monkeypatch.setattr(TX, "ToxicityModel", seen)
    docs = spark.createDataFrame([(i, "plain words " * 1000 + "tail") for i in range(12)], "doc_id long, text string")
    with pytest.raises(InterruptedError):
        TX.toxicity_scores(docs, spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int"))
    assert read and set(read) == {"tail"}


# 7: SimHash


def test_simhash(odd_docs, no_docs, odd_rows):
    rows = SM.edited_fingerprints(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    by_text = defaultdict(set)
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and len(r["fingerprint"]) == 16
        by_text[r["doc_id"]].add(r["fingerprint"])
    copies = {r["fingerprint"] for r in rows if r["doc_id"] is not None and 40 <= r["doc_id"] < 60}
    assert len(copies) == 1 and by_text[70] == by_text[71] == by_text[72] == {"0" * 16}
    texts = {r[0]: r[1] or "" for r in odd_rows}
    for i in range(20, 60):
        a, b = texts[i], texts[i + 1]
        cut = len(a) // 4
        assert next(r["edited_sha256"] for r in rows if r["doc_id"] == i) == hashlib.sha256((a[: len(a) - cut] + b[:cut]).encode()).hexdigest()
    assert SM.edited_fingerprints(no_docs).count() == 0
    one = SM.edited_fingerprints(odd_docs.where("doc_id = 74")).first()
    assert one["near_next"] == 1.0


def test_fingerprints_equal_brute_force(spark, odd_docs, odd_rows, small):
    def fingerprint(text):
        words = re.findall(WORD, text)
        terms = [(xxh(b, xxh(a, 42)), 1 if len(a) <= 3 and len(b) <= 3 else 2) for a, b in zip(words, words[1:])] or [(xxh(w, 42), 2) for w in words]
        return sum(1 << k for k in range(64) if sum(w if h >> k & 1 else -w for h, w in terms) > 0)

    def xxh(x, seed):
        return xxhash.xxh64_intdigest(x.encode("utf-8"), seed)

    def apart(a, b):
        return bin(a ^ b).count("1")

    one_row_an_id = {r[0]: r[1] or "" for r in odd_rows if r[0] is not None and r[0] not in (5, 6)}
    for docs, texts in ((odd_docs.where("doc_id is not null and doc_id not in (5, 6)"), one_row_an_id), (small, {r["doc_id"]: r["text"] or "" for r in small.collect()})):
        ids = sorted(texts)
        own = {i: fingerprint(texts[i]) for i in ids}
        rows = {r["doc_id"]: r for r in SM.edited_fingerprints(docs).collect()}
        assert set(rows) == set(ids)
        for i, after in zip(ids, [*ids[1:], ids[0]]):
            cut = len(texts[i]) // 4
            edited = fingerprint(texts[i][: len(texts[i]) - cut] + texts[after][:cut])
            want = (f"{own[i]:016x}", f"{edited:016x}", 1 - apart(own[i], edited) / 64, 1 - apart(own[i], own[after]) / 64)
            r = rows[i]
            assert (r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) == want, i
            assert r["n_near"] == (sum(apart(own[i], x) <= 3 for x in own.values()) if i % 50 == 0 else None)


def test_radius_search_is_complete(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(-(1 << 63), 1 << 63, 40)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(62, int(rng.integers(1, 6)), replace=False)) for x in base for _ in range(4)]
    words = sorted({*map(int, base), *near})
    df = spark.createDataFrame([(w,) for w in words], "fp long")
    got = {(r["q"], r["fp"]) for r in SM.within_radius(df.withColumnRenamed("fp", "q"), df).collect()}
    want = {(a, b) for a in words for b in words if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3}
    assert got == want


# 8: mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("which", ["odd", "small"])
def test_mix(odd_docs, small, odd_rows, which, no_docs):
    docs = odd_docs if which == "odd" else small
    rows = MX.mixed(docs).collect()
    plain = docs.select("doc_id", "text", "source").collect()
    assert len(rows) == len(plain)
    sizes = Counter()
    for r in plain:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    want = brute_targets(sizes)
    times = Counter(r["doc_id"] for r in plain)
    source = {r["doc_id"]: r["source"] for r in plain if times[r["doc_id"]] == 1}
    taken, biggest = Counter(), Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        if r["doc_id"] in source:
            assert abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6 * max(1, r["target"]) and r["source_size"] == sizes[source[r["doc_id"]]]
        s = next(k for k, v in want.items() if abs(v - r["target"]) < 1e-6 * max(1, v) and sizes[k] == r["source_size"])
        taken[s] += r["taken"]
        biggest[s] = max(biggest[s], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.03 * t, 60) or biggest[s] > t / 3, (s, t, taken[s])
    assert sorted(map(repr, MX.mixed(docs).collect())) == sorted(map(repr, rows))
    assert MX.mixed(no_docs).count() == 0


def test_mixture_takes_rows_for_themselves(spark, odd_docs, odd_rows, no_docs):
    out = MX.mixture(odd_docs)
    assert out.columns == odd_docs.columns and MX.mixture(no_docs).count() == 0
    times, have = Counter(map(tuple, out.collect())), Counter(odd_rows)
    assert all(n <= 3 * have[row] for row, n in times.items())
    sizes, taken = Counter(), Counter()
    for row in odd_rows:
        sizes[row[3]] += len(WORD.findall(row[1] or ""))
    for row, n in times.items():
        taken[row[3]] += n * len(WORD.findall(row[1] or ""))
    for s, t in brute_targets(sizes).items():
        biggest = max(len(WORD.findall(r[1] or "")) for r in odd_rows if r[3] == s)
        assert abs(taken[s] - t) <= max(0.03 * t, 60) or biggest > t / 3, (s, t, taken[s])
    rows = spark.createDataFrame([(1, "a b c d", "x")] * 30 + [(2, "e f", "y")] * 30, "doc_id long, text string, source string")
    assert Counter(r["source"] for r in MX.mixture(rows).collect()) == Counter(x=round(180 * 5 / 7 / 4), y=round(180 * 2 / 7 / 2))


# 9: near-dedup


def brute_groups(rows, words, threshold):
    def shingles(text):
        w = WORD.findall((text or "").translate(UPPER))
        return {tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}

    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and len(a & b) >= threshold * len(a | b):
            x, y = sorted((root(i), root(j)))
            up[y] = x
    return {(i, len(s)): root(i) for i, s in sets}


@pytest.mark.parametrize("words", [4, 5])
def test_near_groups(odd_docs, no_docs, odd_rows, words):
    rows = ND.near_groups(odd_docs, words).collect()
    assert len(rows) == len(odd_rows)
    want = brute_groups(odd_rows, words, 0.8)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[(r["doc_id"], r["n_shingles"])], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert ND.near_groups(no_docs).count() == 0


def test_one_of_each(spark, odd_docs, odd_rows, no_docs):
    kept = ND.one_of_each(odd_docs, 5, 0.8)
    assert kept.columns == odd_docs.columns and ND.one_of_each(no_docs).count() == 0
    rows = sorted(odd_rows, key=lambda r: (r[0] is None, r[0] or 0))
    groups = brute_groups([(n, r[1]) for n, r in enumerate(rows)], 5, 0.8)
    group = {n: g for (n, _), g in groups.items()}
    want = Counter(r[0] for n, r in enumerate(rows) if group[n] == n)
    assert Counter(r["doc_id"] for r in kept.collect()) == want
    same = spark.createDataFrame([(7, "one two three four five six")] * 3 + [(None, "one two three four five six")] * 2 + [(None, "")] * 2, "doc_id long, text string")
    assert sorted(map(repr, ND.one_of_each(same).collect())) == sorted(map(repr, [same.first(), *same.where("text = ''").collect()]))


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_no_link_is_lost_on_real_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = {r["doc_id"]: r["component_id"] for r in ND.near_groups(docs, 4).collect()}
    assert got == {i: c for (i, _), c in brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()], 4, 0.8).items()}


def test_near_groups_of_a_chain_of_copies(spark):
    """Copies with growing changes: neighbours link, far ones do not, hubs alone would not join them."""
    rng = np.random.default_rng(6)
    words = [f"w{rng.integers(10**6)}" for _ in range(300)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        for _ in range(6):
            words[int(rng.integers(0, 300))] = f"n{rng.integers(10**6)}"
    got = {r["doc_id"]: r["component_id"] for r in ND.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == {i: c for (i, _), c in brute_groups(rows, 4, 0.8).items()}


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(8)
    for share in (0.8, 0.9):
        err = []
        for _ in range(40):
            a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
            b = a.copy()
            k = int(400 * (1 - share) / (1 + share))
            b[:k] = rng.integers(0, 1 << 63, k).astype(np.uint64)
            x, y = (np.frombuffer(ND.odd_sketch(ND.minhash(s)), np.uint64) for s in (a, b))
            err.append(ND.sketch_similarity(np.bitwise_count(x ^ y).sum()) - share)
        assert abs(np.mean(err)) < 0.03 and np.abs(err).max() < ND.SLACK


def test_shingles():
    assert len(shingle_hashes("a b c d e", 4)) == 2 and len(shingle_hashes("a b", 4)) == 1 and len(shingle_hashes(None, 4)) == 0
    assert (shingle_hashes("A  b\tc\nD", 4) == shingle_hashes("a b c d", 4)).all()
    assert len(np.intersect1d(shingle_hashes("a b c", 4), shingle_hashes("a b c d", 4))) == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (40, 41), (60, 60), (41, 50)]
    got = {r["node"]: r["label"] for r in CC.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 41: 40, 50: 40}
    assert CC.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_the_session_keeps_its_batch_size(spark, odd_docs):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    assert int(before) > 512
    LI.license_scan(odd_docs).count()
    ND.near_groups(odd_docs).count()
    assert spark.conf.get(setting) == before


@pytest.mark.parametrize("notice", ["mit license ", "gnu general public license ", "cc by nc 4 0 ", "apache license, version 2.0\n", "license "])
def test_a_long_text_of_notices_is_scanned_in_one_pass(notice):
    n = 1_000_000 // len(notice)
    began = time.time()
    row = LI.scan_text(notice * n)
    assert time.time() - began < 10
    words = len(WORD.findall(notice.replace(",", "").replace(".", " ")))
    assert row[0] == n * words and row[1] == (0 if notice == "license " else n)
    assert row[1] == 0 or (row[2], row[3]) == (0, (n - 1) * words)


def test_levels_are_merged_without_exchange(spark):
    runs = LD.LineRuns(spark, 3, fanout=2)
    rows = [(d, 0, line, line) for d in range(40) for line in range(d % 7)]
    for batch in range(4):
        own = spark.createDataFrame([r for r in rows if r[0] % 4 == batch], "_d long, _t long, _a long, _b long")
        runs.add(own)
    names = runs.names()
    assert len(names) == 1 and {(r["_a"], r["_n"] >= 3) for r in runs.rows(names).collect()} == {(line, True) for line in range(6)}
    a = runs._write(spark.createDataFrame([(1, 1, 1), (2, 2, 2)], "_a long, _b long, _n long"))
    b = runs._write(spark.createDataFrame([(2, 2, 5), (3, 3, 1)], "_a long, _b long, _n long"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = runs._united([a, b])
        assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, merged.collect())) == [(1, 1, 1), (2, 2, 5), (3, 3, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        runs.close(delete_files=True)


def test_blocks_of_long_texts_hold_fewer_rows(spark):
    active = spark.createDataFrame([(1, i, ND.BLOCK_SHINGLES // 2) for i in range(8)] + [(2, 100 + i, 10) for i in range(8)], "key long, doc_id long, n long")
    dealt = ND._blocks(active).groupBy("key").agg(F.count_distinct("x", "y").alias("pairs")).collect()
    pairs = {r["key"]: r["pairs"] for r in dealt}
    assert pairs[2] == 1 and pairs[1] > 1
