"""The queries that SQL can't express, over whole small tables, against brute force."""

import itertools
import random
import re
from difflib import SequenceMatcher

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from lodestore import config as C
from lodestore.functions.extract import KEY_DATA
from lodestore.plans.common import BENCH_QUERIES, STORE
from lodestore.plans.common import store as derived
from lodestore.plans.retrieval import INDEX

SMALL = "/root/testdata/sf0.001"
SHARED = "Alpha beta gamma delta policy: every node of the cluster keeps three copies of each block it is told "


def planted():
    """Documents beside the small table's: copies, notes that share an opening, denials, stock phrases, odd rows."""
    r = random.Random(4)
    noise = [" ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(60)) for _ in range(4)]
    opening = SHARED.ljust(100, "x")[:100]
    copy = "系统每周六上午十点自动执行数据库备份任务并检查结果完整性，随后通知值班人员核对存储容量与日志"
    return [
        (1001, opening + noise[0]),
        (1002, opening + " 纠正 wholly unlike matters " + noise[1]),
        (1003, opening + noise[2]),
        (1020, opening + noise[3]),  # deprecated in the derived store
        (1005, copy),
        (1006, copy + "。"),
        (1007, copy.replace("自动", "不自动")),
        (1008, copy.replace("六", "日")),
        (1009, "ok"),
        (1011, "一条足够长的摘要，说明2026年8月26日的容量从37%升到85%，费用1200元"),
        (1012, "另一条摘要，说明2026年8月26日的容量从37%升到52%，费用900元"),
        (1013, ""),
        (1014, None),
        (1015, "   \n "),
        (1016, "ＦＵＬＬ ｗｉｄｔｈ letters of a policy"),
        (1018, "full width letters of a policy!"),
        (1031, "rule: must always enable the cache of the gateway, at 30 seconds"),
        (1033, "rule: must never enable the cache of the gateway, at 45 seconds"),
    ]


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Folder of a few documents and benchmark items, planted ones among them."""
    folder = tmp_path_factory.mktemp("small")
    docs = pq.read_table(f"{SMALL}/documents.parquet").slice(0, 60).select(["doc_id", "text", "lang", "source"]).to_pylist()
    docs += [{"doc_id": i, "text": t, "lang": "en", "source": "s"} for i, t in planted()]
    items = pq.read_table(f"{SMALL}/benchmark.parquet").slice(0, 12).to_pylist()
    items += [{"item_id": 12, "text": SHARED}, {"item_id": 13, "text": "数据库备份任务 policy"}, {"item_id": 14, "text": ""}, {"item_id": 15, "text": "none such"}]
    pq.write_table(pa.Table.from_pylist(docs), folder / "documents.parquet")
    pq.write_table(pa.Table.from_pylist(items), folder / "benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def notes(spark, small):
    return [r.asDict() for r in derived(spark, small).orderBy("id").collect()]


def rows(spark, small, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in entry.queries()[name](spark, small).collect()), key=repr)


def half_width(text):
    return "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) < 0xFF5F else " " if c == "　" else c for c in text or "")


def normal(text):
    return re.sub(r"\W+", "", half_width(text).lower())


def grams(text, n):
    return {text[i : i + n] for i in range(len(text) - n + 1)} if len(text) >= n else set(text)


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 0.0


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def repeats(a, b):
    """Dice of two texts' pairs if it is 0.9 or more and no differing pair holds a negation."""
    x, y = grams(normal(a), 2), grams(normal(b), 2)
    dice = round(2 * len(x & y) / (len(x) + len(y)), 9) if x and y else 0.0
    marks = [*C.DEDUP_NEGATION_CHARS, *C.DEDUP_NEGATION_TOKENS, "not", "never", "without"]
    return dice if dice >= 0.9 and not any(m in g for g in x ^ y for m in marks) else None


def test_every_query_is_tested():
    ours = {n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith(("op", "pipeline"))}
    assert ours == {"x10_x14_ratio", "f8_ingest_filter", "p6_x19_duplicates", "p6_guard", "p7_x17_conflicts", "r13_contradictions", "x7_x9_r21_verify", "r3_k6_approximate", "p11_p24_distill_run", "p3_p6_whole_curation"}


def test_ratio(spark, small):
    items = {r["item_id"]: r["text"] for r in pq.read_table(f"{small}/benchmark.parquet").to_pylist()}
    want = {(i, i + 1): (ratio(a, b), max(ratio(a, b), jaccard(grams(a, 3), grams(b, 3)))) for i, a in items.items() if (b := items.get(i + 1)) is not None}
    got = {r[:2]: r[2:] for r in rows(spark, small, "x10_x14_ratio", "i", "j", "ratio", "similarity")}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_ingest_filter(spark, small, notes):
    cut = {n["id"]: (n["summary"] or "").strip(" ") for n in notes}
    want = []
    for n in (n for n in notes if n["doc_id"] % 2):
        s = cut[n["id"]]
        low = n["summary"] is not None and (len(s) < 15 or (not n["content"] and s.lower() in C.STOCK_PHRASES))
        like = [o["id"] for o in notes if o["doc_id"] % 2 == 0 and n["summary_hash"] and o["summary_hash"] and o["summary_hash"][:8] == n["summary_hash"][:8] and ratio(s, cut[o["id"]]) >= 0.85]
        want.append((n["id"], "low_value" if low else "redundant" if like else "", None if low else min(like, default=None)))
    assert rows(spark, small, "f8_ingest_filter", "id", "state", "redundant_of") == sorted(want, key=repr)
    assert {s for _, s, _ in want} == {"low_value", "redundant", ""}


def test_duplicates(spark, small, notes):
    whole = {n["id"]: f"{n['summary'] or ''}\n{n['content'] or ''}" for n in notes}
    want = [(a, b, d) for a, b in itertools.combinations(sorted(whole), 2) if (d := repeats(whole[a], whole[b]))]
    got = rows(spark, small, "p6_x19_duplicates", "a", "b", "dice")
    assert [(a, b, pytest.approx(d)) for a, b, d in sorted(want, key=repr)] == got and ("m00001005", "m00001006") in {w[:2] for w in want}


def test_guard(spark, small, notes):
    kept, want = [], []
    for n in notes:
        long = len(normal(n["summary"])) >= 8
        like = [i for i, s in kept if repeats(s, n["summary"])] if long else []
        want.append((n["id"], not like, min(like, default=None)))
        if long and not like:
            kept.append((n["id"], n["summary"]))
    assert rows(spark, small, "p6_guard", "id", "accepted", "duplicate_of") == sorted(want, key=repr)
    assert any(not ok for _, ok, _ in want)


def test_curation(spark, small, notes):
    """Every entry in the order of the run, each target with a list of its own."""
    whole = {n["id"]: f"{n['summary'] or ''}\n{n['content'] or ''}" for n in notes}
    held = {"industry/AI": [(n["id"], whole[n["id"]]) for n in notes if n["doc_id"] % 11 == 0]}
    kinds, want = {"lesson": "avoid", "decision": "principles", "insight": "insights", "fact": "methods", "correction": "avoid"}, []
    for n in sorted(notes, key=lambda n: (-n["importance"], -n["confidence"], n["id"])):
        if n["confidence"] < 0.6 or n["importance"] < 3:
            continue
        raw, kind = n["industry"], kinds.get(n["type"], "insights")
        target = f"industry/{raw.strip('[] ' + chr(34) + chr(39))}" if raw else kind
        there = held.setdefault(target, [])
        if n["id"] in {i for i, _ in there}:
            want.append((n["id"], target, kind, "", False, "held", None))
            continue
        long = len(normal(whole[n["id"]])) >= 8
        like = [i for i, t in there if len(normal(t)) >= 8 and repeats(t, whole[n["id"]])] if long else []
        want.append((n["id"], target, kind, "", False, "duplicate" if like else "stored", like[0] if like else None))
        if not like:
            there.append((n["id"], whole[n["id"]]))
    got = rows(spark, small, "p3_p6_whole_curation", "id", "target", "kind", "tags", "review", "state", "duplicate_of")
    assert got == sorted(want, key=repr)
    assert {w[5] for w in want} >= {"held", "stored"}


def test_curation_of_planted_entries(spark):
    from lodestore.operators.distill import curation

    text = "the gateway keeps three copies of each block of the table it is told about"
    entries = [
        ("a", "fact", text, 0.9, 5, '["AI", "finance"]', "src/1"),
        ("b", "fact", text + "!", 0.9, 5, "AI", "src/1"),  # repeats a
        ("c", "fact", text, 0.9, 5, "", "src/1"),  # another target
        ("d", "fact", text, 0.9, 9, "energy", "http://BLOG.x"),  # stays below
        ("e", "decision", "拿不准：是否迁移数据库到新的集群上去", 0.6, 3, "[energy]", None),
        ("f", "decision", text, 0.59, 9, "", ""),
        ("g", "other", text + "?", 0.95, 5, None, "medium"),  # without an industry, any source will do
        ("h", "insight", None, 0.9, 4, "", ""),
        ("i", "fact", text, 0.9, 9, "AI", ""),  # held
    ]
    e = spark.createDataFrame(entries, "id string, type string, summary string, confidence double, importance int, industry string, source_ref string").selectExpr("*", "cast(null as string) as content")
    held = spark.createDataFrame([("i", "industry/AI", "something else altogether")], "id string, target string, text string")
    got = {r["id"]: tuple(r)[1:] for r in curation(e, held).collect()}
    assert got == {
        "a": ("industry/AI", "methods", "AI, finance", False, "stored", None),
        "b": ("industry/AI", "methods", "", False, "duplicate", "a"),
        "c": ("methods", "methods", "", False, "stored", None),
        "e": ("industry/energy", "principles", "", True, "stored", None),
        "g": ("insights", "insights", "", False, "stored", None),
        "h": ("insights", "insights", "", False, "stored", None),
        "i": ("industry/AI", "methods", "", False, "held", None),
    }


def sought(summary):
    text = half_width(summary).lower()
    pairs = sorted(g for g in grams(re.sub(r"[^一-鿿]", "", text), 2) if len(g) == 2 and not set(g) & set(C.STOP_CHARS))
    words = {w for w in re.findall(r"[a-z][a-z0-9]+", text) if w not in C.STOP_WORDS}
    return [*pairs[:3], *sorted(words, key=lambda w: (-len(w), w))[:2]]


def topics(text):
    text = half_width(text).lower()
    pairs = {p for run in re.findall(r"[一-鿿]{2,}", text) for p in grams(run, 2)}
    return {t for t in pairs | set(re.findall(r"[a-z][a-z0-9_]+", text)) if t not in C.STOP_WORDS}


def conflict(a, b, similarity):
    def held(text, words):
        return any(w in text.lower() for w in words)

    def amounts(text):
        found = re.findall(rf"(\d+\s*({'|'.join(C.UNITS)}))", text)
        return {x for x, _ in found}, {u for _, u in found}

    if similarity < 0.3 and jaccard(topics(a), topics(b)) < 0.16:
        return "independent"
    sides = [(p, q) for x, y in C.ANTONYMS for p, q in ((x, y), (y, x))]
    opposed = any(p in a and q not in a and q in b and p not in b for p, q in sides)
    if (held(a, C.NEGATIONS) != held(b, C.NEGATIONS) and similarity >= 0.5) or (opposed and similarity >= 0.3):
        return "conflict_rule_semantic" if held(a, C.RULE_WORDS) and held(b, C.RULE_WORDS) else "conflict_summary_conclusion"
    (x, u), (y, v) = amounts(a), amounts(b)
    return "conflict_event_fact" if u & v and not x & y and similarity >= 0.42 else "extension"


def test_conflicts(spark, small, notes):
    by_id = {n["id"]: n for n in notes}
    newest = sorted(sorted(notes, key=lambda n: n["id"]), key=lambda n: n["timestamp"], reverse=True)
    want = {}
    for n in notes:
        keys = sought(n["summary"])
        others = [o["id"] for o in newest if o is not n and any(k in half_width(o["summary"]).lower() for k in keys)]
        for o in others[:5]:
            a, b = n["summary"], by_id[o]["summary"]
            similarity = round(max(ratio(a, b), jaccard(grams(normal(a), 3), grams(normal(b), 3))), 6)
            want[n["id"], o] = (pytest.approx(similarity, abs=1e-6), conflict(a, b, similarity))
    got = {r[:2]: r[2:] for r in rows(spark, small, "p7_x17_conflicts", "id", "other", "similarity", "class")}
    assert got == want and len({c for _, c in want.values()}) >= 3


def claims(n):
    whole = f"{n['summary'] or ''} {n['content'] or ''}"
    signal = next((s for s in C.CONTRADICTION_SIGNALS if s in whole), None)
    about = (n["summary"] or "") if signal is None else whole.split(signal, 1)[1]
    return signal is not None, about[: C.OBJECT_CHARS], whole


def contradicting(a, b):
    copies = (a["summary_hash"] and b["summary_hash"] and a["summary_hash"][:8] == b["summary_hash"][:8]) or SequenceMatcher(None, a["summary"] or "", b["summary"] or "").ratio() >= C.SAME_LIMIT
    (denies, about, whole), (other_denies, other_about, other_whole) = claims(a), claims(b)
    apart = about and other_about and SequenceMatcher(None, about, other_about).ratio() < C.OBJECT_LIMIT
    return copies and denies != other_denies and apart and SequenceMatcher(None, whole, other_whole).ratio() < C.SAME_LIMIT


def test_contradictions(spark, small, notes):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):  # a null text is a text without words: the searches' SQL leaves it out of the average length, the engine doesn't
        con.execute(f"CREATE VIEW {t} AS SELECT * REPLACE (coalesce(text, '') AS text) FROM '{small}/{t}.parquet'")
    hits = con.execute(f'WITH {STORE}, {BENCH_QUERIES}, {INDEX} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY "full" DESC, id) - 1 AS r, id, "full" FROM bm QUALIFY r < 10 ORDER BY qid, r').fetchall()
    by_id = {n["id"]: n for n in notes}
    want, lost = [], 0
    for qid, group in itertools.groupby(hits, key=lambda h: h[0]):
        left = [(r, by_id[i], score) for _, r, i, score in group if not by_id[i]["deprecated"]]
        gone = set()
        for (r, a, x), (s, b, y) in itertools.combinations(left, 2):
            if r not in gone and s not in gone and contradicting(a, b):
                first, second = ((n["confidence"] or 0.5, n["timestamp"], score) for n, score in ((a, x), (b, y)))
                gone.add(s if first >= second else r)
        lost += len(gone)
        want += [(qid, r, n["id"]) for r, n, _ in left if r not in gone]
    assert rows(spark, small, "r13_contradictions", "qid", "rank0", "id") == sorted(want, key=repr)
    assert lost and len(want) < len(hits) - lost  # deprecated ones go too


def test_verified_key_data(spark, small, notes):
    want = []
    for n in notes:
        text = n["content"] or ""
        free, found = [True] * len(text), []
        for kind, pattern in KEY_DATA:
            for m in re.finditer(pattern, text):
                if all(free[m.start() : m.end()]):
                    free[m.start() : m.end()] = [False] * len(m[0])
                    found.append((kind, m[0].strip()))
        told = [v for kind, v in found if kind != "conclusion"]
        want.append((n["id"], len(found), sum(v in f"{text}\n{n['summary'] or ''}" for v in told), len(told)))
    assert rows(spark, small, "x7_x9_r21_verify", "id", "n_keys", "passed", "total") == sorted(want, key=repr)
    assert max(k for _, k, _, _ in want) >= 3


def test_approximate_vectors(spark):
    """At least nine tenths of the exact top for each question, with exact scores."""
    import numpy as np

    table = pq.read_table(f"{SMALL}/embeddings.parquet").to_pylist()
    vecs = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in table}
    found = {}
    for r in entry.queries()["r3_k6_approximate"](spark, SMALL).collect():
        found.setdefault(r["qid"], {})[int(r["id"][1:])] = r["score"]
    asked = [r["item_id"] for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist() if r["item_id"] in vecs]
    hits = total = 0
    for q in asked:
        exact = {i: float(vecs[q] @ v) for i, v in vecs.items()}
        top = sorted(exact, key=lambda i: (-round(exact[i], 9), i))[:200]
        assert all(abs(exact[i] - s) < 1e-6 for i, s in found[q].items())
        hits, total = hits + len(found[q].keys() & set(top)), total + len(top)
    assert hits >= 0.9 * total > 0


def test_distill_run(spark, small, notes):
    """One run over the derived store: patterns and decay in plain loops; every distilled text is that of a stored entry, so the guard refuses it."""
    ran = rows(spark, small, "p11_p24_distill_run", "step", "id", "what")
    top = sorted((n for n in notes if n["confidence"] > 0.6), key=lambda n: (-n["confidence"], n["id"]))[:500]
    agents = {}
    for n in top:
        agents.setdefault(n["source_agent"], []).append(n)
    agents = {a: own for a, own in agents.items() if len(own) >= 3}
    assert [(i, w) for step, i, w in ran if step == "pattern"] == sorted((a, str(len(own))) for a, own in agents.items())
    said = [w for step, _, w in ran if step == "store"]
    assert len(said) == len(agents) > 0 and set(said) <= {"duplicate", "stored"}
    old = sorted((n for n in notes if n["updated_at"] < "2026-08-02T00:00:00Z" and n["half_life"] != "permanent"), key=lambda n: (n["importance"], n["id"]))[:20]
    want = [(n["id"], f"{max(0.1, n['confidence'] - 0.1):.2f}/{max(1, n['importance'] - 1)}") for n in old]
    assert [(i, w) for step, i, w in ran if step == "decay"] == sorted(want)
