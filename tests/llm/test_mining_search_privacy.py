"""Hard negatives, ranked lexical search and personal data against brute force, and on odd and empty tables."""

import hashlib
import heapq
import math
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestore.llm import hard_negatives as HN
from lodestore.llm import lexical as LX
from lodestore.llm import pii as P

VECTORS = "vec_id long, embedding array<double>, label int, score double, rank string, row string"

# 11: hard negatives


def every_negative(rows, positives=5, negatives=5):
    own = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    place = lambda r: (-r[0], math.inf if r[1] is None else r[1])
    out = []
    for at, (anchor, vector, label) in enumerate(own):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(x * y for x, y in zip(vector, v, strict=False)), i, other) for k, (i, v, other) in enumerate(own) if k != at]
        for p, positive, _ in sorted((r for r in scored if r[2] == label), key=place)[:positives]:
            fits = sorted((r for r in scored if r[2] != label and 80 * p <= 100 * r[0] <= 100 * p), key=place)[:negatives]
            out += [(anchor, positive, k, r[1], p, r[0]) for k, r in enumerate(fits, 1)]
    return Counter(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 1.0, "x", "y") for r in rows], VECTORS).repartition(3)
    return Counter(map(tuple, HN.hard_negatives(df).collect()))


def test_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 10))
    rows = []
    for i in range(1500):
        v = centres[rng.integers(0, 12)] + 0.4 * rng.normal(size=10)
        rows.append((i, (v / np.linalg.norm(v)).tolist(), int(rng.integers(0, 4))))
    rows += [(5000 + i, rows[7][1], i % 3) for i in range(300)]  # a vector of a hundred rows a label: ties by id
    want = every_negative(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_negatives_of_odd_rows(spark):
    rows = [
        (0, [1.0, 0.5, 0.25], 1), (0, [1.0, 0.5, 0.25], 1), (100, [1.0, 0.5], 2), (1, [0.9, 0.5, 0.3], 1), (2, [0.8, 0.5, 0.2], 2), (None, [0.9, 0.45, 0.2], 2), (3, [0.9, 0.45, 0.2], 2),
        (4, None, 1), (5, [1.0, None, 2.0], 1), (6, [math.nan, 1.0, 1.0], 2), (7, [math.inf, 0.0, 0.0], 2), (8, [0.95, 0.5, 0.2], None), (9, [], 1), (200, [], 3), (300, [-1.0, -1.0, -1.0], 1),
        (400, [3e6, 1e6, 1.0], 5), (401, [3e6, 1e6, 2.0], 5), (402, [2.9e6, 1e6, 0.5], 6), (403, [2.9e6, 1e6, 0.5], 7),
    ]
    want = every_negative(rows)
    assert {0, 400} <= {r[0] for r in want} and mined(spark, rows) == want
    assert not mined(spark, []) and not mined(spark, [(1, None, 1)])
    assert mined(spark, [(0, [2e30, 1e30], 1), (1, [2e30, 1e30], 1), (2, [2e30, 1e30], 2)]) == Counter({(0, 1, 1, 2, HN.LONGS.max, HN.LONGS.max): 1})


def test_bounds_hold_and_spare_most_rows():
    rng = np.random.default_rng(9)
    x = np.floor(256 * (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.normal(size=(4000, 32))))
    centres = HN.fit_codes(x[:1000])
    codes = np.stack([HN.nearest(x[:, m * HN.WIDTH : (m + 1) * HN.WIDTH], centres[m]) for m in range(len(centres))], 1).astype(np.uint8)
    rest = x - np.concatenate([centres[m][codes[:, m]] for m in range(len(centres))], 1)
    spread = np.linalg.norm(rest, axis=1) * (1 + 1e-9) + HN.ROUNDING * np.linalg.norm(x, axis=1)
    looked_up = (x - rest) @ x[:40].T
    assert (np.abs(looked_up - x @ x[:40].T) <= np.outer(spread, np.linalg.norm(x[:40], axis=1))).all()
    scored, plain = [], HN.exact
    HN.exact = lambda r, a: scored.append(len(r)) or plain(r, a)
    try:
        wide = np.full((1, 40), np.inf)
        block = HN.Block(np.arange(40), np.zeros(40, int), x[:40], centres, -wide, wide, True, 5)
        for at in range(0, 4000, 1000):
            part = slice(at, at + 1000)
            block.take(np.arange(4000)[part], np.arange(4000)[part], np.zeros(1000, int), x[part], codes[part], spread[part])
    finally:
        HN.exact = plain
    assert sum(scored) < 0.2 * 40 * 4000


# 12: personal data

BASE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(s):
    digits = [int(c) for c in s if c.isdigit()]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_base(text):
    out = []
    for k, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = sum(c.isdigit() for c in m.group())
            if (k == 0) or (k == 1 and all(int(x) <= 255 for x in m.group().split("."))) or (k == 2 and 13 <= digits <= 19 and plain_luhn(m.group())) or (k == 3 and 9 <= digits <= 15):
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_equal_the_plain_patterns():
    rng = np.random.default_rng(2)
    pieces = ["a", "b.c", "@", "x@y.z", ".", "..", "_", "-", " ", "1", "12", "255", "256", "300.1", "1.2.3.4", "+", "+1", "(", ")", "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "é", "\n", "99", "0", "%"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.integers(1, 14)))
        assert P.base_spans(text) == plain_base(text), text
    kept = "+1 (017) 555-7713"
    assert P.base_spans(kept) == [(3, 0, len(kept))]


def test_long_texts_take_a_moment():
    began = time.time()
    for text in ("a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "+1" + "-" * 1_000_000, "a@" * 500_000, "4111 1111 1111 1111 " * 50_000, "x1234 " * 100_000, "@a.b" * 250_000):
        P.other_tokens(text, P.base_spans(text))
    assert time.time() - began < 20


def plain_bootstrap(texts):
    """(accepted value -> kind) by the same rules in plain loops."""
    holds, seeds, first = defaultdict(set), defaultdict(set), {}
    for text in texts:
        base = P.base_spans(text)
        for k, a, b in base:
            for p in P.patterns(text, a, b):
                v = text[a:b].lower()
                holds[p].add(v)
                first[p, v] = min(k, first.get((p, v), k))
        for a, b in P.other_tokens(text, base):
            for p in P.patterns(text, a, b):
                holds[p].add(text[a:b].lower())
                seeds[p].add(text[a:b].lower())
    found = {}
    for _ in range(P.ROUNDS):
        trust = {}
        for p, values in holds.items():
            for k in range(4):
                support = sum(1.0 for v in values if first.get((p, v)) == k) + sum(found[v][1] for v in seeds[p] if (p, v) not in first and v in found and found[v][0] == k)
                if support >= P.SUPPORT and round(support / len(values), 9) >= P.TRUST:
                    trust[p, k] = min(0.99, round(support / len(values), 9))
        doubts = defaultdict(float)
        for (p, k), t in trust.items():
            for v in seeds[p]:
                if (p, v) not in first:
                    doubts[v, k] += math.log1p(-t)
        now = {}
        for (v, k), d in sorted(doubts.items(), key=lambda x: x[0][1], reverse=True):
            score = round(1 - math.exp(d), 9)
            if score >= P.ACCEPT and score >= now.get(v, (0, 0))[1]:
                now[v] = (k, score)
        if len(now) == len(found) and found:
            found = now
            break
        found = now
        if not now:
            break
    return found


PLANTED = (
    [f"write to my mail: user{i}@site{i}.com please now" for i in range(6)]
    + ["write to my mail: hidden.name@localhost please now", "other mail: hidden.name@localhost bye", "the hidden.name@localhost again", "another mail: second_one@intranet here", "third mail: third9@intranet bye"]
    + [f"server at ip {i}.20.30.40 is up" for i in range(1, 5)] + ["server at ip 10-20-30-40 is up", "weighs about 12345 grams", "weighs about 77777 grams", "about 1.2.3.4 grams"]
)


def test_contexts_find_what_the_patterns_miss(spark):
    texts = PLANTED * 2 + [None, "", "no data here"]
    rows = P.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert len(rows) == len(texts)
    found = plain_bootstrap([t or "" for t in texts])
    assert found["hidden.name@localhost"][0] == 0 and found["10-20-30-40"][0] == 1 and "12345" not in found and "77777" not in found
    for r in rows:
        text = texts[r["doc_id"]] or ""
        base = plain_base(text)
        more = [(found[text[a:b].lower()][0], a, b) for a, b in P.other_tokens(text, base) if text[a:b].lower() in found]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(1 for s in base if s[0] == k) for k in range(4)]
        said = lambda spans: ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(said(base).encode()).hexdigest()
        assert r["spans"] == said(sorted(base + more)) and r["n_found"] == len(more)


def test_a_second_round_finds_more(spark):
    texts = [f"alpha code: a{i}@b{i}.org end" for i in range(4)] + [f"alpha code: c{i}@local end" for i in range(1)] + [f"beta tag: a{i}@b{i}.org stop" for i in range(4)] + ["beta tag: c0@local stop", "beta tag: d1@inner stop"]
    rows = P.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = plain_bootstrap(texts)
    assert "d1@inner" in found and {r["doc_id"] for r in rows if r["n_found"]} == {4, 9, 10}


def test_odd_rows_of_personal_data(spark, odd_docs, odd_rows, no_docs):
    rows = P.personal_data(odd_docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in odd_rows)
    assert P.personal_data(no_docs).collect() == []


# 13: ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, k=20):
    cut = lambda t: TERM.findall((t or "").translate(UPPER))
    held = [(i, Counter(cut(t)), len(cut(t))) for i, t in docs]
    held = [d for d in held if d[2]]
    df = Counter(t for _, c, _ in held for t in c)
    n_docs, length = len(held), sum(d[2] for d in held)
    out = []
    for item, text in items:
        asked, best = cut(text), []
        for i, tf, n in held:
            m = 100 - 25 + (25 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in asked if tf[t])
            if score > 0:
                best.append((-score, math.inf if i is None else i, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(heapq.nsmallest(k, best, key=lambda x: x[:2]), 1)]
    return Counter(out)


def test_search_equals_brute_force(spark, odd_docs, odd_rows, no_docs, monkeypatch):
    items = [(1, "Under the LICENSE, mit mit under1"), (1, "Under the LICENSE, mit mit under1"), (None, "shared line"), (3, None), (4, ""), (5, "--- !!"), (6, "éçà Ünïcode 文字　text_x"), (7, "long tail"), (8, "nowhere")] + [(20 + i, f"amber{i} brick cloud{i} the ember{i}") for i in range(40)]
    asked = spark.createDataFrame([(*x, 3, "y") for x in items], "item_id long, text string, rank int, doc_id string")
    want = plain_search([r[:2] for r in odd_rows], items)
    got = lambda: Counter(map(tuple, LX.ranked_search(odd_docs, asked).collect()))
    assert got() == want
    monkeypatch.setattr(LX, "BLOCK_BYTES", 120)  # several passes, pieces of a few entries
    monkeypatch.setattr(LX, "ENTRIES", 50)
    assert got() == want
    assert LX.ranked_search(no_docs, asked).count() == 0 and LX.ranked_search(odd_docs, asked.limit(0)).count() == 0


def test_pieces_that_reach_no_heap_are_passed_over(spark, odd_docs, odd_rows, monkeypatch):
    heaps = LX.Heaps(1, 1)
    heaps.take(np.array([0]), np.array([7]), np.array([50]))
    heaps.take(np.array([0, 0]), np.array([8, 9]), np.array([3, 4]))  # both below the best so far
    assert heaps.heaps == [[(50, -7)]]
    asked = spark.createDataFrame([(1, "brick amber1")], "item_id long, text string")
    monkeypatch.setattr(LX, "ENTRIES", 1)  # a document a piece: most are below the first one's score
    assert Counter(map(tuple, LX.ranked_search(odd_docs.coalesce(1), asked, 1).collect())) == plain_search([r[:2] for r in odd_rows], [(1, "brick amber1")], 1)


def test_radix_order_sorts():
    rng = np.random.default_rng(1)
    for top in (1, 1 << 15, 1 << 20, 1 << 40, 1 << 62):
        key = rng.integers(0, top, 5000)
        assert (key[LX.radix_order(key)] == np.sort(key)).all()
    assert len(LX.radix_order(np.empty(0, np.int64))) == 0


@pytest.mark.parametrize("text", ["Don't STOP 3rd-party", "ÀB文c\x00d_e", "", None, "　全角　spaces"])
def test_terms_are_the_pattern_s(text):
    assert [t.decode() for t in LX.terms_of(text)] == TERM.findall((text or "").translate(UPPER))
