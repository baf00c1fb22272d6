"""Similarities of two texts against their plain definitions."""

import random
from difflib import SequenceMatcher

import pandas as pd

from lodestore.functions import text as X


def made(r):
    for alphabet in ("ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz ", "a", "数据库é😀x"):
        for _ in range(120):
            a = "".join(r.choice(alphabet) for _ in range(r.randint(0, 120)))
            b = list(a)
            for _ in range(r.randint(0, 30)):
                b.insert(r.randint(0, len(b)), r.choice(alphabet + "é"))
            yield a, "".join(b)[r.randint(0, 5) :]
    yield from ((None, "a"), ("a", None), ("", ""), ("a", "b"), ("x" * 199, "x" * 198), ("ab" * 150, "ba" * 150), ("a" * 300, "ab"))


def test_ratio_finds_the_blocks_that_difflib_finds(monkeypatch):
    a, b = zip(*made(random.Random(5)), strict=True)
    want = [SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)]
    long = []

    def counted(junk, x, y):
        long.append(max(len(x), len(y)))
        return SequenceMatcher(junk, x, y)

    monkeypatch.setattr(X.difflib, "SequenceMatcher", counted)
    assert X.ratio.func(pd.Series(a, dtype=object), pd.Series(b, dtype=object)).tolist() == want
    assert long and min(long) > X.SHORT  # short texts, many pairs at once


def test_likeness_is_the_jaccard_of_three_characters():
    a, b = zip(*made(random.Random(6)), strict=True)
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)} if len(t) > 2 else set(t)
    want = [len(grams(x or "") & grams(y or "")) / max(1, len(grams(x or "") | grams(y or ""))) for x, y in zip(a, b, strict=True)]
    assert X.likeness.func(pd.Series(a, dtype=object), pd.Series(b, dtype=object)).tolist() == want
