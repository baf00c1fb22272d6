"""Column functions on text: normal forms, tokens, n-grams, set similarities, hashes."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, even where body's own lambdas use it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def normal_query(col: Column) -> Column:
    """Trimmed, each run of white space as one space."""
    return F.trim(F.regexp_replace(or_empty(col), r"\s+", " "))


def clip(col: Column, n: int = 100) -> Column:
    """White space collapsed; longer texts cut to n - 1 characters and an ellipsis."""
    flat = normal_query(col)
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 1), F.lit("…"))).otherwise(flat)


def summary_hash(col: Column) -> Column:
    return F.substring(F.sha2(or_empty(col), 256), 1, 12)


def tokens(col: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(or_empty(col)), F.lit(r"([\p{L}\p{N}]+)"), 1)


def keywords(col: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct runs of CJK characters or of ASCII letters and digits, over one character, without stop words."""
    runs = F.regexp_extract_all(F.lower(or_empty(col)), F.lit(r"([\x{4e00}-\x{9fff}]+|[a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(runs, lambda w: (F.length(w) > 1) & ~w.isin(*(stop or ("",)))))


def half_width(col: Column) -> Column:
    """Full-width forms as half-width ones."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    return F.translate(or_empty(col), wide, "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " ")


def normal_text(col: Column) -> Column:
    """Half-width, lower case, word characters only."""
    return F.regexp_replace(F.lower(half_width(col)), r"[^\p{L}\p{N}_]+", "")


def normal_name(col: Column) -> Column:
    """An entity's name for alias tests: half-width, no white space, one suffix in its short form."""
    n = F.regexp_replace(half_width(col), r"[\s\x{3000}]+", "")
    return F.when(n.endswith("数据库") & (F.length(n) > 3), F.regexp_replace(n, "数据库$", "库")).otherwise(n)


def ngrams(col: Column, n: int) -> Column:
    """Distinct character n-grams; the distinct characters of shorter texts."""
    def cut(text: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
        chars = F.filter(F.split(text, ""), lambda c: c != "")
        return F.array_distinct(F.when(F.length(text) >= n, grams).otherwise(chars))

    return let(or_empty(col), cut)


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def dice(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(0.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / total)


def overlap(a: Column, b: Column) -> Column:
    """Common members over the larger set's size."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


#: Texts up to this length are matched many pairs at once; from 200 characters on difflib passes over frequent ones. Pairs at once.
SHORT, PAIRS = 199, 256


def _matched(a: list[str], b: list[str]) -> np.ndarray:
    """How many characters of each pair's short texts lie in matching blocks, as difflib finds them: the longest block, the first of equals, then what lies left and right of it.

    The length of the common run that ends at each two places is made once. Within a part it is cut by the part's own beginnings; parts share no row, so all parts of all pairs are
    looked at together, and rows without a match drop out.
    """
    def codes(texts: list[str], fill: int) -> np.ndarray:
        out = np.full((len(texts), max(map(len, texts))), fill, np.uint32)
        for i, t in enumerate(texts):
            out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        return out

    x, y = codes(a, 0xFFFFFFFF).T, codes([" " + t for t in b], 0xFFFFFFFE)
    y[:, 0] = 0xFFFFFFFE  # a column that matches nothing: a run never reaches back into the pair before
    (n, pairs), m = x.shape, y.shape[1]
    runs = (x[:, :, None] == y).astype(np.uint8).reshape(n, -1)
    for i in range(1, n):
        runs[i, 1:] *= runs[i - 1, :-1] + 1
    runs, total = runs.reshape(-1, m), np.zeros(pairs, np.int64)
    pair, at = np.repeat(np.arange(pairs), n), np.tile(np.arange(n), pairs)
    row, a_low, b_low, b_high = at * pairs + pair, np.zeros_like(at), np.zeros_like(at), np.full_like(at, m)
    low, place = np.arange(m + 1)[:, None], np.arange(m)
    since, before = np.maximum(place - low + 1, 0).astype(np.uint8), np.where(place < low, 255, 0).astype(np.uint8)
    whole = True
    while len(row):
        own = runs[row]
        if not whole:
            np.minimum(own, (at - a_low + 1).astype(np.uint8)[:, None], out=own)
            np.minimum(own, since[b_low], out=own)
            np.bitwise_and(own, before[b_high], out=own)
        whole = False
        end = own.argmax(axis=1)
        best = own[np.arange(len(row)), end].astype(np.int64)
        some = best > 0
        row, pair, at, a_low, b_low, b_high, end, best = (v[some] for v in (row, pair, at, a_low, b_low, b_high, end, best))
        if not len(row):
            break
        starts = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (a_low[1:] != a_low[:-1])])
        part = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(row)]))
        most = np.maximum.reduceat(best, starts)
        first = np.minimum.reduceat(np.where(best == most[part], np.arange(len(row)), len(row)), starts)
        np.add.at(total, pair[starts], most)
        a_end, b_end = at[first][part], end[first][part]
        left, right = at <= a_end - most[part], at > a_end
        b_high = np.where(left, b_end - most[part] + 1, b_high)
        a_low, b_low = np.where(right, a_end + 1, a_low), np.where(right, b_end + 1, b_low)
        some = (left | right) & (b_low < b_high)
        row, pair, at, a_low, b_low, b_high = (v[some] for v in (row, pair, at, a_low, b_low, b_high))
    return total


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two texts (no JVM function computes it); 0 if either is empty."""
    out, short = np.zeros(len(a)), []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x and y:
            if x == y:
                out[i] = 1.0
            elif max(len(x), len(y)) <= SHORT:
                short.append(i)
            else:
                out[i] = difflib.SequenceMatcher(None, x, y).ratio()
    for k in range(0, len(short), PAIRS):
        some = short[k : k + PAIRS]
        own, other = a.iloc[some].tolist(), b.iloc[some].tolist()
        out[some] = 2.0 * _matched(own, other) / np.array([len(x) + len(y) for x, y in zip(own, other, strict=True)])
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`jaccard` of the :func:`ngrams` of three characters of two texts: many pairs are cheaper here than as arrays of an expression."""
    def grams(text: str | None) -> set[str]:
        text = text or ""
        return {text[i : i + 3] for i in range(len(text) - 2)} if len(text) >= 3 else set(text)

    def share(x: set[str], y: set[str]) -> float:
        both = len(x & y)
        return both / (len(x) + len(y) - both) if x or y else 0.0

    return pd.Series([share(grams(x), grams(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """What :func:`ratio` of two texts cannot exceed: matching blocks take each character of both at most as often as both hold it. Stays in the JVM, so that pairs which
    fall short never reach a Python worker."""
    own = F.array_distinct(F.split(or_empty(a), ""))
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    common = F.aggregate(own, F.lit(0), lambda s, c: s + F.least(times(a, c), times(b, c)))
    lengths = F.length(a) + F.length(b)
    short = 2 * F.least(F.length(a), F.length(b)) / lengths
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(F.least(short, 2 * common / lengths))


def topic_grams(col: Column, stop: tuple[str, ...]) -> Column:
    """CJK character pairs and words of Latin letters."""
    text = F.lower(half_width(col))
    runs = F.regexp_extract_all(text, F.lit(r"([\x{4e00}-\x{9fff}]{2,})"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    words = F.filter(F.regexp_extract_all(text, F.lit(r"([a-z][a-z0-9_]+)"), 1), lambda w: ~w.isin(*stop))
    return F.array_distinct(F.concat(F.filter(pairs, lambda p: ~p.isin(*stop)), words))


def contains_any(col: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | col.contains(w)
    return out


def used(expected: Column, actual: Column) -> Column:
    """Whether what an entry was told for stands in what was made of it, whatever the case; an empty expectation is met, a null one is not known."""
    return F.contains(F.lower(or_empty(actual)), F.lower(expected))


def count_of(col: Column, words: tuple[str, ...]) -> Column:
    """How many of the words stand in the text."""
    return F.aggregate(F.array(*[F.lit(w) for w in words]), F.lit(0), lambda n, w: n + F.when(F.contains(col, w), 1).otherwise(0))


def first_place(col: Column, words: tuple[str, ...]) -> Column:
    """0-based place of the earliest of the words; null if none."""
    return F.array_min(F.filter(F.transform(F.array(*[F.lit(w) for w in words]), lambda w: F.call_function("locate", w, col) - 1), lambda p: p >= 0))


def unescape(col: Column) -> Column:
    """The common character entities of HTML."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col
