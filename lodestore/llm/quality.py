"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a row of numbers (lengths, ratios, repetition). Boosting goes round the features in
turn; each step fits a tree of at most four leaves to the gradient over one feature's bins and adds it, shrunk, to that
feature's lookup table. The pairs of features whose grids explain most of what is left get tables of their own, made the
same way with two-way trees. A score is the logistic of a sum of table entries.

Null and empty texts get the features of an empty text and so one score. Labels that are null, or have no
document, teach nothing; repeated labels of one document count once, the larger. With no label to learn from, or one
class only, the score is the smoothed share of ones. Repeated rows are scored alike; an empty table gives an
empty result. Only doc_id and text are read for a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestore import on_workers

from .common import on_texts, saved

#: Labelled rows that the model is fitted on at most: those with the least hash of doc_id.
MAX_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3

FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_words", "top_word", "letters", "upper", "digits", "marks", "odd_marks",
    "line_length", "repeated_lines", "packed", "sentence_words", "short_words", "same_neighbour",
)
_LETTERS = re.compile(r"[^\W\d_]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGITS = re.compile(r"\d")
_MARKS = re.compile(r"[^\w\s]")
_ODD = re.compile(r"[^\w\s.,;:'\"?()-]")
_ENDS = re.compile(r"[.?!]")


def text_features(text: str | None) -> list[float]:
    """The numbers of a whole text, in the order of FEATURES."""
    text = text or ""
    n = len(text)
    words = text.split()
    m, one = len(words), max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    raw = text.encode("utf-8", "surrogatepass")
    return [
        math.log1p(n),
        math.log1p(m),
        n / one,
        len(counts) / one,
        max(counts.values(), default=0) / one,
        len(_LETTERS.findall(text)) / max(1, n),
        len(_UPPER.findall(text)) / max(1, n),
        len(_DIGITS.findall(text)) / max(1, n),
        len(_MARKS.findall(text)) / one,
        len(_ODD.findall(text)) / one,
        math.log1p(n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        len(zlib.compress(raw, 1)) / max(20, len(raw)),
        math.log1p(m / (1 + len(_ENDS.findall(text)))),
        sum(map((4).__gt__, map(len, words))) / one,
        sum(map(str.__eq__, words, words[1:])) / one,
    ]


def _step(grad: np.ndarray, hess: np.ndarray, low: int, high: int, depth: int, l2: float, out: np.ndarray) -> None:
    """Fit a tree of cuts to the bins [low, high) and add its leaf values to out."""
    g, h = grad[low:high], hess[low:high]
    total_g, total_h = g.sum(), h.sum()
    if depth and high - low > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = left_g**2 / (left_h + l2) + (total_g - left_g) ** 2 / (total_h - left_h + l2)
        at = int(np.argmax(gain))
        if gain[at] > total_g**2 / (total_h + l2) + 1e-9:
            _step(grad, hess, low, low + at + 1, depth - 1, l2, out)
            _step(grad, hess, low + at + 1, high, depth - 1, l2, out)
            return
    out[low:high] += total_g / (total_h + l2)


class AdditiveModel:
    """Lookup tables of single features and of pairs, under a logistic link."""

    def __init__(self, bins: int = 48, pair_bins: int = 8, pairs: int = 8, rounds: int = 200, rate: float = 0.08, l2: float = 2.0):
        self.bins, self.pair_bins, self.n_pairs, self.rounds, self.rate, self.l2 = bins, pair_bins, pairs, rounds, rate, l2

    def _edges(self, x: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        ones, n = float(y.sum()), len(y)
        self.base = math.log((ones + 1) / (n - ones + 1))
        self.edges = [self._edges(x[:, j], self.bins) for j in range(x.shape[1])]
        self.coarse = [self._edges(x[:, j], self.pair_bins) for j in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if n == 0 or ones in (0, n):
            return self
        bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            for j, b in enumerate(bins):
                p = 1 / (1 + np.exp(-score))
                size = len(self.tables[j])
                add = np.zeros(size)
                _step(np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size), 0, size, 2, self.l2, add)
                add *= self.rate
                self.tables[j] += add
                score += add[b]
        few = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.coarse)]
        p = 1 / (1 + np.exp(-score))
        gains = []
        for i, j in combinations(range(len(few)), 2):
            wide = len(self.coarse[j]) + 1
            cell = few[i] * wide + few[j]
            g, h = np.bincount(cell, y - p), np.bincount(cell, p * (1 - p))
            gains.append(((g**2 / (h + self.l2)).sum(), i, j))
        for _, i, j in sorted(gains, reverse=True)[: self.n_pairs]:
            self.pairs.append((i, j, np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1))))
        for _ in range(self.rounds // 4):
            for i, j, table in self.pairs:
                p = 1 / (1 + np.exp(-score))
                cell = few[i] * table.shape[1] + few[j]
                g = np.bincount(cell, y - p, table.size).reshape(table.shape)
                h = np.bincount(cell, p * (1 - p), table.size).reshape(table.shape)
                add = self._two_way(g, h) * self.rate
                table += add
                score += add[few[i], few[j]]
        return self

    def _two_way(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The cut of the first feature, and one of the second on either side of it, that together gain most."""
        out = np.zeros(g.shape)
        if min(g.shape) < 2:
            return out

        def best(part_g: np.ndarray, part_h: np.ndarray) -> np.ndarray:
            """Gain of the best second cut, for each row of sums over one side of a first cut."""
            left_g, left_h = np.cumsum(part_g, axis=1)[:, :-1], np.cumsum(part_h, axis=1)[:, :-1]
            all_g, all_h = part_g.sum(axis=1, keepdims=True), part_h.sum(axis=1, keepdims=True)
            return (left_g**2 / (left_h + self.l2) + (all_g - left_g) ** 2 / (all_h - left_h + self.l2)).max(axis=1)

        low_g, low_h = np.cumsum(g, axis=0)[:-1], np.cumsum(h, axis=0)[:-1]
        at = int(np.argmax(best(low_g, low_h) + best(g.sum(axis=0) - low_g, h.sum(axis=0) - low_h))) + 1
        for part in (slice(0, at), slice(at, None)):
            line = np.zeros(g.shape[1])
            _step(g[part].sum(axis=0), h[part].sum(axis=0), 0, g.shape[1], 1, self.l2, line)
            out[part] = line
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: table look-ups, added up."""
        total = np.full(len(x), self.base)
        for j, (e, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(e, x[:, j], "right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-total))


def is_held_out(column, folds: int, fold: int):
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def training_rows(docs: DataFrame, labels: DataFrame, target: str, held_out, max_rows: int) -> DataFrame:
    """Documents with a label y that are not held out: of at most max_rows labels, those with the least hash of doc_id."""
    own = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(target) > 0).cast("int").alias("y"))
    picks = saved(own.where(~held_out).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(max_rows), "training-labels")
    found = docs.select("doc_id", "text").join(F.broadcast(picks), "doc_id")  # max_rows pairs of numbers at most
    # one text for each label, so that repeated rows of a doc_id can't make more than max_rows
    return found.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


_features = on_texts(lambda texts: list(map(text_features, texts)), T.ArrayType(T.DoubleType()))


def fitted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> AdditiveModel:
    """A model of the quality labels that are not held out; only the sample's numbers come to the driver."""
    on_workers(docs.sparkSession)
    rows = training_rows(docs, labels, "quality", is_held_out(F.col("doc_id"), FOLDS, 0), max_rows)
    sample = rows.select("doc_id", "y", _features("text").alias("x")).toPandas()
    x = np.array(sample["x"].tolist(), float).reshape(len(sample), len(FEATURES))
    order = np.lexsort((*x.T, sample["doc_id"].to_numpy()))
    return AdditiveModel().fit(x[order], sample["y"].to_numpy(float)[order])


def scorer(model: AdditiveModel):
    """A column function: the score of a text column under a model."""
    return on_texts(lambda texts: list(model.score(np.array(list(map(text_features, texts))).reshape(-1, len(FEATURES)))), T.DoubleType())


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    score = scorer(fitted(docs, labels, max_rows))
    out = docs.select("doc_id", is_held_out(F.col("doc_id"), FOLDS, 0).alias("held_out"), score("text").alias("score"))
    return saved(out.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")), "quality")


def good_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs that the classifier accepts."""
    return docs.where(scorer(fitted(docs, labels, max_rows))("text") >= THRESHOLD)
