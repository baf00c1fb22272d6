"""Toxic spans by a linear-chain conditional random field.

Labels are of documents, so tokens are labelled first: in toxic training documents, words and word beginnings
whose documents are toxic far more often than others mark toxic tokens; all other tokens are clean. The chain (two
states, features of the word and its affixes, transitions) is trained on those tokens by gradient steps on the
exact likelihood. Forward-backward marginals then give each token of any text a probability; a small logistic
model over their sums turns a document's marginals into its score, and runs of likely tokens are its spans.

A text is one chain, however long. It is computed in segments of ``SEGMENT`` tokens, many at a time: what a segment does to a message that
passes through it is a 2 x 2 matrix, so messages are first carried from segment to segment, then through each. Null and empty texts have no tokens and the score of
no evidence. Null labels and labels without a document teach nothing; repeated labels of a document count once, the larger. With
no label, or one class only, the score is the smoothed share of ones. Repeated rows are scored alike; an empty table
gives an empty result. Only doc_id and text are read for a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .quality import is_held_out, training_rows

FOLDS, HELD = 3, 1
THRESHOLD = 0.7
#: Labelled rows that the model is fitted on at most (those with the least hash of doc_id). Fitting and scores read whole texts.
MAX_ROWS = 3_000
SEGMENT = 64
BATCH = 2048  # segments that go through the chain at once
HASHES = 1 << 18
CACHE = 1_000_000
_TOKEN = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7, 8)


def word_parts(word: str) -> list[str]:
    """The word and the beginnings and end by which it is known."""
    w = word.lower()
    return ["=" + w, *(f"{n}{w[:n]}" for n in PREFIXES if len(w) > n), "$" + w[-4:]]


def word_features(word: str) -> list[int]:
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % HASHES for p in word_parts(word)]


def marking_parts(texts: list[str], toxic: np.ndarray) -> set[str]:
    """Words and beginnings found in toxic documents far more often than in others."""
    with_it: tuple[Counter, Counter] = (Counter(), Counter())
    for text, y in zip(texts, toxic, strict=True):
        own = {p for w in set(_TOKEN.findall(text)) for p in word_parts(w) if p[0] != "$"}
        with_it[int(y)].update(own)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    least = max(3, n1 // 200)
    out = set()
    for part, a in with_it[1].items():
        b = with_it[0][part]
        rate1, rate0 = a / n1, b / n0
        pooled = (a + b) / (n1 + n0)
        z = (rate1 - rate0) / math.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0) + 1e-12)
        if a >= least and (rate1 + 0.5 / n1) / (rate0 + 0.5 / n0) >= 5 and z >= 6:
            out.add(part)
    return out


def sequences(values: np.ndarray) -> np.ndarray:
    """Padded rows (-inf) of SEGMENT values each, the last with fewer."""
    rows = max(1, -(-len(values) // SEGMENT))
    out = np.full(rows * SEGMENT, -np.inf)
    out[: len(values)] = values
    return out.reshape(rows, SEGMENT)


def heads(rows: list[np.ndarray]) -> np.ndarray:
    """Which rows begin a text, for the rows of several texts one after another."""
    out = np.zeros(sum(map(len, rows)), bool)
    out[np.cumsum([0, *map(len, rows)])[:-1]] = True
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


class Chain:
    """Two states: 0 clean, 1 toxic. State 1 has an emission score, state 0 has none; four transition scores."""

    def __init__(self):
        self.weights = np.zeros(HASHES)
        self.bias = -3.0
        self.moves = np.zeros((2, 2))
        self.kept: dict[str, float] = {}

    def emission(self, word: str) -> float:
        e = self.kept.get(word)
        if e is None:
            if len(self.kept) >= CACHE:
                self.kept.clear()
            e = self.kept[word] = float(self.weights[word_features(word)].sum() + self.bias)
        return e

    def _emissions(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        real = np.isfinite(scores)
        em = np.stack([np.ones_like(scores), np.exp(np.clip(np.where(real, scores, 0.0), -30, 30))], axis=2)
        em[~real] = 1.0
        return em, real

    def _passage(self, scores: np.ndarray) -> np.ndarray:
        """What each segment does to a message before its first token's emission: a matrix, up to a factor."""
        em, real = self._emissions(scores)
        t = np.exp(self.moves)
        out = np.einsum("rs,sk->rsk", em[:, 0], np.eye(2))
        for i in range(1, scores.shape[1]):
            step = (out @ t) * em[:, i, None, :]
            out = np.where(real[:, i, None, None], step / step.sum(axis=(1, 2), keepdims=True), out)
        return out

    def _messages(self, scores: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(forward message into each segment, backward message into its end, expected transitions between segments)."""
        rows, t = len(scores), np.exp(self.moves)
        into, back, moved = np.ones((rows, 2)), np.ones((rows, 2)), np.zeros((2, 2))
        if head.all():
            return into, back, moved
        first = np.maximum.accumulate(np.where(head, np.arange(rows), 0))
        nth = np.arange(rows) - first
        long = np.flatnonzero((nth > 0) | np.append(nth[1:] > 0, False))
        passage = np.empty((rows, 2, 2))
        for at in range(0, len(long), BATCH):
            passage[long[at : at + BATCH]] = self._passage(scores[long[at : at + BATCH]])
        order = np.argsort(nth, kind="stable")
        cuts = np.searchsorted(nth[order], np.arange(1, nth.max() + 2))
        steps = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]  # the second segments of all texts, the third, ...
        out = np.ones((rows, 2))
        for own in steps:
            before = own - 1
            out[before] = unit(np.einsum("rs,rsk->rk", into[before], passage[before]))
            into[own] = unit(out[before] @ t)
        for own in reversed(steps):
            back[own - 1] = unit(np.einsum("rsk,rk->rs", passage[own], back[own]) @ t.T)
        for own in steps:
            pairs = out[own - 1][:, :, None] * t * np.einsum("rsk,rk->rs", passage[own], back[own])[:, None, :]
            moved += (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        return into, back, moved

    def marginals(self, scores: np.ndarray, edges: bool = False, head: np.ndarray | None = None):
        """P(state 1) for padded rows of emission scores; -inf marks padding. With edges, expected transitions too.

        head marks the rows that begin a text; each row without it continues the one before. None: every row is a text.
        """
        head = np.ones(len(scores), bool) if head is None else head
        into, back, moved = self._messages(scores, head)
        out = np.empty(scores.shape)
        for at in range(0, len(scores), BATCH):
            part = slice(at, at + BATCH)
            out[part], inside = self._within(scores[part], into[part], back[part], edges)
            moved = moved + inside
        return (out, moved) if edges else out

    def _within(self, scores: np.ndarray, into: np.ndarray, back: np.ndarray, edges: bool) -> tuple[np.ndarray, np.ndarray]:
        """Marginals, and expected transitions, of segments between their messages."""
        rows, length = scores.shape
        em, real = self._emissions(scores)
        t = np.exp(self.moves)
        f = np.empty((length, rows, 2))
        b = np.ones((length, rows, 2))
        f[0] = now = unit(into * em[:, 0])
        for i in range(1, length):
            f[i] = now = unit((now @ t) * em[:, i])
        b[length - 1] = back
        for i in range(length - 1, 0, -1):
            # beyond the end of a text nothing is known
            b[i - 1] = back = np.where(real[:, i : i + 1], unit((em[:, i] * back) @ t.T), 1.0)
        p = unit(f * b)[:, :, 1].T
        if not edges:
            return p, np.zeros((2, 2))
        pairs = f[:-1, :, :, None] * t[None, None] * (em.transpose(1, 0, 2)[1:] * b[1:])[:, :, None, :]
        pairs /= pairs.sum(axis=(2, 3), keepdims=True)
        return p, (pairs * real.T[1:, :, None, None]).sum(axis=(0, 1))

    def fit(self, texts: list[str], marked: list[np.ndarray], words: list[list[str]], epochs: int = 30, rate: float = 0.3, l2: float = 1e-6) -> None:
        """Full-batch adaptive gradient steps on the log likelihood of the token labels."""
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for own in words for w in own))}
        width = 2 + len(PREFIXES)
        table, used = np.zeros((len(vocabulary), width), np.int32), np.zeros((len(vocabulary), width), np.float32)
        for w, i in vocabulary.items():
            own = word_features(w)
            table[i, : len(own)], used[i, : len(own)] = own, 1
        rows_w, rows_y = [], []
        for own, y in zip(words, marked, strict=True):
            if not own:
                continue
            rows_w.append(sequences(np.array([vocabulary[w] for w in own], float)))
            rows_y.append(sequences(y.astype(float)))
        if not rows_w:
            return
        head = heads(rows_w)
        ids, y = np.concatenate(rows_w), np.concatenate(rows_y)
        real = np.isfinite(ids)
        ids, y = np.where(real, ids, 0).astype(np.int32), np.where(real, y, 0).astype(np.int8)
        n = real.sum()
        observed = np.zeros((2, 2))
        both = real[:, 1:]
        np.add.at(observed, (y[:, :-1][both].astype(int), y[:, 1:][both].astype(int)), 1)
        joins = np.flatnonzero(~head)  # all segments before another are full
        np.add.at(observed, (y[joins - 1, -1].astype(int), y[joins, 0].astype(int)), 1)
        # rows of a few MB at a time, whole texts
        starts = np.flatnonzero(head)
        cuts = np.unique([*starts[np.searchsorted(starts, np.arange(0, starts[-1] + 1, BATCH))], len(ids)])
        parts = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        g_w, g_b, g_m = np.full(HASHES, 1e-8), 1e-8, np.full((2, 2), 1e-8)
        for _ in range(epochs):
            by_word = (self.weights[table] * used).sum(axis=1) + self.bias
            expected, each, total = np.zeros((2, 2)), np.zeros(len(vocabulary)), 0.0
            for part in parts:
                p, moved = self.marginals(np.where(real[part], by_word[ids[part]], -np.inf), True, head[part])
                gap = np.where(real[part], y[part] - p, 0)
                each += np.bincount(ids[part].ravel(), gap.ravel(), len(vocabulary))
                expected += moved
                total += gap.sum()
            grad = np.bincount(table.ravel(), (used * each[:, None]).ravel(), HASHES) / n * 1000 - l2 * self.weights
            g_w += grad**2
            self.weights += rate * grad / np.sqrt(g_w)
            g = total / n * 1000
            g_b += g * g
            self.bias += rate * g / math.sqrt(g_b)
            g = (observed - expected) / n * 1000
            g_m += g * g
            self.moves += rate * g / np.sqrt(g_m)
        self.kept = {}


EVIDENCE = ("bias", "sum", "share", "top", "likely", "dense")


def evidence(p: np.ndarray) -> list[float]:
    """What a document's marginals say, in the order of EVIDENCE."""
    if len(p) == 0:
        return [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    total, n = float(p.sum()), len(p)
    return [1.0, math.log1p(total), math.sqrt(total / n), float(p.max()), math.log1p(float((p > 0.5).sum())), math.log1p(100 * total / (n + 20))]


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], l2)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityModel:
    """The chain and the logistic model above it."""

    def __init__(self, texts: list[str], y: np.ndarray):
        ones, n = float(y.sum()), len(y)
        self.prior = (ones + 1) / (n + 2)
        self.chain: Chain | None = None
        if not 0 < ones < n:
            return
        # marks and chain are learnt on one half, the sums over marginals on the other, then turned about:
        # marginals of texts that the marks were read off would look better than those of new ones
        half = np.arange(n) % 2
        x = np.zeros((n, len(EVIDENCE)))
        for k in (0, 1):
            own = [t for t, h in zip(texts, half, strict=True) if h != k]
            chain = self._chain(own, y[half != k])
            for i in np.flatnonzero(half == k):
                x[i] = evidence(self._marginals(chain, texts[i])[0])
        self.top = fit_logistic(x, y)
        self.chain = self._chain(texts, y)
        self.chain.kept = {}

    @staticmethod
    def _chain(texts: list[str], y: np.ndarray) -> Chain:
        marks = marking_parts(texts, y)
        one: dict[str, str] = {}  # each word is held once, however often the texts repeat it
        words = [[one.setdefault(m[0], m[0]) for m in _TOKEN.finditer(t)] for t in texts]
        known: dict[str, bool] = {}
        marked = []
        for own, toxic in zip(words, y, strict=True):
            if not toxic:
                marked.append(np.zeros(len(own)))
                continue
            for w in own:
                if w not in known:
                    known[w] = any(p in marks for p in word_parts(w))
            marked.append(np.array([known[w] for w in own], float))
        chain = Chain()
        chain.fit(texts, marked, words)
        return chain

    @staticmethod
    def _marginals(chain: Chain, text: str) -> tuple[np.ndarray, list[str]]:
        words = _TOKEN.findall(text)
        if not words:
            return np.empty(0), words
        rows = sequences(np.array([chain.emission(w) for w in words]))
        p = chain.marginals(rows, head=heads([rows]))
        return p.ravel()[: len(words)], words

    def batch_marginals(self, texts: list[str | None]) -> list[np.ndarray]:
        """Marginals of the tokens of each text; the segments of all texts go through the chain together."""
        kept, emission = self.chain.kept, self.chain.emission
        counts, rows = [], []
        for text in texts:
            words = _TOKEN.findall(text or "")
            counts.append(len(words))
            if words:
                rows.append(sequences(np.array([kept[w] if w in kept else emission(w) for w in words])))
        if not rows:
            return [np.empty(0) for _ in texts]
        p = self.chain.marginals(np.concatenate(rows), head=heads(rows)).reshape(-1)
        out, at = [], 0
        for n in counts:
            out.append(p[at : at + n])
            at += -(-n // SEGMENT) * SEGMENT
        return out

    def score(self, marginals: list[np.ndarray]) -> np.ndarray:
        x = np.array([evidence(p) for p in marginals]).reshape(-1, len(EVIDENCE))
        return 1 / (1 + np.exp(-np.clip(x @ self.top, -30, 30)))


def spans(text: str, p: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, probability) in characters of runs of tokens more likely toxic than not."""
    out: list[tuple[int, int, float]] = []
    last = -2
    for i, m in enumerate(_TOKEN.finditer(text)):
        if p[i] > 0.5:
            if last == i - 1:
                out[-1] = (out[-1][0], m.end(), max(out[-1][2], float(p[i])))
            else:
                out.append((m.start(), m.end(), float(p[i])))
            last = i
    return out


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (start, end, probability) of every row of docs."""
    held = is_held_out(F.col("doc_id"), FOLDS, HELD)
    rows = training_rows(docs, labels, "toxic", held, max_rows)
    rows = rows.select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text")).toPandas().sort_values(["doc_id", "text"])
    model = ToxicityModel(rows["text"].tolist(), rows["y"].to_numpy(float))
    held_model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held_model.value
        for pdf in batches:
            texts = pdf["text"].tolist()
            if model.chain is None:
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": model.prior, "spans": [[] for _ in texts]})
                continue
            p = model.batch_marginals(texts)
            found = [spans(t, q) if len(q) and q.max() > 0.5 else [] for t, q in zip(texts, p, strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": model.score(p), "spans": found})

    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, score double, spans array<struct<start:long,end:long,probability:double>>")
    out = out.withColumn("doc_id", F.col("doc_id").cast("long"))
    return saved(out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "spans"), "toxicity")
