"""Edit-aware token counts: pre-token segment trees that are kept with their documents.

A text is cut into pre-tokens by the tokenizer's pattern; byte-pair merges never cross them, so the
count of a text is the sum over its pre-tokens. A :class:`TokenTree` sums characters, pre-tokens and tokens over leaves of about ``LEAF``
pre-tokens, and over pairs of pairs above. An edit re-encodes only the leaves it touches, three characters of
context before, and what follows until the new cuts meet the end of an old leaf; sums change along one path a leaf.

:func:`kept_trees` cuts and encodes every text once; its table holds the texts with their trees. :func:`edited` applies a batch of
edits to such a table and returns the next one, in which only touched leaves were encoded anew: rows without edits do not
reach Python.

Null and empty texts have 0 tokens. Edits beyond the end of a text act at its end, edits apply in the order of
seq to the text as edited so far; a null or negative start is 0, a null stop its start. Documents without edits keep
their count; edits without a document are ignored; rows that share a doc_id each get all its edits. An empty
table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved

# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF = 16  # pre-tokens of a fresh leaf
CONTEXT = 3  # characters before an edit that a cut can depend on
CACHE = 300_000  # counts of pre-tokens that a worker keeps


class Counter:
    """Token counts of pre-tokens under one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex
        import tiktoken

        self.cut = regex.compile(PATTERN).findall
        self.encoding = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kept: dict[str, int] = {}

    def count(self, token: str) -> int:
        n = self.kept.get(token)
        if n is None:
            if len(self.kept) >= CACHE:
                self.kept.clear()
            n = self.kept[token] = len(self.encoding.encode_ordinary(token))
        return n

    def counts(self, tokens: list[str]) -> list[int]:
        get, count = self.kept.get, self.count
        return [get(t) or count(t) for t in tokens]


class TokenTree:
    """A text under a tree of sums. Node 1 is the root, nodes 2n and 2n + 1 are below n; leaves are the last half, unused ones hold zeros."""

    def __init__(self, text: str, counter: Counter, sums: np.ndarray | None = None):
        self.text, self.counter, self.reencoded = text, counter, 0
        if sums is None:
            self._build(self._leaves(counter.cut(text)))
        else:
            self.sums = sums

    def _leaves(self, tokens: list[str]) -> np.ndarray:
        """Characters, pre-tokens and tokens of leaves of LEAF pre-tokens each: three rows."""
        each = np.array([list(map(len, tokens)), [1] * len(tokens), self.counter.counts(tokens)], np.int64).reshape(3, -1)
        return np.add.reduceat(each, np.arange(0, len(tokens), LEAF), axis=1) if tokens else np.zeros((3, 1), np.int64)

    def _build(self, leaves: np.ndarray) -> None:
        width = 1 << (leaves.shape[1] - 1).bit_length()
        self.sums = np.zeros((3, 2 * width), np.int64)
        self.sums[:, width : width + leaves.shape[1]] = leaves
        while width > 1:
            self.sums[:, width // 2 : width] = self.sums[:, width : 2 * width].reshape(3, -1, 2).sum(axis=2)
            width //= 2

    @property
    def width(self) -> int:
        return self.sums.shape[1] // 2

    @property
    def total(self) -> int:
        return int(self.sums[2, 1])

    @property
    def pieces(self) -> int:
        return int(self.sums[1, 1])

    @property
    def length(self) -> int:
        return int(self.sums[0, 1])

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds a character; the last one with any if beyond."""
        chars, node, before = self.sums[0], 1, 0
        while node < self.width:
            node *= 2
            if at - before >= chars[node] and chars[node + 1]:
                before += int(chars[node])
                node += 1
        return node - self.width, before

    def edit(self, start: int, stop: int, insert: str) -> None:
        """Replace the characters [start, stop) by insert."""
        start = min(max(0, start), self.length)
        stop = min(max(start, stop), self.length)
        chars, size, more = self.sums[0, self.width :], self.length, 1
        first, begin = self._find(max(0, start - CONTEXT))
        last, end = first + 1, begin + int(chars[first])
        while end < stop:
            end += int(chars[last])
            last += 1
        while True:
            # a cut stands or falls with the characters up to CONTEXT behind it, and all cuts behind an old one stand
            fresh = self.counter.cut(self.text[begin:start] + insert + self.text[stop : end + CONTEXT])
            goal, pos, n = end - begin + len(insert) - (stop - start), 0, 0
            while pos < goal and n < len(fresh):
                pos += len(fresh[n])
                n += 1
            if pos == goal or end == size:
                break
            for _ in range(more):
                if last < self.width:
                    end += int(chars[last])
                    last += 1
            more *= 2
        self._splice(first, last, fresh[:n])
        self.text = self.text[:start] + insert + self.text[stop:]

    def _splice(self, first: int, last: int, fresh: list[str]) -> None:
        """Put new pre-tokens in the place of the leaves [first, last)."""
        self.reencoded += len(fresh)
        leaves, width = self._leaves(fresh), self.width
        many = leaves.shape[1]
        if many > 2 * (last - first):  # so much was put in: deal the leaves anew, none of them encoded again
            own = self.sums[:, width:]
            kept = np.concatenate((own[:, :first], leaves, own[:, last:]), axis=1)
            self._build(kept[:, kept[0] > 0] if kept[0].any() else np.zeros((3, 1), np.int64))
            return
        # old leaves take one or two new ones each; those left over stay empty
        at = self.sums[:, width + first : width + last]
        at[:] = 0
        np.add.at(at.T, np.arange(many) * (last - first) // max(many, last - first), leaves.T)
        low, high = width + first, width + last - 1
        while low > 1:
            low, high = low // 2, high // 2
            self.sums[:, low : high + 1] = self.sums[:, 2 * low : 2 * high + 2].reshape(3, -1, 2).sum(axis=2)


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Merge ranks of a vocabulary file, read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_counters: dict[str, Counter] = {}  # kept by a worker between tasks
_TREE = ("chars", "pieces", "tokens")
_SUMS = ", ".join(f"{c} array<int>" for c in _TREE)
_EDITS = "array<struct<start:long,stop:long,insert:string>>"
_CHANGED = f"doc_id string, text string, {_SUMS}, n_tokens long, n_pretokens long, n_edits long, n_reencoded long"


def _counter(docs: DataFrame, vocabulary: str):
    """A function that gives a worker its counter; the vocabulary (tens of thousands of entries, a fixed file) is sent to the executors once."""
    held, name = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary)), uuid.uuid4().hex
    return lambda: _counters.get(name) or _counters.setdefault(name, Counter(held.value))


def total(column: str) -> Column:
    """The sum at the root of a kept tree."""
    return F.get(column, F.lit(1)).cast("long")


def kept_trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with the sums of each text's tree (chars, pieces, tokens): a table to be kept, for :func:`edited` to act on later."""
    counter = _counter(docs, vocabulary)

    @F.pandas_udf(_SUMS)
    def trees(text: pd.Series) -> pd.DataFrame:
        known = counter()
        sums = [TokenTree(t or "", known).sums.astype(np.int32) for t in text]
        return pd.DataFrame({c: [x[i] for x in sums] for i, c in enumerate(_TREE)})

    known = [c for c in docs.columns if c not in _TREE]
    return docs.select(*[F.col(f"`{c}`") for c in known], trees("text").alias("_tree")).select(*[F.col(f"`{c}`") for c in known], "_tree.*")


def edited(kept: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The next state (doc_id, text, chars, pieces, tokens) of a kept table with a column edits (array<struct<start long, stop long, insert string>>, in order; null: none).

    Also n_tokens and n_pretokens before the edits, n_edits, and n_reencoded: pre-tokens that were encoded anew.
    """
    counter = _counter(kept, vocabulary)
    none = F.coalesce(F.size("edits"), F.lit(0)) <= 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = counter()
        for pdf in batches:
            out = []
            for doc_id, text, *sums, changes in pdf[["doc_id", "text", *_TREE, "edits"]].itertuples(index=False, name=None):
                tree = TokenTree(text or "", known, np.array(sums, np.int64))
                before = tree.total, tree.pieces
                for e in changes:
                    start = max(0, int(e["start"] or 0))
                    tree.edit(start, start if e["stop"] is None else int(e["stop"]), e["insert"] or "")
                out.append((doc_id, tree.text, *tree.sums.astype(np.int32), *before, len(changes), tree.reencoded))
            yield pd.DataFrame(out, columns=["doc_id", "text", *_TREE, "n_tokens", "n_pretokens", "n_edits", "n_reencoded"])

    state = kept.where(~none).select(F.col("doc_id").cast("string").alias("doc_id"), "text", *_TREE, F.col("edits").cast(_EDITS).alias("edits"))
    changed = state.mapInPandas(run, _CHANGED).withColumn("doc_id", F.col("doc_id").cast("long"))
    zero = F.lit(0).cast("long")
    same = kept.where(none).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *_TREE, total("tokens").alias("n_tokens"), total("pieces").alias("n_pretokens"), zero.alias("n_edits"), zero.alias("n_reencoded"))
    return changed.unionByName(same)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token counts of every text before and after its edits: doc_id, n_tokens, n_pretokens, n_edits, n_tokens_edited, n_reencoded.

    docs needs doc_id, text, and edits as :func:`edited` does. The trees are made and kept first; the edits act on what was kept.
    """
    kept = saved(kept_trees(docs.select("doc_id", "text", "edits"), vocabulary), "token-trees")
    out = edited(kept, vocabulary).select("doc_id", "n_tokens", "n_pretokens", "n_edits", total("tokens").alias("n_tokens_edited"), "n_reencoded")
    out = saved(out, "token-counts")
    dropped(kept)
    return out


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, text, the tree if docs is a kept table, and the edits of each document, from rows (doc_id, seq, start, stop, insert)."""
    listed = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "stop", "insert"))).alias("_e"))
    plain = F.transform("_e", lambda e: F.struct(e["start"].cast("long").alias("start"), e["stop"].cast("long").alias("stop"), e["insert"].alias("insert")))
    return docs.select("doc_id", "text", *[c for c in _TREE if c in docs.columns]).join(listed.select("doc_id", plain.alias("edits")), "doc_id", "left")


def routine_edits(docs: DataFrame) -> DataFrame:
    """docs with three edits of every text: a deletion, an insertion, a replacement by part of the text itself."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")

    def one(start, stop, insert):
        return F.struct(start.alias("start"), stop.alias("stop"), insert.alias("insert"))

    half, quarter = F.expr("n div 2"), F.expr("n div 4")
    return docs.select("doc_id", "text", n.alias("n")).select(
        "doc_id",
        "text",
        F.array(
            one(half, half + 7, F.lit("")),
            one(quarter, quarter, F.lit(" it's an insertion,\n 42 ")),
            one(F.expr("n div 5"), F.expr("n div 5") + 11, F.substring(F.coalesce("text", F.lit("")), F.lit(1), F.lit(40))),
        ).alias("edits"),
    )
