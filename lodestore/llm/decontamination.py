"""Benchmark decontamination by the q-gram lemma.

An item of m characters that stands in a text with at most k edits shares at least m - q + 1 - k * q of its
q-grams with the text, all on diagonals within k of each other. Shared q-grams are counted in
bands of 2k diagonals that overlap by half, so one band holds them all; a band that reaches the bound is a region, and
a banded alignment of the item against the region settles its edits and span.

Texts and items are compared in lower case (A-Z) with each run of white space as one space, as UTF-8. Items
shorter than Q bytes are matched as whole words without an edit; those of two grams or more may hold edits. A q-gram that an item
repeats more than ``REPEAT`` times is not counted and the bound is that much less; a part whose bound would vanish is aligned with
all the text around its q-grams instead, so nothing within a budget is lost and hits stay few however often a text repeats itself.

Null and empty texts and items match nothing. A null doc_id or item_id is carried along; every row is judged by its own text, so of rows
that share a doc_id only those that hold an item go. Repeated rows are reported alike; an empty benchmark or
table gives an empty result. Only doc_id, text, item_id are read. The benchmark is sent to the executors in blocks of
a fixed size, so its size is not bounded: each block is a pass over the texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestore import on_workers

from .common import dropped, on_texts, saved

Q = 10
#: Edits allowed for each byte of an item, and the length below which none are.
EDIT_RATE, MIN_EDIT = 0.08, 2 * Q
#: Items of so many bytes or more have windows.
MIN_ITEM = 60
#: They are also looked for in windows of so many bytes, or of this share of the item if that is less. Windows
#: start an edit budget apart, so a passage of a window's size lacks no more than the budget of some window, at any offset.
WINDOW, SHARE = 100, 0.75
#: Bytes of benchmark text in one block.
BLOCK_BYTES = 16 << 20
#: Places of one q-gram in one item that are counted; hits that are counted at once; bytes of text that an item is aligned with at once.
REPEAT, HITS, SPAN = 4, 100_000, 1 << 18
_MUL, _BITS = np.uint64(0x9E3779B97F4A7C15), 22


def plain_bytes(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def grams(text: bytes) -> np.ndarray:
    """A 64-bit hash of the Q bytes at each place: two overlapping 8-byte words mixed."""
    n = len(text) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(text + b"\0" * 8, np.uint8)
    words = np.lib.stride_tricks.as_strided(raw.view(), shape=(n + Q - 8, 8), strides=(1, 1))
    words = np.ascontiguousarray(words).view("<u8").ravel()
    return (words[:n] * _MUL) ^ (words[Q - 8 : n + Q - 8] + (words[:n] >> np.uint64(29)))


def budget(m: int) -> int:
    """Edits allowed in an item of m bytes: a share of it, and few enough that some q-gram stays unchanged."""
    return min(int(m * EDIT_RATE), (m - Q) // Q) if m >= MIN_EDIT else 0


def _spans(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in it) of runs of so many places, one run after another."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - (np.cumsum(count) - count)[row]


class Index:
    """The q-grams of a block of items. Parts are numbered: the items first, then the windows of each, which share its q-grams."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        long = [(i, t) for i, t in items if len(t) >= Q]
        self.items = long + [(i, t) for i, t in items if 0 < len(t) < Q]
        self.short = self._words({t: [] for _, t in self.items[len(long) :]}, len(long))
        n = self.n = len(long)
        own = [grams(t) for _, t in long]
        whole = np.array([len(t) for _, t in long], np.int64)
        self.window = np.where(whole >= MIN_ITEM, np.minimum(WINDOW, (whole * SHARE).astype(np.int64)), 0)
        self.stride = np.maximum((self.window * EDIT_RATE).astype(np.int64), 1)
        self.last = np.where(self.window > 0, whole - self.window, 0)
        self.count = np.where(self.window > 0, -(-self.last // self.stride) + 1, 0)
        self.first = n + np.cumsum(self.count) - self.count
        self.size = np.concatenate((whole, np.repeat(self.window, self.count)))
        self.edits = np.concatenate((np.array([budget(len(t)) for _, t in long], np.int64), np.repeat((self.window * EDIT_RATE).astype(np.int64), self.count)))
        self.owner = np.concatenate((np.arange(n), np.repeat(np.arange(n), self.count)))
        at = np.zeros(len(self.size), np.int64)  # offset of each part in its item
        row, k = _spans(self.count)
        at[n:] = np.minimum(k * self.stride[row], self.last[row])
        self.at = at
        gram = np.concatenate(own) if own else np.empty(0, np.uint64)
        begin = np.cumsum([0, *map(len, own)])
        item, place = _spans(np.diff(begin))
        often = self._often(gram, item)
        bound = self.size - Q + 1 - self.edits * Q
        gone = np.concatenate(([0], np.cumsum(often)))  # a part's grams are the run of its item's that starts at its offset
        start = begin[self.owner] + at
        bound = bound - (gone[start + self.size - Q + 1] - gone[start])
        self.loose = np.flatnonzero(bound < 1)
        self.bound = np.where(bound < 1, 1 << 62, bound)
        # hits that an item needs for itself or for any of its windows
        self.need = np.full(n, 1 << 62, np.int64)
        np.minimum.at(self.need, self.owner, self.bound)
        self.gram, self.item, self.place = self._sorted(gram[~often], item[~often], place[~often])
        # the grams of items with loose parts, once each
        rare = np.isin(item, self.owner[self.loose])
        once = np.unique(np.stack((gram[rare], item[rare].astype(np.uint64))), axis=1)
        self.any_gram, self.any_item = once[0], once[1].astype(np.int64)
        self.bits = np.zeros(1 << _BITS, bool)
        for known in (self.gram, self.any_gram):
            self.bits[(known * _MUL) >> np.uint64(64 - _BITS)] = True
        self.reach = int((self.size + 3 * self.edits).max(initial=0)) + Q

    @staticmethod
    def _often(gram: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether an item holds a q-gram more than REPEAT times."""
        order = np.lexsort((gram, item))
        new = np.ones(len(gram), bool)
        new[1:] = (gram[order][1:] != gram[order][:-1]) | (item[order][1:] != item[order][:-1])
        run = np.cumsum(new) - 1
        out = np.empty(len(gram), bool)
        out[order] = np.bincount(run, minlength=1)[run] > REPEAT
        return out

    @staticmethod
    def _sorted(gram: np.ndarray, item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(gram, kind="stable")
        return gram[order], item[order], place[order]

    def _words(self, short: dict[bytes, list[int]], first: int):
        """An automaton of the items shorter than a q-gram, as whole words; None without any."""
        import ahocorasick

        for k, (_, t) in enumerate(self.items[first:], first):
            short[t].append(k)
        if not short:
            return None
        found = ahocorasick.Automaton()
        for t, own in short.items():
            found.add_word(f" {t.decode('latin-1')} ", (len(t), own))
        found.make_automaton()
        return found

    def short_items(self, text: bytes) -> list[tuple[int, int, int, int, int]]:
        """The first place of each item shorter than a q-gram."""
        seen: dict[int, tuple[int, int, int, int, int]] = {}
        if self.short is not None:
            for end, (size, own) in self.short.iter(f" {text.decode('latin-1')} "):
                for k in own:
                    seen.setdefault(k, (k, end - 1 - size, end - 1, 0, 1))
        return list(seen.values())

    def part(self, i: int) -> tuple[int, int, bytes]:
        """(item number, offset, bytes) of a part."""
        k, at = int(self.owner[i]), int(self.at[i])
        return k, at, self.items[k][1][at : at + int(self.size[i])]

    def regions(self, text: bytes) -> list[tuple[int, int, int]]:
        """(part, lowest start, highest start) of places to align, in order; those of one part do not touch."""
        g = grams(text)
        at = np.flatnonzero(self.bits[(g * _MUL) >> np.uint64(64 - _BITS)])
        if len(at) == 0:
            return []
        found = self._loose_regions(g, at) if len(self.loose) else []
        low, high = np.searchsorted(self.gram, g[at], "left"), np.searchsorted(self.gram, g[at], "right")
        at, low, times = at[high > low], low[high > low], (high - low)[high > low]
        run = np.cumsum(times)
        a = 0
        while a < len(at):
            # as many places as make HITS hits, but twice the longest region at least: the next piece goes back by one region, so one of them holds each place
            b = max(int(np.searchsorted(run, run[a] - times[a] + HITS, "right")), int(np.searchsorted(at, at[a] + 2 * self.reach)))
            found += self._bands(at[a:b], low[a:b], times[a:b])
            back = int(np.searchsorted(at, at[b - 1] - self.reach))
            a = back if a < back and b < len(at) else b
        out: list[tuple[int, int, int]] = []
        for i, first, last in sorted(found):
            if out and out[-1][0] == i and first <= out[-1][2] + 1:
                out[-1] = (i, out[-1][1], max(last, out[-1][2]))
            else:
                out.append((i, first, last))
        return out

    def _loose_regions(self, g: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
        """All the text around any q-gram of an item, for its parts that have no bound."""
        low, high = np.searchsorted(self.any_gram, g[at], "left"), np.searchsorted(self.any_gram, g[at], "right")
        row, k = _spans(high - low)
        item, where = self.any_item[low[row] + k], at[row]
        order = np.argsort(item, kind="stable")
        item, where = item[order], where[order]
        out = []
        for i in self.loose:
            own = where[np.searchsorted(item, self.owner[i], "left") : np.searchsorted(item, self.owner[i], "right")]
            if len(own):
                cut, size = np.flatnonzero(np.diff(own) > 2 * self.size[i]), int(self.size[i])
                out += [(int(i), int(x) - size, int(y) + size) for x, y in zip(own[np.append(0, cut + 1)], own[np.append(cut, -1)], strict=True)]
        return out

    def _bands(self, at: np.ndarray, low: np.ndarray, times: np.ndarray) -> list[tuple[int, int, int]]:
        """(part, lowest start, highest start) of bands that reach the bound, among hits at some places of a text."""
        row, k = _spans(times)
        entry, where = low[row] + k, at[row]
        _, which, counts = np.unique(self.item[entry], return_inverse=True, return_counts=True)
        enough = counts[which] >= self.need[self.item[entry]]
        entry, where = entry[enough], where[enough]
        if len(entry) == 0:
            return []
        item, place = self.item[entry], self.place[entry]
        # each hit also counts in the windows that hold its q-gram
        span, stride, last, count = self.window[item], self.stride[item], self.last[item], self.count[item]
        lowest = np.minimum(np.maximum(-(-(place - span + Q) // stride), 0), count - 1)
        highest = np.where(place >= last, count - 1, place // stride)
        row, k = _spans(np.where(count > 0, highest - lowest + 1, 0))
        k = lowest[row] + k
        part, place, where = (np.concatenate(x) for x in ((item, self.first[item[row]] + k), (place, place[row] - np.minimum(k * stride[row], last[row])), (where, where[row])))
        _, which, counts = np.unique(part, return_inverse=True, return_counts=True)
        many = counts[which] >= self.bound[part]
        part, place, where = part[many], place[many], where[many]
        if len(part) == 0:
            return []
        width = np.maximum(self.edits[part], 1)
        band = (where - place + self.size[part]) // width
        # each hit counts in its own band and the one below: a band of number b spans diagonals of b and b + 1
        key = np.concatenate(((part << 40) + band, (part << 40) + band - 1))
        # an item's q-gram counts once a band, however often the text repeats it
        order = np.lexsort((np.concatenate((place, place)), key))
        key, spot = key[order], np.concatenate((place, place))[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (spot[1:] != spot[:-1])
        keys, counts = np.unique(key[new], return_counts=True)
        out = []
        for k in keys[counts >= self.bound[keys >> 40]]:
            i = int(k >> 40)
            w = max(1, int(self.edits[i]))
            first = int((k & ((1 << 40) - 1)) * w - self.size[i])
            out.append((i, first, first + 2 * w - 1))
        return out


def banded_alignment(item: bytes, text: bytes, edits: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of the item in a text that is at most a few edits longer; None beyond."""
    m, n = len(item), len(text)
    a, b = np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8)
    far = edits + 1
    column = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int64), column.copy()
    for i in range(1, m + 1):
        # the item may start anywhere in the region's slack, so row i only needs columns i - edits .. i + slack
        low, high = max(0, i - edits), min(n, i + (n - m) + edits)
        if low > n:
            return None
        high = max(high, 0)
        step = np.full(n + 1, far, np.int64)
        origin = np.zeros(n + 1, np.int64)
        lo = max(1, low)
        diagonal = cost[lo - 1 : high] + (b[lo - 1 : high] != a[i - 1])
        up = cost[lo : high + 1] + 1
        take = diagonal <= up
        step[lo : high + 1] = np.where(take, diagonal, up)
        origin[lo : high + 1] = np.where(take, start[lo - 1 : high], start[lo : high + 1])
        if low == 0:
            step[0], origin[0] = min(i, far), 0
        # insertions run along the row: the least of (cost - column) so far
        shifted = step - column
        run = np.minimum.accumulate(shifted)
        from_ = np.maximum.accumulate(np.where(shifted == run, column, -1))
        better = run + column < step
        origin = np.where(better, origin[from_], origin)
        step = np.minimum(step, run + column)
        cost, start = np.minimum(step, far), origin
        if cost.min() >= far:
            return None
    end = int(np.argmin(cost))
    return (int(cost[end]), int(start[end]), end) if cost[end] <= edits else None


def best_place(part: bytes, text: bytes, a: int, b: int, edits: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of a part in text[a:b], which is aligned in overlapping pieces of bounded size."""
    same = text.find(part, a, b)
    if same >= 0:
        return 0, same, same + len(part)
    if edits == 0:
        return None
    best, back = None, len(part) + 2 * edits
    while True:
        end = min(b, a + SPAN + back)
        found = banded_alignment(part, text[a:end], edits)
        if found:
            hit = (found[0], a + found[1], a + found[2])
            best = hit if best is None else min(best, hit)
        if end >= b:
            return best
        a = end - back


def find_items(text: bytes, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(item number, start, end, edits, whole) of every item found: its best whole place, else what its windows cover.

    Edits are settled only for windows that overlap no window of the item found before them.
    """
    best: dict[int, tuple[int, int, int]] = {}
    pieces: dict[int, list[tuple[int, tuple[int, int, int]]]] = {}
    later, tried = [], {}
    for i, first, last in index.regions(text):
        k, offset, part = index.part(i)
        if best.get(i, (1,))[0] == 0 or i >= index.n and k in best:
            continue  # found without an edit, or a window of an item that stands here whole (whole items come first)
        edits = int(index.edits[i])
        a, b = max(0, first - edits), min(len(text), last + len(part) + edits)
        if i >= index.n:
            same = text.find(part, a, b)
            if same >= 0:
                pieces.setdefault(k, []).append((offset, (0, same, same + len(part))))
            else:
                later.append((k, offset, part, a, b, edits))
            continue
        hit = best_place(part, text, a, b, edits)
        if hit:
            best[i] = min(best.get(i, hit), hit)
    for k, offset, part, a, b, edits in later:
        if any(abs(offset - o) < len(part) for o, _ in pieces.get(k, ())):
            continue  # overlaps a window that was found
        if (part, a, b) not in tried:  # windows of an item that repeats itself are alike
            tried[part, a, b] = best_place(part, text, a, b, edits)
        hit = tried[part, a, b]
        if hit:
            pieces.setdefault(k, []).append((offset, hit))
    out = [(i, a, b, e, 1) for i, (e, a, b) in best.items()]
    out += [(k, min(h[1] for _, h in own), max(h[2] for _, h in own), sum(h[0] for _, h in own), 0) for k, own in pieces.items()]
    return sorted(out + index.short_items(text))


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of bounded size, each small enough to send to every executor."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        own = plain_bytes(row["text"])
        if block and size + len(own) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row["item_id"], own))
        size += len(own)
    if block:
        yield block


FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "item_id", "start_byte", "end_byte", "edits", "whole", "item_bytes")])
_indexes: dict[str, Index] = {}  # the last block's index, kept by a worker between tasks


def _kept(name: str, held) -> Index:
    index = _indexes.get(name)
    if index is None:
        _indexes.clear()
        index = _indexes[name] = Index(held.value)
    return index


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_byte, end_byte, edits, whole, item_bytes) of every item, or passage of one, found in every document.

    Offsets count bytes of the text in lower case with single spaces.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = spark.createDataFrame([], FOUND)
    for block in item_blocks(benchmark):
        held, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame], held=held, name=name) -> Iterator[pd.DataFrame]:
            index = _kept(name, held)
            for pdf in batches:
                rows = []
                for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                    for i, a, b, e, whole in find_items(plain_bytes(text), index):
                        rows.append((None if doc_id is None else int(doc_id), index.items[i][0], a, b, e, whole, len(index.items[i][1])))
                yield pd.DataFrame(rows, columns=FOUND.names, dtype="Int64")

        out = out.unionByName(narrow.mapInPandas(run, FOUND))
    return saved(out, "contaminated")


def _holds(held, name: str):
    """A column function: whether a text holds an item of a block."""
    return on_texts(lambda texts: [bool(find_items(plain_bytes(t), _kept(name, held))) for t in texts], T.BooleanType())


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows in whose text no item was found: a filter by row for each block, without a shuffle or a join."""
    spark = docs.sparkSession
    on_workers(spark)
    out, kept = docs, []
    for block in item_blocks(benchmark):
        if out is not docs:  # filters of several blocks in one pass would share workers, which hold one index at a time
            out = saved(out, "clean")
            dropped(*kept)
            kept = [out]
        out = out.where(~_holds(spark.sparkContext.broadcast(block), uuid.uuid4().hex)("text"))
    return out
