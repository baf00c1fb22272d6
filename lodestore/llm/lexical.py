"""Ranked lexical search by sorting: matched (item, document, impact) arrays are concatenated, radix sorted by packed key and summed run by run.

A block of items gives the terms asked for. One pass over the texts keeps, of every document, its number of terms and the asked terms it holds. Documents are then dealt
to tasks by ranges, as many as the matched pairs ask for. A task takes pieces of bounded size: each term's impact is laid out once for every item that
asks for it, the keys (item, document) are radix sorted 16 bits at a time, and ``reduceat`` sums the runs. Heaps keep each item's best documents, so a task
passes on ``k`` rows an item, whatever its documents. All of it is in 64-bit integers but a term's weight.

Odd rows: a null or empty text has no terms and is not counted. Rows that share a doc_id, or have none, are documents of their own; one without an id stands behind equal
scores. Every row of the items is an item, also where ids repeat; an item without terms has no result.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestore import on_workers

from .common import dropped, saved

#: Bytes of items whose terms are looked for in one pass over the texts.
BLOCK_BYTES = 4 << 20
#: Matched (item, document, impact) entries that are sorted at once; a document with more is taken alone.
ENTRIES = 1 << 20
#: Matched entries of one task.
TASK_ENTRIES = 30_000_000
NO_ID = np.iinfo(np.int64).max

#: Bytes of terms by themselves with A-Z lower-cased, all other ASCII a space. UTF-8 bytes beyond ASCII are all of terms.
AS_TERMS = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """All terms of a text, in order."""
    return text.encode("utf-8", "surrogatepass").translate(AS_TERMS).split() if text else []


@dataclass
class Asked:
    """A block of items: their terms, and for each term the items that ask for it and how often."""

    ids: list
    terms: dict[bytes, int]
    starts: np.ndarray
    items: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Asked:
        terms: dict[bytes, int] = {}
        pairs = [(terms.setdefault(t, len(terms)), i, n) for i, (_, words) in enumerate(rows) for t, n in Counter(words).items()]
        flat = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        return cls([r[0] for r in rows], terms, np.searchsorted(flat[:, 0], np.arange(len(terms) + 1)), flat[:, 1], flat[:, 2])


def item_blocks(items: DataFrame) -> Iterator[Asked]:
    """Items with terms, in blocks of bounded size."""
    rows, size = [], 0
    for r in items.select(F.col("item_id"), "text").toLocalIterator():
        words = terms_of(r["text"])
        own = sum(map(len, words)) + len(words)
        if rows and size + own > BLOCK_BYTES:
            yield Asked.of(rows)
            rows, size = [], 0
        if words:
            rows.append((r["item_id"], words))
            size += own
    if rows:
        yield Asked.of(rows)


POSTED = "row long, doc_id long, n long, terms array<int>, tfs array<long>"
_terms: dict[str, dict] = {}  # the last block's terms, kept by a worker between tasks


def posted(docs: DataFrame, asked: Asked) -> DataFrame:
    """Every document's number of terms, and the asked terms that it holds with their counts. A scratch table: texts are read once a block."""
    held, name = docs.sparkSession.sparkContext.broadcast(asked.terms), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _terms:
            _terms.clear()
            _terms[name] = held.value
        known = _terms[name]
        for b in batches:
            n, terms, tfs = [], [], []
            for text in b["text"]:
                words = terms_of(text.as_py())
                found = [(known[t], c) for t, c in Counter(words).items() if t in known]
                n.append(len(words))
                terms.append([t for t, _ in found])
                tfs.append([c for _, c in found])
            yield pa.RecordBatch.from_arrays([b["row"], b["doc_id"], pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["row", "doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return saved(rows.mapInArrow(run, POSTED).where("n > 0"), "posted")


def radix_order(key: np.ndarray) -> np.ndarray:
    """Places of keys in ascending order, by counting 16 bits at a time (numpy's stable sort of 16-bit numbers is a radix sort)."""
    order, top = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable"), int(key.max()) if len(key) else 0
    for shift in range(16, top.bit_length(), 16):
        order = order[np.argsort(((key[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


class Heaps:
    """Each item's best k documents so far: higher scores first, ties by smaller id."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps, self.least = k, [[] for _ in range(items)], np.zeros(items, np.int64)

    def take(self, item: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Sums sorted by item."""
        may = (score > 0) & (score >= self.least[item])
        item, ids, score = item[may], ids[may], score[may]
        if not len(item):  # every sum of the piece is below its item's k-th
            return
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(item)], strict=True):
            i, own, docs = int(item[a]), score[a:b], ids[a:b]
            if b - a > 4 * self.k:  # what is below the k-th of this run alone needs no heap
                top = own >= np.partition(own, len(own) - self.k)[len(own) - self.k]
                own, docs = own[top], docs[top]
            heap = self.heaps[i]
            for s, d in zip(own.tolist(), docs.tolist(), strict=True):
                if len(heap) < self.k:
                    heapq.heappush(heap, (s, -d))
                elif (s, -d) > heap[0]:
                    heapq.heapreplace(heap, (s, -d))
            if len(heap) == self.k:
                self.least[i] = heap[0][0]


def summed(asked: Asked, weights: np.ndarray, heaps: Heaps, ids: np.ndarray, m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
    """Sort-based accumulation of postings (doc: places in ids, ascending)."""
    impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
    many = asked.starts[term + 1] - asked.starts[term]
    ends = np.cumsum(many)
    at = 0
    while at < len(doc):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ENTRIES, "right"))
        stop = int(np.searchsorted(doc, doc[min(stop, len(doc) - 1)])) if stop < len(doc) else len(doc)  # whole documents
        stop = stop if stop > at else int(np.searchsorted(doc, doc[at], "right"))
        own = many[at:stop]
        source = np.repeat(np.arange(at, stop), own)
        place = np.repeat(asked.starts[term[at:stop]], own) + np.arange(len(source)) - np.repeat(np.cumsum(own) - own, own)
        first = doc[at]
        span = int(doc[stop - 1] - first) + 1
        key = asked.items[place] * span + (doc[source] - first)
        value = impact[source] * asked.times[place]
        order = radix_order(key)
        key = key[order]
        runs = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        heaps.take(key[runs] // span, ids[first + key[runs] % span], np.add.reduceat(value[order], runs))
        at = stop


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents."""
    spark, kind = docs.sparkSession, dict(items.dtypes)["item_id"]
    on_workers(spark)
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for asked in item_blocks(items):
        table = posted(docs, asked)
        count, length = table.agg(F.count("*"), F.sum("n")).first()
        if not count:
            dropped(table)
            break
        df = np.zeros(len(asked.terms), np.int64)
        for term, n in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the terms of one block
            df[term] = n
        weights = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        entries = int((df * np.diff(asked.starts)).sum())
        held = spark.sparkContext.broadcast((asked, weights))

        def run(batches: Iterator[pa.RecordBatch], held=held, count=count, length=length) -> Iterator[pa.RecordBatch]:
            asked, weights = held.value
            heaps = Heaps(len(asked.ids), k)
            for b in batches:
                n = np.asarray(b["n"])
                m = 100 - 25 + (25 * n * count) // length
                sizes = np.asarray(b["terms"].value_lengths())
                doc = np.repeat(np.arange(b.num_rows), sizes)
                summed(asked, weights, heaps, np.asarray(b["doc_id"].fill_null(NO_ID)), m, doc, np.asarray(b["terms"].flatten()).astype(np.int64), np.asarray(b["tfs"].flatten()))
            rows = [(i, -d, s) for i, heap in enumerate(heaps.heaps) for s, d in heap]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ([], [], []))], names=["item", "doc_id", "score"])

        dealt = table.repartitionByRange(max(spark.sparkContext.defaultParallelism, -(-entries // TASK_ENTRIES)), "row")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
        best = dealt.mapInArrow(run, "item long, doc_id long, score long").withColumn("rank", place).where(F.col("rank") <= k)
        names = F.broadcast(spark.createDataFrame(list(enumerate(asked.ids)), f"item long, item_id {kind}"))  # one block of items
        best = best.join(names, "item").select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
        out = out.unionByName(saved(best, "ranked-search"))
        dropped(table)
    return out
