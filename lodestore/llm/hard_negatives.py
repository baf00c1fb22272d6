"""Hard-negative mining over embeddings: product quantisation with stored residual norms, exact rerank of each window.

Components are whole numbers, floor(256 * x). The index holds, of every row, one code for each pair of components (fitted on a bounded sample)
and the norm of what the codes leave over. A row's inner product with an anchor then lies within ``|anchor| * residual`` of the sum of looked-up parts,
so rows whose bounds cannot reach a window's five best are left out for certain, and all others are scored exactly. The result is that of
a full search, whatever the sample.

Anchors are a stated query set. They are taken in blocks of ANCHOR_BLOCK rows, each a pass over the index for the positives and one for the negatives;
a task passes on five rows of each window at most.

Odd rows: a row with a null label, a null vector or a null or non-finite component takes no part. Vectors shorter than the longest count as ending in zeros.
A row without a vec_id is no anchor and stands behind equal scores. Rows that share a vec_id each count, as anchors too. Scores beyond 64 bits are held at the ends of
the range. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestore import on_workers

from .common import saved

#: Rows that codes are fitted on, the ones of smallest hash; every row is indexed.
SAMPLE = 8_192
#: Components of one code, and codes to choose from.
WIDTH, CODES = 2, 256
ROUNDS = 6
ANCHOR_BLOCK = 1_024
#: Rows scored at once: rows x anchors numbers are held a few times over.
ROW_BLOCK = 1_024
#: Pairs scored exactly at once.
PAIRS = 1 << 16
LONGS = np.iinfo(np.int64)
NO_ID = LONGS.max
#: Components are held within this, so that no product overflows.
MOST = 1e150
#: What rounding may add to a bound, as a share of the vectors' norms: 32-bit sums of up to some thousand parts stay far below.
ROUNDING = 1e-4


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Whole components of a list column, a row each, ended with zeros."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = np.clip(np.floor(np.clip(np.asarray(column.flatten(), np.float64), -MOST, MOST) * 256.0), -MOST, MOST)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def fit_codes(rows: np.ndarray) -> np.ndarray:
    """(parts, codes, WIDTH) centres by Lloyd's rounds, from rows whose number of components is a multiple of WIDTH."""
    rng, parts = np.random.default_rng(11), []
    for at in range(0, rows.shape[1], WIDTH):
        own = rows[:, at : at + WIDTH]
        known = np.unique(own, axis=0)
        centres = known[np.sort(rng.permutation(len(known))[:CODES])]
        for _ in range(ROUNDS if len(known) > CODES else 0):
            near = nearest(own, centres)
            n = np.bincount(near, minlength=len(centres))
            sums = np.stack([np.bincount(near, own[:, i], len(centres)) for i in range(WIDTH)], 1)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        parts.append(np.concatenate([centres, np.repeat(centres[:1], CODES - len(centres), axis=0)]))
    return np.stack(parts)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)


INDEXED = "row long, vec_id long, label long, vec array<double>, codes binary, spread double"


def index(embeddings: DataFrame) -> tuple[DataFrame, np.ndarray] | None:
    """The index of all usable rows, a scratch table, and its code centres. None for a table without usable rows."""
    spark = embeddings.sparkSession
    on_workers(spark)
    rows = usable(embeddings)
    longest = rows.agg(F.max(F.size("vec"))).first()[0]
    if longest is None:
        return None
    dims = max(WIDTH, -(-longest // WIDTH) * WIDTH)
    mark = F.xxhash64("vec", "vec_id")
    sample = rows.orderBy(mark, "vec_id", "label").select("vec").limit(SAMPLE).toArrow()["vec"].combine_chunks()  # SAMPLE rows at most
    centres = fit_codes(matrix(sample, dims))
    held = spark.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = held.value
        for b in batches:
            x = matrix(b["vec"], dims)
            codes = np.stack([nearest(x[:, m * WIDTH : (m + 1) * WIDTH], centres[m]) for m in range(len(centres))], 1).astype(np.uint8) if len(x) else np.empty((0, len(centres)), np.uint8)
            rest = x - np.concatenate([centres[m][codes[:, m]] for m in range(len(centres))], 1)
            spread = np.linalg.norm(rest, axis=1) * (1 + 1e-9) + ROUNDING * np.linalg.norm(x, axis=1)
            yield pa.RecordBatch.from_arrays([b["row"], b["vec_id"], b["label"], b["vec"], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(spread)], names=["row", "vec_id", "label", "vec", "codes", "spread"])

    return saved(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, INDEXED), "vector-codes"), centres


class Windows:
    """The k best (score, then smaller id) of each window so far, in memory that does not grow with the rows."""

    def __init__(self, count: int, k: int):
        self.k, self.least = k, np.full(count, -np.inf)
        self.kept = [np.empty(0, np.int64)] * 3
        self.more: list[tuple[np.ndarray, ...]] = []
        self.held, self.room = 0, 4 * k * count + 200_000

    def add(self, slot: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.more.append((slot, ids, scores))
        self.held += len(slot)
        if self.held > self.room:
            self.best()

    def best(self) -> list[np.ndarray]:
        """(slot, id, score); the least score that can still be among a window's best rises."""
        slot, ids, score = (np.concatenate(x) for x in zip(self.kept, *self.more, strict=True))
        order = np.lexsort((ids, -score.astype(np.float64) if len(score) and score.min() == LONGS.min else -score, slot))
        slot, ids, score = slot[order], ids[order], score[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        last = place == self.k - 1
        self.least[slot[last]] = np.maximum(self.least[slot[last]], score[last])
        top = place < self.k
        self.kept, self.more, self.held = [slot[top], ids[top], score[top]], [], int(top.sum())
        return self.kept


def exact(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Whole inner products of paired rows, held within 64 bits."""
    if not len(rows):
        return np.empty(0, np.int64)
    if np.abs(rows).max() * np.abs(anchors).max() * rows.shape[1] < 2.0**53:
        return np.einsum("ij,ij->i", rows, anchors).astype(np.int64)
    sums = (sum(int(x) * int(y) for x, y in zip(r, a, strict=True)) for r, a in zip(rows, anchors, strict=True))
    return np.array([min(max(s, LONGS.min), LONGS.max) for s in sums], np.int64)


class Block:
    """A block of anchors against parts of the index. ``low`` and ``high`` bound the scores of each window: (windows an anchor, anchors), NaN where there is none."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray, centres: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.rows, self.labels, self.vectors, self.low, self.high, self.same = rows, labels, vectors, low, high, same
        self.norms = np.linalg.norm(vectors, axis=1)
        # the looked-up part of each code's product with each anchor
        tables = np.stack([c @ vectors[:, m * WIDTH : (m + 1) * WIDTH].T for m, c in enumerate(centres)])
        self.tables = tables.astype(np.float32) if np.abs(tables).max() < 1e30 else tables
        self.found, self.k = Windows(low.size, k), k

    def take(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, codes: np.ndarray, spread: np.ndarray) -> None:
        near = np.zeros((len(rows), len(self.rows)), self.tables.dtype)
        for m, table in enumerate(self.tables):
            near += table[codes[:, m]]
        slack = np.outer(spread, self.norms)
        up, down = near + slack, near - slack
        fits = (labels[:, None] == self.labels) == self.same
        if self.same:
            fits &= rows[:, None] != self.rows
        least, may = self.found.least.reshape(self.low.shape), np.zeros(fits.shape, bool)
        for j in range(len(self.low)):
            open_ = fits & (up >= np.fmax(least[j], self.low[j])) & (down <= self.high[j])
            if len(rows) >= self.k:  # k rows that are surely inside set a floor for all others
                sure = np.where(open_ & (down >= self.low[j]) & (up <= self.high[j]), down, -np.inf)
                floor = np.partition(sure, len(rows) - self.k, axis=0)[len(rows) - self.k]
                open_ &= up >= floor
            may |= open_
        row, anchor = np.nonzero(may)
        for at in range(0, len(row), PAIRS):
            r, a = row[at : at + PAIRS], anchor[at : at + PAIRS]
            score = exact(vectors[r], self.vectors[a])
            for j in range(len(self.low)):
                inside = (score >= self.low[j][a]) & (score <= self.high[j][a]) & (score >= least[j][a])
                self.found.add(j * len(self.rows) + a[inside], ids[r[inside]], score[inside])
        self.found.best()


def _searched(table: DataFrame, centres: np.ndarray, block: dict, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> DataFrame:
    """(slot, vec_id, score, rank) of each window's k best rows; NO_ID stands for a null vec_id."""
    dims = len(centres) * WIDTH
    held = table.sparkSession.sparkContext.broadcast((block, centres, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, centres, low, high = held.value
        search = Block(block["rows"], block["labels"], block["vectors"], centres, low, high, same, k)
        for b in batches:
            for at in range(0, b.num_rows, ROW_BLOCK):
                part = b.slice(at, ROW_BLOCK)
                codes = np.frombuffer(b"".join(part["codes"].to_pylist()), np.uint8).reshape(part.num_rows, -1)
                ids = np.asarray(part["vec_id"].fill_null(NO_ID))
                search.take(np.asarray(part["row"]), ids, np.asarray(part["label"]), matrix(part["vec"], dims), codes, np.asarray(part["spread"]))
        slot, ids, score = search.found.best()
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(ids), pa.array(score)], names=["slot", "vec_id", "score"])

    found = table.mapInArrow(run, "slot long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _blocks(anchors: DataFrame, dims: int) -> Iterator[dict]:
    """Anchors a bounded block at a time."""
    rows: list = []

    def block() -> dict:
        vectors = matrix(pa.array([r["vec"] for r in rows], pa.list_(pa.float64())), dims)
        return {"rows": np.array([r["row"] for r in rows]), "ids": np.array([r["vec_id"] for r in rows]), "labels": np.array([r["label"] for r in rows]), "vectors": vectors}

    for r in anchors.select("row", "vec_id", "label", "vec").toLocalIterator():
        rows.append(r)
        if len(rows) == ANCHOR_BLOCK:
            yield block()
            rows = []
    if rows:
        yield block()


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, least_share: int = 80, most_share: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id is divisible by ``every``, their positives the first other rows of the same label. Of each positive the first rows
    of another label follow that have between least_share and most_share hundredths of its score.
    """
    spark = embeddings.sparkSession
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    made = index(embeddings)
    if made is None:
        return out
    table, centres = made
    for block in _blocks(table.where(F.col("vec_id") % every == 0), len(centres) * WIDTH):
        n = len(block["rows"])
        wide = np.full((1, n), np.inf)
        best = _searched(table, centres, block, -wide, wide, True, positives).collect()  # windows of one block of anchors
        if not best:
            continue
        low, high, named = np.full((positives, n), np.nan), np.full((positives, n), np.nan), []
        for r in best:
            j, a, p = r["rank"] - 1, r["slot"], r["score"]
            low[j, a] = -(-least_share * p // 100)
            high[j, a] = np.inf if p == LONGS.max else most_share * p // 100  # scores held at the end of the range lie beyond it
            named.append((j * n + a, int(block["ids"][a]), None if r["vec_id"] == NO_ID else r["vec_id"], p))
        windows = F.broadcast(spark.createDataFrame(named, "slot long, anchor_id long, positive_id long, positive_score long"))
        found = _searched(table, centres, block, low, high, False, negatives).join(windows, "slot")
        negative = F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("negative_id")
        out = out.unionByName(saved(found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), negative, "positive_score", F.col("score").alias("negative_score")), "hard-negatives"))
    return out
