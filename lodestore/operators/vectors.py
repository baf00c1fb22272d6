"""Approximate neighbours through cells and codes, and the self-join of similar vectors.

The index deals vectors to cells (the nearest centre by inner product) and keeps a short code of each beside it. A search opens only the cells that
lie nearest to its queries, which are folders and so pruned by Spark; codes choose the candidates, and their full vectors, read
for the candidates alone, give exact scores. Centres and codes are fitted on a bounded sample; every vector is indexed. The exact channel
of :mod:`retrieval` stays beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import on_workers
from ..scratch import saved
from ..versions import Versions

#: Vectors that centres and codes are fitted on: those whose ids hash least.
SAMPLE = 20_000
#: Components of one code; centres of a code.
WIDTH, CODES = 4, 256
MOST_CELLS = 1024
#: Candidates by code for each row asked for, whose exact scores are then read.
SPARE = 4
#: Share of a question's best rows that the opened cells must hold in the sample, of so many best rows in all.
RECALL, MEASURED = 0.96, 200


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def centres_of(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centres by Lloyd's rounds from a fixed beginning; fewer if there are fewer distinct rows."""
    known = np.unique(rows, axis=0)
    centres = known[np.sort(np.random.default_rng(5).permutation(len(known))[:k])]
    for _ in range(rounds if len(known) > k else 0):
        near = closest(rows, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def closest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * rows @ centres.T, axis=1)


def needed_probes(rows: np.ndarray, cells: np.ndarray, k: int) -> int:
    """How many cells hold RECALL of the k best of a row, on the average of some rows of the sample."""
    asked = rows[:: max(1, len(rows) // 64)]
    top = np.argsort(-(asked @ rows.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(asked @ cells.T), axis=1, kind="stable"), axis=1)
    depth = np.take_along_axis(place, closest(rows, cells)[top], axis=1)
    return int(np.quantile(depth, RECALL)) + 1


def as_matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _padded(rows: np.ndarray) -> np.ndarray:
    short = -rows.shape[1] % WIDTH
    return np.pad(rows, ((0, 0), (0, short))) if short else rows


@dataclass
class VectorIndex:
    """Cells of vectors under a folder."""

    spark: SparkSession
    root: str
    id_type: str
    cells: np.ndarray
    codes: np.ndarray
    #: cells to open for each question, as measured on the sample for RECALL
    probes: int = 1

    @classmethod
    def build(cls, vectors: DataFrame, root: str, cells: int | None = None) -> VectorIndex:
        """Index vectors (id, vec) of one length. Rows without a vector are left out."""
        spark = vectors.sparkSession
        on_workers(spark)
        rows = vectors.where("vec is not null").select("id", F.col("vec").cast("array<double>").alias("vec"))
        n = rows.count()
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow()["vec"].combine_chunks()  # SAMPLE rows at most
        known = as_matrix(sample) if n else np.zeros((1, WIDTH))
        wanted = cells or int(min(MOST_CELLS, max(1, round(n**0.5))))
        own = centres_of(known, wanted)
        rest = _padded(known - own[closest(known, own)])
        parts = [centres_of(rest[:, a : a + WIDTH], CODES) for a in range(0, rest.shape[1], WIDTH)]
        codes = np.stack([np.concatenate([p, np.repeat(p[:1], CODES - len(p), axis=0)]) for p in parts])
        held, kind = spark.sparkContext.broadcast((own, codes)), dict(rows.dtypes)["id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, codes = held.value
            for b in batches:
                x = as_matrix(b["vec"]) if b.num_rows else np.zeros((0, own.shape[1]))
                cell = closest(x, own) if len(x) else np.empty(0, np.int64)
                rest = _padded(x - own[cell])
                code = np.stack([closest(rest[:, m * WIDTH : (m + 1) * WIDTH], codes[m]) for m in range(len(codes))], 1).astype(np.uint8) if len(x) else np.zeros((0, len(codes)), np.uint8)
                yield pa.RecordBatch.from_arrays([b["id"], b["vec"], pa.array([c.tobytes() for c in code], pa.binary()), pa.array(cell, pa.int32())], names=["id", "vec", "code", "cell"])

        made = rows.mapInArrow(run, f"id {kind}, vec array<double>, code binary, cell int")
        made.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(f"{root}/vectors")
        probes = needed_probes(known, own, max(10, MEASURED * len(known) // max(1, n)))
        Versions(spark, root).commit(0, {"id_type": kind, "cells": own.tolist(), "codes": codes.tolist(), "probes": probes})
        return cls(spark, root, kind, own, codes, probes)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> VectorIndex:
        _, state = Versions(spark, root).last()
        if state is None:
            raise FileNotFoundError(f"no vectors under {root}")
        return cls(spark, root, state["id_type"], np.array(state["cells"]), np.array(state["codes"]), state["probes"])

    def _rows(self, cells: list[int]) -> DataFrame:
        rows = self.spark.read.schema(f"id {self.id_type}, vec array<double>, code binary, cell int").parquet(f"{self.root}/vectors")
        return rows.where(F.col("cell").isin(cells))

    def search(self, query_vectors: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(qid, id, score, rank0): each query's k best of its nearest cells (``probes``, or as measured), by exact score, ties by id.

        The queries are a stated set, sent to the tasks in blocks. A task passes on each query's best candidates by code, once.
        """
        from .retrieval import Best, _query_blocks, ranked

        spark, kind, probes = self.spark, dict(query_vectors.dtypes)["qid"], probes or self.probes
        on_workers(spark)
        spare, schema, out = SPARE * k, f"qid {kind}, id {self.id_type}, cell int, score double", None
        for ids, matrix in _query_blocks(query_vectors):
            order = np.argsort(-(matrix @ self.cells.T), axis=1, kind="stable")[:, :probes]
            asked: dict[int, np.ndarray] = {int(c): np.flatnonzero((order == c).any(axis=1)) for c in np.unique(order)}
            held = spark.sparkContext.broadcast((np.array(ids), matrix, asked, self.cells, self.codes))

            def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                qids, queries, asked, cells, codes = held.value
                wide = _padded(queries)
                tables = np.einsum("mcw,qmw->mcq", codes, wide.reshape(len(wide), len(codes), WIDTH))
                best, where = Best(len(qids), spare), {}
                for b in batches:
                    own, found = np.asarray(b["cell"]), np.array(b["id"].to_pylist(), dtype=object)
                    code = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(b.num_rows, -1)
                    for c in np.unique(own):
                        at, mine = np.flatnonzero(own == c), asked[int(c)]
                        score = np.full((len(at), len(qids)), -np.inf)
                        near = np.broadcast_to(queries[mine] @ cells[c], (len(at), len(mine))).copy()
                        for m in range(len(codes)):
                            near += tables[m][code[at, m]][:, mine]
                        score[:, mine] = near
                        keep = np.isfinite(score).any(axis=1)
                        best.add(found[at][keep], score[keep])
                        where.update(dict.fromkeys(found[at].tolist(), int(c)))
                        if len(where) > 200_000:
                            kept = set(best.cut()[1].tolist())
                            where = {i: c for i, c in where.items() if i in kept}
                col, found, score = best.cut()
                ok = np.isfinite(score)
                col, found, score = col[ok], found[ok], score[ok]
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"qid": qids[col], "id": found, "cell": pd.array([where[i] for i in found], dtype="int32"), "score": score}), preserve_index=False)

            likely = self._rows(list(asked)).select("id", "code", "cell").mapInArrow(run, schema)
            likely = ranked(likely, F.desc("score"), F.col("id"), limit=spare).select("qid", "id", "cell")
            mine = F.broadcast(spark.createDataFrame([(q, m.tolist()) for q, m in zip(ids, matrix, strict=True)], f"qid {kind}, qvec array<double>"))  # one block
            full = self._rows(list(asked)).select("id", "cell", "vec").join(likely, ["cell", "id"]).join(mine, "qid")
            exact = F.round(F.aggregate(F.zip_with("vec", "qvec", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 9) + 0.0
            part = ranked(full.select("qid", "id", exact.alias("score")), F.desc("score"), F.col("id"), limit=k)
            out = part if out is None else out.unionByName(part)
        return spark.createDataFrame([], f"qid {kind}, id {self.id_type}, score double, rank0 long") if out is None else out


#: Bands of the self-join and signed projections of each: a pair at 0.80 is missed with a probability below 3e-5, one at 0.90 below 1e-12.
BANDS, BITS = 160, 12
#: Rows of one side of a block, and of a group of small buckets.
BLOCK, GROUP = 1024, 4096


def band_keys(rows: np.ndarray) -> np.ndarray:
    """(rows, BANDS) numbers of BITS signs of projections on fixed directions."""
    directions = np.random.default_rng(17).normal(size=(rows.shape[1], BANDS * BITS))
    signs = (rows @ directions > 0).reshape(len(rows), BANDS, BITS)
    return signs @ (1 << np.arange(BITS))


def similar_vectors(vectors: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, cosine), a < b, of vectors (id, vec) whose cosine reaches the threshold, rounded to six places.

    Rows meet where all signs of a band agree; cosines are then exact. A bucket of many rows is cut into blocks that meet pair by pair, so no task
    holds more than two blocks, and a pair is reported in the first band that it shares. Null and zero vectors are like none.
    """
    spark = vectors.sparkSession
    on_workers(spark)
    kind = dict(vectors.dtypes)["id"]

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = unit(np.stack(pdf["vec"].to_numpy()).astype(np.float64))
                yield pd.DataFrame({"id": pdf["id"], "vec": list(x), "keys": list(band_keys(x))})

    rows = vectors.where(F.col("vec").isNotNull() & F.exists("vec", lambda x: x != 0)).select("id", F.col("vec").cast("array<double>").alias("vec"))
    rows = saved(rows.mapInPandas(signed, f"id {kind}, vec array<double>, keys array<int>"), "signed-vectors")
    flat = rows.select("id", F.posexplode("keys").alias("band", "key"))
    sizes = saved(flat.groupBy("band", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1").drop("n"), "vector-buckets")
    dealt = rows.select("id", "vec", F.posexplode("keys").alias("band", "key")).join(sizes, ["band", "key"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    places = F.expr("transform(sequence(0, parts - 1), p -> struct(least(p, part) as x, greatest(p, part) as y, p = part as own))")
    dealt = dealt.withColumn("at", F.explode(places)).select("id", "vec", "band", "key", "part", "parts", "at.x", "at.y")
    # small buckets of a band are compared many to a group, a large one in groups of its own
    several = -(-rows.count() // GROUP)
    dealt = dealt.withColumn("group", F.when(F.col("parts") > 1, F.col("key")).otherwise(-1 - F.pmod("key", F.lit(several))))

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        x, ids, part, key = np.stack(pdf["vec"].to_numpy()), pdf["id"].to_numpy(), pdf["part"].to_numpy(), pdf["key"].to_numpy()
        across, left, right = pdf["x"].iloc[0] != pdf["y"].iloc[0], [], []
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            own = x[start:stop]
            fits = np.round(own @ own.T, 6) >= threshold
            if across:
                fits &= part[start:stop, None] != part[start:stop]
            i, j = np.nonzero(np.triu(fits, 1))
            left.append(start + i)
            right.append(start + j)
        i, j = np.concatenate(left), np.concatenate(right)
        swap = ids[i] > ids[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        if len(i):
            rows, at = np.unique(np.r_[i, j], return_inverse=True)
            keys = band_keys(x[rows])
            first = (keys[at[: len(i)]] == keys[at[len(i) :]]).argmax(axis=1) == pdf["band"].iloc[0]
            i, j = i[first], j[first]
        return pd.DataFrame({"a": ids[i], "b": ids[j], "cosine": np.round(np.einsum("ij,ij->i", x[i], x[j]), 6)})

    return dealt.groupBy("band", "group", "x", "y").applyInPandas(compared, f"a {kind}, b {kind}, cosine double")
