"""Hilbert-curve sharding: cut the curve over quantised metadata into runs of equal row counts.

Documents are placed in a small cube of metadata (language, source, size), every dimension in
``2**bits`` bins, and sorted by the Hilbert index of their cell. Each shard is a run of that order,
so a file covers a compact box of all dimensions and its min/max statistics prune on each of them.
Values of a dimension are laid along it by row counts, so a few values spread over the whole of it.

Null dimensions sort first, a null or empty text has the size of its framing only,
equal texts with equal metadata lie side by side, repeated rows and rows with a null doc_id get slots of their own, and an empty table
gives no rows. Placing does not read extra columns, whatever their names; writing keeps them all, and the shard's folder takes
another name if a column has its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cumulated, dropped, joined_small, ranked, saved

#: Bytes of framing that every record has besides its text.
FRAME_BYTES = 16
BITS = 5
DIMENSIONS = 3


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows of ``axes``, each coordinate in ``[0, 2**bits)``).

    Gray-code form of the curve: undo the rotations from the high bit down, then read the
    transposed bits in turn.
    """
    x = [axes[:, i].astype(np.int64).copy() for i in range(axes.shape[1])]
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((x[-1] & (1 << level)) != 0, (1 << level) - 1, 0)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | (((x[i] ^ flips) >> level) & 1)
    return out


def value_bins(counts: DataFrame, column: str, bin_name: str, bits: int = BITS) -> DataFrame:
    """Bin of each distinct value of counts (column, _n) by the middle of its rows in code point order (null first): bins hold about equal row counts where values allow."""
    order = cumulated(ranked(counts, [F.col(column).asc_nulls_first()], "_place"))
    total = max(1, order.agg(F.sum("_n")).first()[0] or 0)
    return order.select(column, F.expr(f"int((2 * _first + _n) * {1 << bits} div {2 * total})").alias(bin_name))


def curve_cells(spark) -> DataFrame:
    """(_cell, curve) of every cell of the cube: a fixed table of 2**(BITS * DIMENSIONS) rows."""
    side = np.arange(1 << BITS)
    points = np.stack(np.meshgrid(side, side, side, indexing="ij"), axis=-1).reshape(-1, DIMENSIONS)
    return spark.createDataFrame(pd.DataFrame({"_cell": np.arange(len(points)), "curve": hilbert_index(points, BITS)}))


def _name(dimension: str) -> list[Column]:
    """A dimension's value as two columns that join without nulls."""
    return [F.coalesce(dimension, F.lit("")).alias(f"{dimension}_v"), F.col(dimension).isNull().alias(f"{dimension}_null")]


def _on_curve(keys: DataFrame) -> DataFrame:
    """keys (_lang, _source, _c, ...; a saved table) with the curve index of each row's cell and a number of each row, _nth."""
    pairs = saved(keys.groupBy("_lang", "_source").agg(F.count("*").alias("_n")), "shard-pairs")
    named = pairs.select(*_name("_lang"), *_name("_source"), "_lang", "_source")
    flat = keys.select("*", F.monotonically_increasing_id().alias("_nth"), *_name("_lang"), *_name("_source"))
    for dimension, bin_name in (("_lang", "_a"), ("_source", "_b")):
        bins = value_bins(pairs.groupBy(dimension).agg(F.sum("_n").alias("_n")), dimension, bin_name)
        named = named.join(bins.select(*_name(dimension), bin_name), [f"{dimension}_v", f"{dimension}_null"])
    on = ["_lang_v", "_lang_null", "_source_v", "_source_null"]
    cells = named.select(*on, (F.shiftleft("_a", 2 * BITS) + F.shiftleft("_b", BITS)).alias("_ab"))
    binned = joined_small(flat, saved(cells, "shard-bins"), on).withColumn("_cell", (F.col("_ab") + F.col("_c")).cast("long"))
    return binned.join(F.broadcast(curve_cells(keys.sparkSession)), "_cell").drop(*on, "_ab", "_cell", "_lang", "_source", "_c")


def _keys(docs: DataFrame, *carried: Column) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + FRAME_BYTES
    return docs.select(
        F.col("doc_id"),
        F.col("lang").alias("_lang"),
        F.col("source").alias("_source"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_tie"),
        F.least(F.lit((1 << BITS) - 1), F.greatest(F.lit(0), F.floor(F.log2(size.cast("double")) * 2 - 8))).cast("int").alias("_c"),
        *carried,
    )


def _placed(keys: DataFrame, shards: int) -> DataFrame:
    """keys on the curve with shard and slot. Rows that are alike in all else go by their number, so none of a third of all rows is hot."""
    order = ranked(_on_curve(keys), [F.col("curve"), F.col("_tie"), F.col("doc_id"), F.col("_nth")], "_rank")
    n = max(1, order.count())
    first = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return order.withColumn("shard", F.expr(f"_rank * {shards} div {n}").cast("int")).withColumn("slot", (F.col("_rank") - first).cast("long"))


def hilbert_shards(docs: DataFrame, shards: int) -> DataFrame:
    """Shard and slot of every document (law ``rows``: counts differ by one at most).

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), curve.
    The range sort uses (curve, text checksum, doc_id), so a group of copies that
    holds a third of all rows is cut into runs like any other rows.
    """
    keys = saved(_keys(docs), "shard-keys")  # numbers and names only: the texts are read once
    return _placed(keys, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, shards: int) -> str:
    """Write every row of docs with all its columns, a folder a shard, rows in curve order; returns the name of the folders' column.

    Rows travel with their place in one range sort, so no join can lose or repeat any: null and shared doc_ids, repeated rows.
    """
    rows = saved(_keys(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")), "shard-rows")
    folder, known = "shard", {c.lower() for c in docs.columns}
    while folder in known or "_" + folder in known:
        folder = "_" + folder
    # the ranges of the sort are runs of the curve: they are written as they lie, without a second shuffle
    placed = _placed(rows, shards).select("_doc.*", F.col("shard").alias(folder), F.col("slot").alias("_" + folder))
    order = [F.col(folder), F.col("_" + folder)]
    placed.sortWithinPartitions(*order).drop("_" + folder).write.partitionBy(folder).parquet(path)
    dropped(rows)
    return folder
