"""Helpers shared by the training-data operators: scratch tables, global order, checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestore.scratch import BATCH_ROWS, delete, dropped, listed, saved, shared_dir

__all__ = [
    "BATCH_ROWS", "BROADCAST_ROWS", "cumulated", "delete", "documents", "dropped", "joined_small", "let", "listed", "lower_ascii", "on_texts", "ranked", "saved",
    "shared_dir", "tasks", "with_row", "words_pattern",
]

#: Rows of a narrow table (a few numbers a row) that may be broadcast; a count is taken before.
BROADCAST_ROWS = 100_000


def with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, and the name of a column of longs that tells its rows apart: doc_id if no row lacks it or shares it, else a number.

    Numbered rows are a scratch table, so that they keep their numbers; the column's name is one that no column of docs has.
    """
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1 or doc_id is null").limit(1).count()
    if not shared:
        return docs, "doc_id"
    name, known = "_row", {c.lower() for c in docs.columns}
    while name in known:
        name = "_" + name
    return saved(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def on_texts(run: Callable[[list[str | None]], list], kind: T.DataType):
    """A column function of texts. It takes the texts of an Arrow batch, which is bounded in bytes, a few at a time, whatever the session's batch size."""

    @F.arrow_udf(kind)
    def each(texts: pa.Array) -> pa.Array:
        out: list = []
        for at in range(0, len(texts), BATCH_ROWS):
            out.extend(run(texts.slice(at, BATCH_ROWS).to_pylist()))
        return pa.array(out, to_arrow_type(kind))

    return each


def tasks(spark: SparkSession, rows: int, each: int) -> int:
    """How many tasks rows are dealt to where Python takes long for few bytes: joining small tasks by their bytes would leave cores idle."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def ranked(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Add the 0-based place of each row in the total order, without one task sorting everything.

    Rows are dealt by ranges of the order (ties may be dealt anywhere, so end the order with a
    unique column), sorted in each range and written once; only the ranges' sizes, one row a
    partition, are summed in one place.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    table = saved(placed, "ranked")
    span = table.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.max(F.col("_at").bitwiseAND((1 << 33) - 1)).alias("_last"))
    ends = {r["_part"]: r["_last"] + 1 for r in span.collect()}  # one row a partition
    total, starts = 0, []
    for part in sorted(ends):
        starts.append((part, total))
        total += ends[part]
    start = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    return (
        table.withColumn("_part", F.shiftright("_at", 33))
        .join(F.broadcast(start), "_part")
        .withColumn(rank, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_at", "_start")
    )


def cumulated(pairs: DataFrame) -> DataFrame:
    """Add _first, the number of documents in all pairs before, for pairs with a global _place.

    Sums of blocks of 1024 pairs are added up by one task: a thousandth of the distinct (source, size).
    """
    blocks = pairs.withColumn("_block", F.shiftright("_place", 10))
    inside = Window.partitionBy("_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("_block").agg(F.sum("_n").alias("_sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    return blocks.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(sums, "_block").withColumn("_first", F.col("_base") + F.col("_in")).drop("_block", "_base", "_in", "_place")


def joined_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a narrow table: broadcast if a count proves it small, else a shuffle join whose hot keys AQE splits."""
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(small) if few else small, on, how)


def words_pattern() -> str:
    """A run of anything but ASCII white space, as a Java and Python pattern."""
    return r"[^\x20\x09-\x0D]+"


def lower_ascii(col: Column) -> Column:
    """A-Z lower-cased, all else left: the fast path for plain ASCII, translate() for the rest."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, even where body's own lambdas use it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
