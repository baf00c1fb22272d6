"""Layers of memory as partitioned tables, and the register of allowed sources: writing again what is there adds nothing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import delete
from ..versions import Conflict, Versions

REGISTER = T.StructType([T.StructField(c, T.StringType()) for c in ("source_id", "tier", "kind", "label", "authorized_by", "authorized_at", "auth_ref", "registered_at")])


def _first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _state(spark: SparkSession, root: str) -> tuple[Versions, int, list[str], T.StructType | None]:
    """The table's versions, the last of them, its batches and its columns."""
    versions = Versions(spark, root)
    number, state = versions.last()
    return versions, number, state["batches"] if state else [], T.StructType.fromJson(state["schema"]) if state else None


def _appended(spark: SparkSession, root: str, write: Callable[[DataFrame | None, str], T.StructType], read: Callable[[], DataFrame | None]) -> None:
    """Write a batch against what is stored, and make it count. Where another writer was first, what it wrote is looked at too and the batch is written anew:
    no row counts twice, whoever repeats or retries."""
    for _ in range(20):
        versions, number, batches, _ = _state(spark, root)
        name = f"batch-{uuid.uuid4().hex[:12]}"
        schema = write(read(), f"{root}/{name}")
        try:
            versions.commit(number, {"batches": [*batches, name], "schema": json.loads(schema.json())})
            return
        except Conflict:
            delete(f"{root}/{name}")
    raise Conflict(f"{root}: other writers were first twenty times")


def register(sources: DataFrame, path: str, now: str) -> DataFrame:
    """Append sources (columns of :data:`REGISTER` but the last) that the register lacks, one line of JSON each; returns the whole register.

    Of several rows of one source_id the least stays; rows without one are no sources. Lines that are no JSON are skipped.
    """
    spark = sources.sparkSession
    new = _first(sources.where("source_id is not null"), ["source_id"], REGISTER.names[:-1]).withColumn("registered_at", F.lit(now)).select(*REGISTER.names)

    def write(held: DataFrame | None, to: str) -> T.StructType:
        (new if held is None else new.join(held.select("source_id"), "source_id", "left_anti").select(*REGISTER.names)).write.json(to)
        return REGISTER

    _appended(spark, path, write, lambda: registered(spark, path) if _state(spark, path)[2] else None)
    return registered(spark, path)


def registered(spark: SparkSession, path: str) -> DataFrame:
    """The register as its last complete state has it."""
    batches = _state(spark, path)[2]
    return spark.read.schema(REGISTER).option("mode", "DROPMALFORMED").json([f"{path}/{b}" for b in batches]) if batches else spark.createDataFrame([], REGISTER)


def write_layer(entries: DataFrame, root: str) -> None:
    """Append the entries (agent, id, ...) that a layer lacks, one partition an agent; of repeated ids in one batch one row stays.

    Only the ids of the batch's own agents are read: the join prunes partitions. Rows without an agent or an id are refused.
    """
    if entries.where("agent is null or id is null").limit(1).count():
        raise ValueError("an entry of a layer needs an agent and an id")
    spark = entries.sparkSession
    new = _first(entries, ["agent", "id"], [c for c, t in entries.dtypes if not t.startswith("map")])

    def write(held: DataFrame | None, to: str) -> T.StructType:
        (new if held is None else new.join(held.select("agent", "id"), ["agent", "id"], "left_anti")).write.partitionBy("agent").parquet(to)
        return entries.schema

    _appended(spark, root, write, lambda: read_layer(spark, root) if _state(spark, root)[2] else None)


def read_layer(spark: SparkSession, root: str, agent: str | None = None) -> DataFrame:
    """All entries of a layer, or one agent's: other agents' files are not opened."""
    _, _, batches, schema = _state(spark, root)
    if schema is None:
        raise FileNotFoundError(f"no layer under {root}")
    layer = None
    for b in batches:
        part = spark.read.schema(schema).parquet(f"{root}/{b}").withColumn("agent", F.col("agent").cast("string"))
        layer = part if layer is None else layer.unionByName(part)
    return layer if agent is None else layer.where(F.col("agent") == agent)


def unregistered(pages: DataFrame, register_: DataFrame, source: str = "source_id") -> DataFrame:
    """Rows whose source the register does not hold: a sink takes none of them."""
    return pages.join(register_.select(F.col("source_id").alias(source)), source, "left_anti")
