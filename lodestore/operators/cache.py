"""Stored results of searches: keyed by the query's normal form, the settings and the store's version; valid for a while.

A batch of queries takes what is stored and still valid, runs the search for the others only and stores what they give. A key holds the version of the
index, so a write makes all earlier results unreachable: nothing needs to be found and deleted before the next search is right. Old batches are swept.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Search
from ..functions.text import normal_query
from ..scratch import delete
from ..versions import Conflict, Versions

# Fixed value: seconds for which a result stays valid.
TTL = 300


def channel_tag(cfg: Search, **asked: str | None) -> str:
    """One name for all settings that results depend on, but not the day of the search."""
    return json.dumps({k: v for k, v in asdict(cfg).items() if k != "now"} | asked, sort_keys=True, default=str)


def cache_key(text: Column, tag: str, version: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(version), F.lit(tag), normal_query(text)), 256)


class ResultCache:
    """Results under a folder, in one subfolder for each batch that was searched."""

    def __init__(self, spark: SparkSession, root: str, ttl: int = TTL):
        self.spark, self.root, self.ttl, self.states = spark, root, ttl, Versions(spark, root)

    def _batches(self, version: str, now: str) -> list[dict]:
        _, state = self.states.last()
        return [b for b in (state or {"batches": []})["batches"] if b["version"] == version and b["until"] > now]

    def _stored(self, batches: list[dict], result: T.StructType) -> DataFrame:
        """(key, rows) of valid batches, the latest of each key."""
        out = None
        for n, b in enumerate(batches):
            part = self.spark.read.schema(T.StructType([T.StructField("key", T.StringType()), T.StructField("rows", T.ArrayType(result))])).parquet(f"{self.root}/{b['name']}").withColumn("_n", F.lit(n))
            out = part if out is None else out.unionByName(part)
        return out.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("_n")))).where("_r = 1").select("key", "rows")

    def search(self, queries: DataFrame, run: Callable[[DataFrame], DataFrame], tag: str, version: str, now: str) -> DataFrame:
        """run(queries) for a batch (qid, text), from what is stored where it is valid at ``now`` (an ISO instant in UTC).

        Queries of one normal form are searched once. A query without any result is stored as such.
        """
        keyed = queries.select("qid", "text", cache_key(F.col("text"), tag, version).alias("key"))
        batches = [b for b in self._batches(version, now) if b["tag"] == tag]
        stored = None
        if batches:
            stored = self._stored(batches, T.StructType.fromJson(batches[0]["result"]))
            missing = keyed.join(stored.select("key"), "key", "left_anti")
        else:
            missing = keyed
        missing = missing.groupBy("key").agg(F.min_by("text", "qid").alias("text"), F.min("qid").alias("qid"))
        if stored is None or missing.limit(1).count():
            stored = self._put(missing, run, tag, version, now, batches)
        names = stored.schema["rows"].dataType.elementType.names
        return keyed.select("qid", "key").join(stored, "key").select("qid", F.explode("rows").alias("r")).select("qid", *[F.col(f"r.`{c}`").alias(c) for c in names])

    def _put(self, missing: DataFrame, run: Callable[[DataFrame], DataFrame], tag: str, version: str, now: str, batches: list[dict]) -> DataFrame:
        found = run(missing.select("qid", "text"))
        kept = T.StructType([f for f in found.schema.fields if f.name != "qid"])
        rows = found.groupBy("qid").agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in kept.names])).alias("rows"))  # top_k rows of a query
        name = f"batch-{uuid.uuid4().hex[:12]}"
        missing.join(rows, "qid", "left").select("key", F.coalesce("rows", F.array()).alias("rows")).write.parquet(f"{self.root}/{name}")
        until = self.spark.sql(f"SELECT date_format(timestamp'{now}' + interval {self.ttl} seconds, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")").first()[0]
        batch = {"name": name, "version": version, "tag": tag, "until": until, "result": json.loads(kept.json())}
        for _ in range(20):
            number, state = self.states.last()
            held = (state or {"batches": []})["batches"]
            try:
                self.states.commit(number, {"batches": [b for b in held if b["until"] > now] + [batch]})
                break
            except Conflict:
                continue  # another search stored its batch meanwhile: both count
        return self._stored([*batches, batch], kept)

    def invalidate(self) -> None:
        """Forget all results, of whatever version."""
        number, state = self.states.last()
        if state and state["batches"]:
            self.states.commit(number, {"batches": []})

    def swept(self, now: str) -> int:
        """Delete the files of batches that no later search can read; their number."""
        from ..scratch import listed

        _, state = self.states.last()
        kept = {b["name"] for b in (state or {"batches": []})["batches"] if b["until"] > now}
        old = [n for n in listed(self.root) if n.startswith("batch-") and n not in kept]
        for name in old:
            delete(f"{self.root}/{name}")
        return len(old)
