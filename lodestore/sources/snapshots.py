"""Snapshots of a keyed table by a tree of hashes: what has not changed is neither written nor read again.

Keys are dealt to buckets; a bucket's hash is a sum over its rows, so it does not depend on their order, and the snapshot's own hash is that of its buckets. A
snapshot writes only buckets whose hash differs from the last one's, and names the folder that holds each of the others already. Going back copies
only buckets that differ from the table's present ones.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import delete
from ..versions import Versions

BUCKETS = 64


class Snapshots:
    """Snapshots under a folder, of tables with one row a key."""

    def __init__(self, spark: SparkSession, root: str, key: str = "id", buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.buckets, self.states = spark, root, key, buckets, Versions(spark, root)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def hashes(self, table: DataFrame) -> dict[int, tuple[int, str]]:
        """bucket -> (rows, hash) of a table. Columns are taken by name, so their order does not matter; nulls differ from empty texts."""
        row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(table.columns)]), {"ignoreNullFields": "false"})
        each = table.select(self._bucket().alias("bucket"), F.xxhash64(row).alias("h"), F.xxhash64(F.lit(1), row).alias("g"))
        wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
        sums = each.groupBy("bucket").agg(F.count("*").alias("n"), wide("h").alias("h"), wide("g").alias("g")).collect()  # a row a bucket
        return {r["bucket"]: (r["n"], f"{r['h']}:{r['g']}") for r in sums}

    @staticmethod
    def checksum(hashes: dict[int, tuple[int, str]]) -> str:
        """One hash of all buckets."""
        return hashlib.sha256("|".join(f"{b}={n}:{h}" for b, (n, h) in sorted(hashes.items())).encode()).hexdigest()

    def create(self, table: DataFrame, note: str, at: str) -> str:
        """Take a snapshot; its name. Buckets that the last snapshot holds alike are not written."""
        number, state = self.states.last()
        taken = state["taken"] if state else []
        before = {int(b): own for b, own in taken[-1]["buckets"].items()} if taken else {}
        now, name = self.hashes(table), uuid.uuid4().hex[:12]
        same = {b for b, own in now.items() if b in before and before[b][:2] == list(own) and taken[-1]["schema"] == table.schema.json()}
        changed = sorted(set(now) - same)
        if changed:
            table.withColumn("_bucket", self._bucket()).where(F.col("_bucket").isin(changed)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/data/{name}")
        buckets = {b: [*own, before[b][2] if b in same else name] for b, own in now.items()}
        told = {"name": name, "note": note, "at": at, "rows": sum(n for n, _ in now.values()), "checksum": self.checksum(now), "schema": table.schema.json(), "buckets": buckets}
        self.states.commit(number, {"taken": [*taken, told]})
        return name

    def _taken(self) -> list[dict]:
        _, state = self.states.last()
        return state["taken"] if state else []

    def _of(self, name: str) -> dict:
        found = next((t for t in self._taken() if t["name"] == name), None)
        if found is None:
            raise KeyError(f"no snapshot {name}")
        return found

    def list(self) -> DataFrame:
        """(name, at, note, rows, checksum, written): the snapshots, latest first; written counts the buckets that it has of its own."""
        rows = [(t["name"], t["at"], t["note"], t["rows"], t["checksum"], sum(1 for b in t["buckets"].values() if b[2] == t["name"])) for t in reversed(self._taken())]
        return self.spark.createDataFrame(rows, "name string, at string, note string, rows long, checksum string, written int")

    def read(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """A snapshot's rows, of all its buckets or of some: other buckets' folders are not opened."""
        told = self._of(name)
        schema, by_folder, out = T.StructType.fromJson(json.loads(told["schema"])), {}, None
        for b, (_, _, folder) in told["buckets"].items():
            if buckets is None or int(b) in buckets:
                by_folder.setdefault(folder, []).append(int(b))
        wide = T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType())])
        for folder, own in sorted(by_folder.items()):
            part = self.spark.read.schema(wide).parquet(f"{self.root}/data/{folder}").where(F.col("_bucket").isin(own)).drop("_bucket")
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], schema) if out is None else out

    def differing(self, name: str, table: DataFrame) -> set[int]:
        """Buckets in which a table differs from a snapshot."""
        then = {int(b): (own[0], own[1]) for b, own in self._of(name)["buckets"].items()}
        now = self.hashes(table)
        return {b for b in then.keys() | now.keys() if then.get(b) != now.get(b)}

    def restore(self, name: str, table: DataFrame, exact: bool = True) -> DataFrame:
        """A table as the snapshot has it; without ``exact``, rows that came later than it stay (an upsert).

        Rows of equal buckets are the table's own; only differing buckets are read from the snapshot.
        """
        odd = self.differing(name, table)
        bucket = self._bucket()
        kept = table.where(~bucket.isin(sorted(odd))) if odd else table
        if not odd:
            return table
        back = self.read(name, odd)
        out = kept.unionByName(back.select(*table.columns))
        if exact:
            return out
        return out.unionByName(table.where(bucket.isin(sorted(odd))).join(back.select(self.key), self.key, "left_anti").select(*table.columns))

    def changes(self, name: str, table: DataFrame) -> DataFrame:
        """(key, op): what a restore would do: insert rows that are gone, update changed ones, delete later ones."""
        odd = sorted(self.differing(name, table))
        row = lambda df: F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}))
        then = self.read(name, set(odd))
        then = then.select(self.key, row(then).alias("_then"))
        now = table.where(self._bucket().isin(odd))
        now = now.select(self.key, row(now).alias("_now"))
        op = F.when(F.col("_now").isNull(), "insert").when(F.col("_then").isNull(), "delete").when(F.col("_now") != F.col("_then"), "update")
        return then.join(now, self.key, "full").select(self.key, op.alias("op")).where("op is not null")

    def keep(self, last: int) -> list[str]:
        """Forget all but the last snapshots; files that none of those names go. Names of the forgotten."""
        number, state = self.states.last()
        taken = self._taken()
        gone, kept = taken[:-last] if last else taken, taken[-last:] if last else []
        if not gone:
            return []
        self.states.commit(number, {"taken": kept})
        named = {b[2] for t in kept for b in t["buckets"].values()}
        for t in gone:
            if t["name"] not in named and any(b[2] == t["name"] for b in t["buckets"].values()):
                delete(f"{self.root}/data/{t['name']}")
        return [t["name"] for t in gone]
