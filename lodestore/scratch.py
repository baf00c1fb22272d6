"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from . import on_workers

#: Rows of one Arrow batch of texts: a batch of long texts, as Python objects, must fit beside the JVM in an executor.
BATCH_ROWS = 512

_made: set[str] = set()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Python over whole texts can import the package, and takes small Arrow batches while the block runs: the session's own setting comes back."""
    on_workers(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(rows)
    if 0 < int(own) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(rows, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(rows, own)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode a temporary one set here."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="lodestore-")
    spark.sparkContext.setCheckpointDir(base)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _folder(path: str):
    jvm, active = SparkContext._jvm, SparkContext._active_spark_context
    conf = active._jsc.hadoopConfiguration() if active is not None else jvm.org.apache.hadoop.conf.Configuration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(conf), where


def delete(path: str) -> None:
    """Delete a folder of the shared file system."""
    system, where = _folder(path)
    system.delete(where, True)


def listed(path: str) -> list[str]:
    """Names in a folder of the shared file system."""
    system, where = _folder(path)
    return [x.getPath().getName() for x in system.listStatus(where)]


@atexit.register
def _tidy() -> None:
    for path in list(_made):
        try:
            delete(path)
        except Exception:  # the JVM has ended: nothing can be deleted through it
            break


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/lodestore-{name}-{uuid.uuid4().hex[:12]}"
    _made.add(path)
    return path


def exists(path: str) -> bool:
    """Whether there is such a file or folder."""
    system, where = _folder(path)
    return system.exists(where)


def renamed(path: str, to: str) -> None:
    """Give a folder of the shared file system its place, unless another stands there by now: then it is deleted."""
    system, where = _folder(path)
    target = _folder(to)[1]
    system.mkdirs(target.getParent())
    if system.exists(target) or not system.rename(where, target):
        system.delete(where, True)


def state_of(path: str) -> tuple[int, int]:
    """Bytes of a file or folder and when it was last changed: tells whether what was made from it still holds."""
    system, where = _folder(path)
    return system.getContentSummary(where).getLength(), system.getFileStatus(where).getModificationTime()


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet under the shared folder and read again: cuts lineage, survives lost executors.

    The table stays until the driver ends, or until :func:`dropped` is called on it. A table made here is returned as it is.
    """
    if getattr(df, "_lodestore_path", None) in _made:
        return df
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestore_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`saved` that no later step reads."""
    for t in tables:
        path = getattr(t, "_lodestore_path", None)
        if path in _made:
            _made.discard(path)
            delete(path)
