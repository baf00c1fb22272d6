"""lodestore: a Spark-native knowledge retrieval and curation engine."""

from __future__ import annotations

import os
from pathlib import Path


def on_workers(spark) -> None:
    """Let Python workers import this package from the folder where the driver found it.

    Workers on the driver's machine need no PYTHONPATH then; on a cluster the package is installed or sent with --py-files,
    and a folder that does not exist there does no harm.

    Spark 4.1 takes a union of parts that are each dealt by a key to be dealt by it as a whole, but the adaptive planner may then join up each part's partitions differently:
    rows of one key stand in two tasks, and what is grouped or joined by it is wrong. So the session is told not to rely on it.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    home = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, home])
