"""Connected components of a distributed edge table, by hooking to the least neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the least node that can be reached. edges: (a, b), longs; loops and repeats are allowed.

    Every round joins each node to its least neighbour, follows pointers twice, and contracts the edges;
    at least half of the nodes with edges vanish a round. All tables stay distributed; counts alone are looked at.
    """
    left = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc-edges")
    labels, scratch = None, []
    while left.limit(1).count():
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("to")))
        hook = saved(ends.groupBy("node").agg(F.least(F.min("to"), F.min("node")).alias("up")), "cc-hook")
        for _ in range(2):
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            scratch.append(hook)
            hook = saved(hook.join(above, "up").select("node", F.col("upper").alias("up")), "cc-hook")
        scratch.append(hook)
        if labels is None:
            labels = hook.select("node", F.col("up").alias("label"))
        else:
            moved = hook.select(F.col("node").alias("label"), "up")
            scratch.append(labels)
            labels = saved(labels.join(moved, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "cc-labels")
        to = hook.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        old = left
        left = left.join(to, left.a == to._n).select(F.col("_u").alias("a"), "b")
        left = left.join(to, left.b == to._n).select("a", F.col("_u").alias("b"))
        left = saved(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc-edges")
        dropped(old)
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    # Pointers end at local minima of older rounds; a last look-up resolves none further, as each round's labels were moved.
    out = saved(labels, "cc-components")
    dropped(*[t for t in scratch if t is not labels])
    return out
