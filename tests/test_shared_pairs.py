"""Pairs of members that share groups, where groups are many."""

from pyspark.sql import functions as F

from lodestore.operators import graphs as G


def test_shared_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """As many tasks as pairs ask for, whatever the session coalesces."""
    monkeypatch.setattr(G, "ROWS", 50)
    monkeypatch.setattr(G, "PAIRS", 100)
    links = spark.range(600).select((F.col("id") % 40).alias("g"), F.col("id").alias("m"))
    out = G.shared_pairs(links, "g", "m")
    assert out.rdd.getNumPartitions() == 40 * 15 * 14 // 2 // 100
    assert out.count() == 40 * 15 * 14 // 2 and out.where("n <> 1 or a >= b").count() == 0
