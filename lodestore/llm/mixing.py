"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and ``max_copies``; rates are those nearest in entropy to one copy
each whose expected words meet the target of the document's source. The convex dual has one multiplier
a source; its solution is a tilted rate ``max_copies * sigmoid(base + multiplier * size / mean size)``, found by
Newton steps kept inside a bracket. Rates depend on (source, size) only, so the iterations run over the
distributed table of those pairs and their counts, never over documents. Rates become whole copies by
running rounding from the longest sizes to the shortest, then three single-size corrections a source.

Null and empty texts have size 0 and take no words. A null source is a source (last in order). Repeated rows
are documents of their own. An empty table gives an empty result. Only doc_id, text, source are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cumulated, dropped, joined_small, ranked, saved, with_row, words_pattern

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
STEPS = 48  # Newton steps at most, safeguarded by doubling up to a bracket and halving it
FAR = 2000.0  # no multiplier lies beyond
STEPS_A_TABLE = 4  # steps between two written tables, after which they end if all sources are settled
SETTLED = 1e-7  # share of a target that may be missed before copies are rounded


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space (0 for null)."""
    spaced = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(F.length(spaced), F.lit(0)) == 0, F.lit(0)).otherwise(F.regexp_count(spaced, F.lit(words_pattern()))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Target of each source (_s, _sn, source_size): shares by weight, capped, the excess shared again.

    The fixed point is a water level: target = least(cap, weight * level). Level and set of capped sources
    are settled by a few aggregates that return one row each.
    """
    order = ranked(sizes, [F.col("_sn"), F.col("_s")], "_rank")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = saved(order.select("_s", "_sn", "source_size", pick.alias("_w"), (F.col("source_size") * float(max_copies)).alias("_cap")), "mix-sources")
    level, total = 0.0, table.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    while True:
        over = F.col("_cap") < F.col("_w") * level
        x = table.agg(F.sum(F.when(over, F.col("_cap"))).alias("c"), F.sum(F.when(~over, F.col("_w"))).alias("w")).first()
        new = (total - (x["c"] or 0.0)) / x["w"] if x["w"] else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    return table.select("_s", "_sn", "source_size", F.least("_cap", F.col("_w") * level).alias("target"))


def balanced_rates(pairs: DataFrame, targets: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(_s, _sn, multiplier) that solve the dual for pairs (_s, _sn, size, _n)."""
    base = -math.log(max_copies - 1.0)  # rate 1 at multiplier 0
    table = saved(pairs.join(targets, ["_s", "_sn"]).where("size > 0").withColumn("_x", F.col("size") * F.col("_docs") / F.col("source_size")), "mix-pairs")
    full = F.col("target") >= F.col("source_size") * max_copies * (1 - 1e-9)
    state = targets.select("_s", "_sn", F.lit(0.0).alias("_m"), F.lit(-FAR).alias("_lo"), F.lit(FAR).alias("_hi"), F.lit(0.0).alias("_off"))
    for step in range(STEPS):
        rate = max_copies / (1 + F.exp(-(F.lit(base) + F.col("_m") * F.col("_x"))))
        slope = (
            table.join(state.drop("_off"), ["_s", "_sn"])
            .withColumn("_r", rate)
            .groupBy("_s", "_sn", "_m", "_lo", "_hi", "target", "source_size", "_docs")
            .agg(F.sum(F.col("_r") * F.col("_n") * F.col("size")).alias("_g"), F.sum(F.col("_r") * (1 - F.col("_r") / max_copies) * F.col("_n") * F.col("size") * F.col("_x")).alias("_h"))
        )
        over = F.col("_g") > F.col("target")
        slope = slope.withColumn("_hi", F.when(over, F.col("_m")).otherwise(F.col("_hi"))).withColumn("_lo", F.when(over, F.col("_lo")).otherwise(F.col("_m")))
        jump = F.col("_m") - (F.col("_g") - F.col("target")) / F.when(F.col("_h") > 1e-9, F.col("_h"))
        inside = (F.col("_j") > F.col("_lo")) & (F.col("_j") < F.col("_hi"))
        wide = F.when(F.col("_hi") >= FAR, F.least(F.lit(FAR), 2 * F.abs("_lo") + 1)).when(F.col("_lo") <= -FAR, F.greatest(F.lit(-FAR), -2 * F.abs("_hi") - 1)).otherwise((F.col("_lo") + F.col("_hi")) / 2)
        state = slope.withColumn("_j", jump).select("_s", "_sn", F.when(inside, F.col("_j")).otherwise(wide).alias("_m"), "_lo", "_hi", F.when(full, 0.0).otherwise(F.abs(F.col("_g") - F.col("target")) / F.greatest("target", F.lit(1.0))).alias("_off"))
        if step % STEPS_A_TABLE == STEPS_A_TABLE - 1:
            state = saved(state, "mix-state")
            if (state.agg(F.max("_off")).first()[0] or 0.0) < SETTLED:  # of the multipliers before the last step
                break
    solved = F.when(full, F.lit(float(max_copies))).otherwise(max_copies / (1 + F.exp(-(F.lit(base) + F.col("_m") * F.col("_x")))))
    return table.join(state, ["_s", "_sn"]).select("_s", "_sn", "size", "_n", "target", solved.alias("rate"))


def rounded_copies(rates: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """Whole copies _k of all documents of each (source, size), and the first rank of its documents."""
    down = Window.partitionBy("_s", "_sn").orderBy(F.col("size").desc())
    run = F.sum(F.col("rate") * F.col("_n")).over(down)
    whole = rates.withColumn("_run", F.floor(run + 0.5)).withColumn("_k", (F.col("_run") - F.coalesce(F.lag("_run").over(down), F.lit(0))).cast("long"))
    whole = saved(whole.withColumn("_k", F.greatest(F.lit(0), F.least(F.col("_n") * max_copies, F.col("_k")))), "mix-copies")
    for _ in range(3):  # one size a source takes one copy more or less: the size that leaves least
        off = whole.groupBy("_s", "_sn", "target").agg(F.sum(F.col("_k") * F.col("size")).alias("_t")).select("_s", "_sn", (F.col("target") - F.col("_t")).alias("_left"))
        with_off = whole.join(off, ["_s", "_sn"]).withColumn("_rest", F.abs(F.abs("_left") - F.col("size")))
        room = F.when(F.col("_left") > 0, F.col("_k") < F.col("_n") * max_copies).otherwise(F.col("_k") > 0)
        best = with_off.where(room & (F.col("_rest") < F.abs("_left"))).groupBy("_s", "_sn").agg(F.min_by("size", F.struct("_rest", "size")).alias("_pick"), F.first(F.signum("_left")).alias("_sign"))
        whole = saved(whole.join(best, ["_s", "_sn"], "left").withColumn("_k", F.when(F.col("size") == F.col("_pick"), F.col("_k") + F.col("_sign").cast("long")).otherwise(F.col("_k"))).drop("_pick", "_sign"), "mix-copies")
    return whole.select("_s", "_sn", "size", "_n", "_k")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, row: str | None = None) -> DataFrame:
    """Copies of every document: doc_id, size, source_size, target, taken, copies, and the column ``row`` if one is named.

    Which documents of one (source, size) get the odd copies is settled by a hash of doc_id and text, so reruns agree.
    """
    carried = [] if row in (None, "doc_id") else [row]
    sized = docs.select(
        "doc_id", word_count(F.col("text")).alias("size"), F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().cast("int").alias("_sn"),
        F.xxhash64("doc_id", "text").alias("_tie"), *carried,
    )
    sized = saved(sized, "mix-sizes")
    pairs = sized.groupBy("_s", "_sn", "size").agg(F.count("*").alias("_n"))
    pairs = saved(pairs, "mix-counts")
    sizes = pairs.groupBy("_s", "_sn").agg(F.sum(F.col("size") * F.col("_n")).cast("long").alias("source_size"), F.sum("_n").alias("_docs"))
    targets = source_targets(sizes.drop("_docs"), weights, max_copies)
    targets = saved(targets.join(sizes.drop("source_size"), ["_s", "_sn"]), "mix-targets")
    copies = rounded_copies(balanced_rates(pairs, targets, max_copies), max_copies)
    order = ranked(sized, [F.col("_sn"), F.col("_s"), F.col("size"), F.col("_tie"), F.col("doc_id"), *map(F.col, carried)], "_rank")
    starts = ranked(pairs, [F.col("_sn"), F.col("_s"), F.col("size")], "_place")
    starts = cumulated(starts)
    plan = starts.join(copies.select("_s", "_sn", "size", "_k"), ["_s", "_sn", "size"], "left").join(targets.drop("_docs"), ["_s", "_sn"])
    plan = saved(plan.select("_s", "_sn", "size", "_n", "_first", F.coalesce("_k", F.lit(0)).alias("_k"), "source_size", "target"), "mix-plan")
    each = joined_small(order, plan, ["_s", "_sn", "size"])
    place = F.col("_rank") - F.col("_first")
    copy = (F.expr("_k div _n") + F.when(place < F.expr("_k % _n"), F.lit(1)).otherwise(F.lit(0))).cast("long")
    return each.select("doc_id", *carried, "size", "source_size", "target", (copy * F.col("size")).cast("long").alias("taken"), copy.alias("copies"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it: every row for itself, rows that share a doc_id and repeated rows too."""
    rows, row = with_row(docs)
    copies = mixed(rows, weights, max_copies, row).where("copies > 0").select(row, F.col("copies").cast("int").alias("_copies"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    taken = rows.select(F.struct(*own).alias("_doc"), row).join(copies, row)
    out = taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_doc.*")
    if rows is not docs:
        out = saved(out, "mixture")
        dropped(rows)
    return out
