"""Hybrid retrieval over batches of queries: inverted index, BM25, vectors, rank fusion, cascade, post-filters.

A batch of queries is a table (qid, text), so one job answers all of it. Scores are rounded to nine places before
ranking and ties go by id: results do not depend on the order of sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import on_workers
from ..config import GRAPH_RELATIONS, INSTRUCTION_HINTS, ROUTER_FAST, ROUTER_FUZZY, ROUTER_ID, ROUTER_TOOLS, Search
from ..functions.extract import asked_window, explicit_date
from ..functions.lifecycle import grade_of, instant, quality_of
from ..functions.text import contains_any, first_place, overlap, tokens
from ..scratch import dropped, saved
from .contradictions import greedy_contradictions
from .graphs import heaviest, within_days
from .index import TextIndex, postings, rarity, slot, weight
from .scoring import Best, by_entry, frequencies
from .vectors import VectorIndex

#: A batch of queries is broadcast only up to so many rows; beyond, the plain join is left to the optimiser.
BROADCAST_QUERIES = 50_000
#: Query vectors sent to the executors at once; more are taken in blocks, each a pass over the entries.
QUERY_BLOCK = 4096
#: Postings that a query reads, lists of greatest bounds first, before it asks what else can matter.
FIRST = 50_000
#: Scores are rounded to nine places and summed in any order: what lies this little below a floor still counts.
BELOW = 1e-6
#: Lists of all queries of a batch up to this number are told to the plan by value.
TOLD_LISTS = 20_000
#: Postings that the queries of a batch ask for, each for itself, up to which lists are opened; beyond, every entry is scored where its row stands.
BY_LISTS = 1_000_000


def checked_broadcast(small: DataFrame, limit: int = BROADCAST_QUERIES) -> DataFrame:
    """small, marked for broadcast if a count proves it to be small."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def _parts(found: DataFrame) -> DataFrame:
    """Summed scores (qid, id, note, full, and other keys) of postings with their term's frequencies; not rounded."""

    def part(tf: str, df: str) -> Column:
        return rarity(F.col("docs"), F.col(df)) * weight(F.col(tf), F.col("dl"), F.col("avgdl"))

    keys = [c for c in ("qid", "id", "segment") if c in found.columns]
    return found.groupBy(*keys).agg(F.sum(F.when(F.col("tf_note") > 0, part("tf_note", "df_note"))).alias("note"), F.sum(part("tf_full", "df_full")).alias("full"))


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select("qid", "id", F.round("note", 9).alias("note"), F.round("full", 9).alias("full"))


def bm25(queries: DataFrame, store: DataFrame | TextIndex, track: str | None = None) -> DataFrame:
    """(qid, id, note, full): BM25 of the summary and of both fields; null where the scope has no hit. Every entry that holds an asked term is scored.

    With a stored index only the asked terms' postings are read. Without, a store is cut into terms here: for stores that are searched
    once. Only the postings of asked terms are kept before anything is joined.
    """
    terms = query_terms(queries)
    distinct = terms.select("term").distinct()
    if isinstance(store, TextIndex):
        if (frequency := many_matches(terms, store, track)) is not None:
            return by_entry(terms, store, frequency, track)
        found = store.hits(distinct, track)
    else:
        store = store if track is None else store.where(F.col("memory_track") == track)
        lengths = store.select((F.size(tokens(F.col("summary"))) + F.size(tokens(F.col("content")))).alias("dl")).agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))
        hits = postings(store).join(checked_broadcast(distinct), "term", "left_semi")
        frequency = hits.groupBy("term").agg(F.count("*").alias("df_full"), F.count(F.when(F.col("tf_note") > 0, 1)).alias("df_note"))
        found = hits.join(frequency, "term").crossJoin(F.broadcast(lengths))  # one row
    return _rounded(_parts(found.join(checked_broadcast(terms), "term")))


def many_matches(terms: DataFrame, index: TextIndex, track: str | None = None) -> DataFrame | None:
    """The frequencies of the terms of queries (qid, term) that ask for more postings than are worth a shuffle; None for others. An index with repeated ids is read by its lists,
    which add up what one id has."""
    if not index.segments or any(s.get("repeated") for s in index.segments.values()):
        return None
    own = saved(frequencies(terms.select("term"), index, track), "frequencies")
    if (terms.join(own, "term").agg(F.sum("df_full")).first()[0] or 0) > BY_LISTS:
        return own
    dropped(own)
    return None


def top_bm25(queries: DataFrame, store: DataFrame | TextIndex, k: int, track: str | None = None, places: int = 9) -> DataFrame:
    """(qid, id, full) of rows that can be among a query's k best by full score, ties by id: the reader ranks and cuts them. Of a large batch each task passes on its own best alone."""
    terms = query_terms(queries)
    if isinstance(store, TextIndex) and (frequency := many_matches(terms, store, track)) is not None:
        return by_entry(terms, store, frequency, track, k, places=places).select("qid", "id", "full")
    return bm25(queries, store, track).select("qid", "id", F.round("full", places).alias("full"))


def best_bm25(queries: DataFrame, index: TextIndex, cfg: Search, track: str | None = None, first: int = FIRST) -> DataFrame:
    """(qid, id, note, full) as :func:`bm25` has them, but only of entries that the cascade can still take.

    Each query first reads its lists of greatest bounds, ``first`` postings of summaries and as many of contents. Most queries are answered by that: nothing else is left to read. For the others the
    entries found are scored in full; the score of the last one that the cascade would take is a floor. A list can then be passed over if no entry of it
    reaches the floor even with the greatest weights of all other terms, and a term altogether if it reaches none together with all lesser terms: frequent words
    are looked up for the entries that remain, a block for each, and never read through.

    A batch that asks for very many postings is scored entry by entry (:func:`by_entry`), and each task passes on its best.
    """
    spark = queries.sparkSession
    terms = query_terms(queries)
    if (frequency := many_matches(terms, index, track)) is not None:  # what lists could pass over is less than what a shuffle of the rest costs
        return saved(by_entry(terms, index, frequency, track, max(cfg.candidates, cfg.backfill, cfg.top_k), notes=True), "best-scores")
    asked = index.asked(terms.select("term"))
    docs, avgdl = index._stats(track)
    lists = index.lists(asked, track)
    by = Window.partitionBy("qid")
    ahead = lambda top, n: F.coalesce(F.sum(n).over(by.orderBy(F.desc(top), "term", "cls").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) < first
    wanted = terms.join(lists, "term").withColumn("_bare", F.col("n") - F.col("n_note"))
    wanted = wanted.withColumn("first", ((F.col("n_note") > 0) & ahead("top_note", "n_note")) | ((F.col("_bare") > 0) & ahead("top_body", "_bare")))
    told = wanted.limit(TOLD_LISTS + 1).collect()
    if len(told) <= TOLD_LISTS:  # few lists: the driver knows them, and they are sent along with the plan
        kept, small = spark.createDataFrame(told, wanted.schema), F.broadcast
        rest_of_lists = [r for r in told if not r["first"]]
    else:
        kept, small = saved(wanted, "asked-lists"), checked_broadcast
        rest_of_lists = kept.where("not first").limit(1).collect()
    wanted = kept
    corpus = {"docs": F.lit(docs), "avgdl": F.lit(avgdl)}

    def read(chosen: DataFrame) -> DataFrame:
        """Summed parts of some lists' postings."""
        chosen = chosen.select("qid", "term", "cls", "df_full", "df_note")
        return _parts(index.opened(index.blocks(asked, track).join(small(chosen), ["term", "cls"])).withColumns(corpus))

    begun = read(wanted.where("first"))
    if not rest_of_lists:
        return _rounded(begun)
    more = saved(wanted.where("not first").select("qid").distinct(), "asked-more")
    begun = saved(begun.join(checked_broadcast(more).withColumn("_more", F.lit(True)), "qid", "left"), "first-scores")

    def looked_up(entries: DataFrame) -> DataFrame:
        """Full scores of (qid, id, segment), a block a term and entry."""
        words = wanted.select("qid", "term", "df_full", "df_note").distinct()
        asked_for = entries.select("qid", "id", "segment").join(checked_broadcast(words), "qid").withColumn("slot", slot(F.col("id"), index.slots(F.col("segment"))))
        found = index.blocks(asked, track).join(asked_for, ["segment", "term", "slot"])
        own = F.filter("postings", lambda p: p["id"] == F.col("id"))
        return _parts(found.withColumn("p", F.explode(own)).select("qid", "id", "term", "df_full", "df_note", "p.tf_note", "p.tf_full", "p.dl").withColumns(corpus))

    open_ = begun.where("_more").drop("_more")
    most, bare = 2 * cfg.candidates, F.col("note").isNull()
    place = F.row_number().over(Window.partitionBy("qid", bare).orderBy(F.desc(F.coalesce("note", "full")), "id"))
    known = saved(looked_up(open_.withColumn("_n", place).where(F.col("_n") <= most)), "known-scores")
    floors = floor_scores(known, cfg)
    # each term's bounds, least first: a term whose bound and all lesser ones stay below the floor finds nothing of its own
    tops = wanted.groupBy("qid", "term").agg(F.max("top_body").alias("body"), F.max("top_note").alias("note"))
    up = lambda c: F.sum(c).over(by.orderBy(c, "term").rowsBetween(Window.unboundedPreceding, 0))
    tops = tops.join(checked_broadcast(more), "qid", "left_semi").withColumns({"up_body": up("body"), "up_note": up("note"), "all_body": F.sum("body").over(by), "all_note": F.sum("note").over(by)})
    judged = wanted.join(tops, ["qid", "term"]).join(floors, "qid", "left")
    needed, scopes = F.lit(False), {"note": "note", "body": "full"}
    for scope in scopes:
        floor = F.coalesce(f"floor_{scope}", F.lit(0.0)) - BELOW
        needed = needed | ((F.col(f"top_{scope}") > 0) & (F.col(f"up_{scope}") >= floor) & (F.col(f"all_{scope}") - F.col(scope) + F.col(f"top_{scope}") >= floor))
    judged = saved(judged.withColumn("needed", needed), "judged-lists")
    rest = judged.groupBy("qid", "term").agg(*[F.max(F.when(~F.col("needed"), F.col(f"top_{c}"))).alias(c) for c in scopes])
    rest = rest.groupBy("qid").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"rest_{c}") for c in scopes])
    found = read(judged.where("needed")).join(checked_broadcast(rest), "qid").join(floors, "qid", "left")
    reach = lambda scope, own: F.coalesce(F.col(own), F.lit(0.0)) + F.col(f"rest_{scope}") >= F.coalesce(f"floor_{scope}", F.lit(0.0)) - BELOW
    final = looked_up(found.where(reach("note", "note") | (F.col("note").isNull() & reach("body", "full"))))
    return saved(_rounded(begun.where("_more is null")).unionByName(_rounded(final)), "best-scores")


def floor_scores(known: DataFrame, cfg: Search) -> DataFrame:
    """(qid, floor_note, floor_body): what an entry must reach at least to be taken by the cascade, told by fully scored entries of the query.

    Entries with a note score are ranked by it; the others only count where the cascade fills up from them. 0 where too few are known, infinite where none is asked for.
    """
    by = Window.partitionBy("qid")
    stats = known.withColumns({"n_note": F.count("note").over(by), "best": F.max("note").over(by)})
    stats = stats.withColumns({"_n": F.row_number().over(by.orderBy(F.desc_nulls_last("note"))), "_f": F.row_number().over(Window.partitionBy("qid", F.col("note").isNull()).orderBy(F.desc("full")))})
    closed = (F.col("n_note") >= cfg.top_k) & (F.col("best") >= cfg.note_score)
    most = F.when(F.col("n_note") > 0, cfg.backfill).otherwise(cfg.candidates)
    return stats.groupBy("qid").agg(
        F.coalesce(F.max(F.when((F.col("_n") == cfg.candidates), F.col("note"))), F.lit(0.0)).alias("floor_note"),
        F.when(F.bool_or(closed), F.lit(float("inf"))).otherwise(F.coalesce(F.max(F.when(F.col("note").isNull() & (F.col("_f") == most), F.col("full"))), F.lit(0.0))).alias("floor_body"),
    )


def ranked(df: DataFrame, *order: Column, limit: int | None = None, by: str = "qid", name: str = "rank0") -> DataFrame:
    """0-based rank within a query, rows beyond the limit cut (a window group limit, before the full sort)."""
    out = df.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    out = out if limit is None else out.where(F.col("_rn") <= limit)
    return out.withColumn(name, (F.col("_rn") - 1).cast("long")).drop("_rn")


def cascade(scores: DataFrame, cfg: Search) -> DataFrame:
    """Note-first channel (qid, id, score, rank0, label).

    Hits in summaries stand first; if they are fewer than top_k or the best is weak, up to ``backfill`` other hits follow;
    without any, all hits stand by their full score.
    """
    by = Window.partitionBy("qid")
    stats = scores.withColumn("n_note", F.count("note").over(by)).withColumn("best", F.max("note").over(by))
    note = F.col("note").isNotNull()
    short = (F.col("n_note") < cfg.top_k) | (F.col("best") < cfg.note_score)
    staged = stats.withColumn("stage", F.when(note, 0).otherwise(1)).withColumn("score", F.coalesce("note", "full"))
    staged = staged.withColumn("_in", F.row_number().over(Window.partitionBy("qid", "stage").orderBy(F.desc("score"), "id")))
    most = F.when(F.col("stage") == 0, cfg.candidates).when(F.col("n_note") == 0, cfg.candidates).when(short, cfg.backfill).otherwise(0)
    label = F.when(F.col("n_note") == 0, "ep_backfill_empty").when(short, "ep_backfill").otherwise("note_only")
    # ranks are places in the channel's own list, after its cuts
    return ranked(staged.where(F.col("_in") <= most), F.col("stage"), F.desc("score"), F.col("id")).select("qid", "id", "score", "rank0", label.alias("label"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _query_blocks(query_vectors: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """(qids, matrix) of a stated query set in blocks small enough to send to every executor."""
    ids, rows, asked = [], [], query_vectors.select("qid", "qvec").where("qid is not null and qvec is not null")
    few = asked.limit(QUERY_BLOCK + 1).collect()
    for r in few if len(few) <= QUERY_BLOCK else asked.toLocalIterator():  # most batches are one block, and so one job
        ids.append(r["qid"])
        rows.append(r["qvec"])
        if len(ids) == QUERY_BLOCK:
            yield ids, np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield ids, np.array(rows, np.float64)


def vectors(query_vectors: DataFrame, entry_vectors: DataFrame, cfg: Search) -> DataFrame:
    """Vector channel (qid, id, score, rank0): exact inner products of a stated query set against all rows.

    Entries stream past a block of queries as matrix products; a task passes on each query's best candidates once, at its end, so the
    shuffle holds tasks x queries x candidates rows at most, whatever the session's batch size.
    """
    on_workers(entry_vectors.sparkSession)
    spark, kinds = entry_vectors.sparkSession, dict(query_vectors.dtypes) | dict(entry_vectors.dtypes)
    schema, scored = f"qid {kinds['qid']}, id {kinds['id']}, score double", None
    for ids, matrix in _query_blocks(query_vectors):
        held = spark.sparkContext.broadcast((np.array(ids), matrix))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            qids, queries = held.value
            best = Best(len(qids), cfg.candidates)
            for pdf in batches:
                pdf = pdf[pdf["vec"].notna()]
                for at in range(0, len(pdf), 4096):
                    part = pdf.iloc[at : at + 4096]
                    best.add(part["id"].to_numpy(), np.round(np.stack(part["vec"].to_numpy()).astype(np.float64) @ queries.T, 9) + 0.0)
            col, found, score = best.cut()
            yield pd.DataFrame({"qid": qids[col], "id": found, "score": score})

        part = entry_vectors.select("id", "vec").mapInPandas(run, schema)
        scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        scored = spark.createDataFrame([], schema)
    return ranked(scored, F.desc("score"), F.col("id"), limit=cfg.candidates)


def gap_gate(channel: DataFrame) -> DataFrame:
    """Relative gate: 3 rows if the top ten lie close together, 5 if the top five do, else 10."""
    by = Window.partitionBy("qid").orderBy("rank0").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = F.first("score").over(by)
    fifth = F.coalesce(F.nth_value("score", 5).over(by), F.last("score").over(by))
    tenth = F.coalesce(F.nth_value("score", 10).over(by), F.last("score").over(by))
    keep = F.when(top - tenth < 0.02, 3).when(top - fifth < 0.05, 5).otherwise(10)
    return channel.withColumn("keep", keep).where(F.col("rank0") < F.col("keep"))


def fused(channels: dict[str, DataFrame], store: DataFrame, cfg: Search, top_k: int | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion with a confidence boost: (qid, id, score, rank0, channels).

    A query that one channel alone answers keeps that channel's scores and order.
    """
    on_workers(store.sparkSession)  # a union is grouped
    parts = None
    for name, channel in channels.items():
        w = cfg.weights.get(name, 1.0)
        if w <= 0:
            continue
        part = channel.select("qid", "id", "score", "rank0", F.lit(name).alias("channel"), (1.0 / (cfg.rrf_k + F.col("rank0") / w + 1)).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    names = [n for n in channels if cfg.weights.get(n, 1.0) > 0]
    flags = [F.max(F.when(F.col("channel") == n, 1).otherwise(0)).alias(f"_is{i}") for i, n in enumerate(names)]
    sums = parts.groupBy("qid", "id").agg(F.sum("part").alias("rrf"), F.max("score").alias("raw"), F.min("rank0").alias("own_rank"), *flags)
    by = Window.partitionBy("qid")
    used = [F.max(f"_is{i}").over(by) for i in range(len(names))]
    sums = sums.withColumn("n_channels", sum(used[1:], used[0]).cast("long")).withColumn("only", F.coalesce(*[F.when(u == 1, F.lit(n)) for u, n in sorted(zip(used, names, strict=True), key=lambda x: x[1])]))
    sums = sums.join(store.select("id", "confidence"), "id")
    boosted = F.round(F.col("rrf") * (1 + cfg.confidence_boost * F.coalesce(F.when(F.col("confidence") != 0, F.col("confidence")), F.lit(cfg.default_confidence))), 9)
    single = F.col("n_channels") == 1
    scored = sums.select("qid", "id", F.when(single, F.col("raw")).otherwise(boosted).alias("score"), F.when(single, F.col("own_rank")).otherwise(0).alias("_o"), "n_channels", "only")
    return ranked(scored, F.col("_o"), F.desc("score"), F.col("id"), limit=top_k or cfg.top_k).drop("_o")


def forgotten(hits: DataFrame, store: DataFrame, access: DataFrame, cfg: Search) -> DataFrame:
    """Scores of old entries without a recent access times the forgetting factor; ranks anew."""
    now = F.lit(cfg.now).cast("timestamp")
    active = access.where(F.col("accessed_at") >= now - F.expr(f"interval {cfg.forget_days} days")).select(F.col("entry_id").alias("id")).distinct().withColumn("_active", F.lit(True))
    aged = hits.join(store.select("id", instant(F.col("created_at")).alias("_born")), "id", "left").join(active, "id", "left")
    old = F.col("_active").isNull() & (F.col("_born") < now - F.expr(f"interval {cfg.forget_age_days} days"))
    out = aged.withColumn("score", F.when(old, F.round(F.col("score") * cfg.forget_factor, 9)).otherwise(F.col("score"))).drop("_born", "_active", "rank0")
    return ranked(out, F.desc("score"), F.col("id"))


def is_valid(now: str) -> Column:
    """Neither deprecated nor expired."""
    return (F.coalesce("deprecated", F.lit(0)) == 0) & ((F.coalesce("expires_at", F.lit("")) == "") | (F.col("expires_at") >= now))


def or_unfiltered(hits: DataFrame, cfg: Search) -> DataFrame:
    """Of valid rows with one summary_hash the latest stays, at the group's best rank; rows without a hash all stay.

    A query that would lose all its rows keeps its best one. One pass, no join back.
    """
    own = F.when(F.coalesce("summary_hash", F.lit("")) == "", F.concat(F.lit("#"), F.col("id"))).otherwise(F.col("summary_hash"))
    valid, w, q = is_valid(cfg.now), Window.partitionBy("qid", own), Window.partitionBy("qid")
    flagged = hits.withColumn("_ok", valid).withColumn("_first", F.min(F.when(F.col("_ok"), F.col("rank0"))).over(w))
    newest = Window.partitionBy("qid", own, "_ok").orderBy(F.desc("timestamp"), "id")
    flagged = flagged.withColumn("_n", F.row_number().over(newest)).withColumn("_some", F.bool_or("_ok").over(q))
    kept = flagged.where((F.col("_ok") & (F.col("_n") == 1)) | (~F.col("_some") & (F.col("rank0") == 0)))
    return ranked(kept.drop("rank0"), F.coalesce("_first", F.lit(0)), F.col("id")).drop("_ok", "_first", "_n", "_some")


def graph_channel(seeds: DataFrame, edges: DataFrame, store: DataFrame, cfg: Search) -> DataFrame:
    """Graph channel (qid, id, score, rank0): the heaviest neighbours of a query's first results that are none of them nor near copies of one.

    Each seed's few heaviest neighbours are settled once for all queries that it serves.
    """
    near = heaviest(seeds.select("id").distinct(), edges, cfg.graph_per_seed, GRAPH_RELATIONS)
    found = seeds.select("qid", F.col("id").alias("seed")).join(near, "seed").groupBy("qid", "id").agg(F.max("weight").alias("score")).where(F.col("score") >= cfg.graph_gate)
    found = found.join(seeds.select("qid", "id"), ["qid", "id"], "left_anti")
    mark = store.select("id", F.substring("summary_hash", 1, 8).alias("_mark"))
    copies = seeds.select("qid", "id").join(mark, "id").where("_mark <> ''").select("qid", "_mark").distinct()
    found = found.join(mark, "id").join(copies, ["qid", "_mark"], "left_anti")
    return ranked(found.select("qid", "id", "score"), F.desc("score"), F.col("id"), limit=cfg.graph_top)


def time_channel(dated: DataFrame, store: DataFrame, cfg: Search) -> DataFrame:
    """Time channel (qid, id, score, rank0) of queries (qid, t1): entries whose event date is near.

    The score falls with the days between, so of each day only the first few entries can be among a query's: they are settled before the join.
    """
    days = ranked(store.where("event_date is not null").select("id", "event_date"), F.col("id"), limit=cfg.time_top, by="event_date").drop("rank0")
    near = within_days(dated, days, "t1", "event_date", cfg.time_days)
    score = F.round(0.05 + 0.85 * F.greatest(F.lit(0.0), 1 - F.abs(F.datediff("event_date", "t1")) / F.lit(float(cfg.time_days))), 9)
    return ranked(near.select("qid", "id", score.alias("score")), F.desc("score"), F.col("id"), limit=cfg.time_top)


def window_channel(asked: DataFrame, store: DataFrame, cfg: Search) -> DataFrame:
    """Time channel (qid, id, score, rank0) of questions (qid, text, t1, t2) that name days: the latest entries of the window, by their distance from its first day and the
    share of the question's words that they hold.

    Of each day only the first few entries can be among a window's, so they are settled once; a window meets its days by equality, and texts are read for what remains.
    Days that do not exist name no window.
    """
    w = asked.select("qid", "text", F.try_to_date("t1").alias("_first"), F.try_to_date("t2").alias("_last")).where("_first <= _last")
    days = ranked(store.where("event_date is not null").select("id", "event_date"), F.col("id"), limit=cfg.time_top, by="event_date").drop("rank0")
    each = w.select("qid", "_first", "_last", F.explode(F.sequence("_first", "_last")).alias("event_date")).join(days, "event_date")
    top = ranked(each, F.desc("event_date"), F.col("id"), limit=cfg.time_top).drop("rank0")
    words = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([\x{4e00}-\x{9fff}]{2,}|[\p{L}\p{N}_]+)"), 1))
    whole = F.concat(F.coalesce("summary", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
    wide = top.join(w.select("qid", words.alias("_words")), "qid").join(store.select("id", whole.alias("_whole")), "id")
    held = F.size(F.filter("_words", lambda t: F.contains(F.col("_whole"), t))) / F.greatest(F.size("_words"), F.lit(1))
    near = F.greatest(F.lit(0.0), 1 - F.datediff("event_date", "_first") / F.greatest(F.datediff("_last", "_first"), F.lit(1)))
    return ranked(wide.select("qid", "id", F.round(0.05 + 0.85 * near + 0.10 * held, 9).alias("score")), F.desc("score"), F.col("id"))


def instruction_tail(hits: DataFrame, *order: Column, top_k: int, hints: tuple[str, ...] = INSTRUCTION_HINTS) -> DataFrame:
    """Hits (qid, text of the query, type, confidence, ...) with a rank0: where a query asks for rules, sure instructions go behind all others and the cut
    grows by their number. Other queries' hits keep their order and cut."""
    tail = contains_any(F.coalesce("text", F.lit("")), hints) & (F.col("type") == "instruction") & (F.col("confidence") > 0.9)
    out = ranked(hits.withColumn("_tail", F.coalesce(tail, F.lit(False)).cast("int")), F.col("_tail"), *order)
    return out.withColumn("_extra", F.sum("_tail").over(Window.partitionBy("qid"))).where(F.col("rank0") < F.col("_extra") + top_k).drop("_tail", "_extra")


def search(
    queries: DataFrame, store: DataFrame, access: DataFrame, query_vectors: DataFrame | None, entry_vectors: DataFrame | VectorIndex | None, cfg: Search, index: TextIndex | None = None, edges: DataFrame | None = None, track: str | None = None
) -> DataFrame:
    """The retrieval chain for a batch: one row for each query and rank.

    Cascade and vectors are fused and cut; then forgetting, validity and versions, the fall-back for emptied queries, and for queries without
    any hit the latest entries. Wide columns join after the cut, and grades come from each query's best score. Settings switch on more
    of it: the router (queries that it is sure of skip the vectors), the gap gate, the time and graph channels, contradictions, instructions behind the rest, a second ranking by shared words.
    A track, which the store is cut to already, tells the index which lists to read.
    """
    fts = cascade(best_bm25(queries, index, cfg, track) if index is not None else bm25(queries, store), cfg)
    channels = {"fts": fts}
    if query_vectors is not None:
        deep = queries
        if cfg.router:
            # a query that the router is sure of goes without vectors, if what the words alone find is good enough
            channels["fts"] = fts = saved(fts, "channel-fts")
            good = fts.groupBy("qid").agg(F.max("score").alias("_best")).where(F.col("_best") >= cfg.soft_line)
            kind, _ = route(F.col("text"))
            deep = queries.join(queries.where(kind != "dual").join(good, "qid", "left_semi").select("qid"), "qid", "left_anti")
        asked = query_vectors.join(deep.select("qid"), "qid", "left_semi")
        emb = entry_vectors.search(asked, cfg.candidates, cfg.probes) if isinstance(entry_vectors, VectorIndex) else vectors(asked, entry_vectors, cfg)
        channels["emb"] = gap_gate(emb).drop("keep") if cfg.gate else emb
    if cfg.time:
        # a question of one day looks around it, one of several days into the window that they span
        first, last = asked_window(F.col("text"))
        dated = queries.select("qid", "text", first.alias("t1"), last.alias("t2"), explicit_date(F.col("text")).alias("day"))
        wide = F.coalesce(F.col("t1") < F.col("t2"), F.lit(False))
        around = time_channel(dated.where(~wide & F.col("day").isNotNull()).select("qid", F.col("day").alias("t1")), store, cfg)
        channels["time"] = around.unionByName(window_channel(dated.where(wide), store, cfg))
    if (cfg.graph and edges is not None) or cfg.instructions:
        channels = {name: saved(channel, f"channel-{name}") for name, channel in channels.items()}  # each is read more than once
    if cfg.graph and edges is not None:
        channels["graph"] = graph_channel(fused(channels, store, cfg, cfg.graph_seeds).select("qid", "id"), edges, store, cfg)
    if cfg.instructions:
        every = fused(channels, store, cfg, len(channels) * (cfg.candidates + cfg.backfill)).join(queries.select("qid", "text"), "qid")
        hits = instruction_tail(every.join(store.select("id", "type", "confidence"), "id").withColumnRenamed("rank0", "_r"), F.col("_r"), top_k=cfg.top_k).drop("_r", "text", "type", "confidence")
    else:
        hits = fused(channels, store, cfg, cfg.rerank_pool if cfg.rerank else None)
    alone = F.create_map(*[F.lit(x) for pair in (("fts", "fts_only"), ("emb", "embed_only"), ("time", "time_only"), ("graph", "graph_only")) for x in pair])
    hits = hits.withColumn("mode", F.when(F.col("n_channels") == 1, alone[F.col("only")]).otherwise("dual_rrf")).drop("n_channels", "only")
    for name, label in (("time", "_time4th"), ("graph", "_graph")):
        if name in channels:
            used = channels[name].select("qid").distinct().withColumn("_used", F.lit(label))
            hits = hits.join(used, "qid", "left").withColumn("mode", F.when(F.col("mode").endswith("_only"), F.col("mode")).otherwise(F.concat("mode", F.coalesce("_used", F.lit(""))))).drop("_used")
    hits = forgotten(hits, store, access, cfg)
    wide = hits.join(store.select("id", "summary", "summary_hash", "timestamp", "deprecated", "expires_at", "type", *(["content", "confidence"] if cfg.contradictions else [])), "id")
    kept = or_unfiltered(wide, cfg)
    if cfg.contradictions:
        kept = ranked(greedy_contradictions(kept), F.col("rank0"), F.col("id"))
    if cfg.rerank:
        kept = reranked(kept, queries, cfg.top_k)
    fields = ["id", "score", "mode", "summary", "type", "rank0"]
    row = F.struct(*fields)
    latest = store.orderBy(F.desc("timestamp"), "id").limit(cfg.top_k)  # top_k rows come to one task
    latest = latest.withColumn("rank0", F.row_number().over(Window.orderBy(F.desc("timestamp"), "id")).cast("long") - 1)
    latest = latest.select("id", F.lit(0.0).alias("score"), F.lit("time_desc").alias("mode"), "summary", "type", "rank0").agg(F.collect_list(row).alias("_latest"))
    every = queries.select("qid").join(kept.select("qid", *fields), "qid", "left").crossJoin(F.broadcast(latest))
    kept = every.select("qid", F.explode(F.when(F.col("id").isNull(), F.col("_latest")).otherwise(F.array(row))).alias("r")).select("qid", "r.*")
    return graded(kept, cfg).select("qid", F.col("rank0").alias("rank"), "id", "score", "mode", "type", compact(F.col("summary")).alias("summary"), "quality", "grade", "weak_match")


def reranked(hits: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """A query's hits by the share of words that question and summary have in common, then as they stood; the first top_k stay, and their mode tells."""
    asked = queries.select("qid", F.array_distinct(tokens(F.col("text"))).alias("_asked"))
    shared = F.round(overlap(F.col("_asked"), F.array_distinct(tokens(F.col("summary")))), 6)
    placed = hits.join(asked, "qid").withColumn("_shared", shared).withColumnRenamed("rank0", "_r")
    return ranked(placed, F.desc("_shared"), F.col("_r"), F.col("id"), limit=top_k).withColumn("mode", F.concat("mode", F.lit("_rerank"))).drop("_asked", "_shared", "_r")


def compact(summary: Column) -> Column:
    return F.when(F.length(summary) > 50, F.concat(F.substring(summary, 1, 50), F.lit("…"))).otherwise(summary)


def graded(hits: DataFrame, cfg: Search) -> DataFrame:
    """quality and grade of each query, and weak_match of each row, on one scale for all modes."""
    scale = F.when(F.col("mode").startswith("fts_only"), F.col("score") / cfg.fts_scale).otherwise(F.col("score")) * cfg.weight_factor
    best = F.max("_norm").over(Window.partitionBy("qid"))
    fallback = F.col("mode") == "time_desc"
    out = hits.withColumn("_norm", F.round(scale, 9))
    return out.withColumn("quality", F.when(fallback, "weak").otherwise(quality_of(best, cfg))).withColumn("grade", grade_of(best, fallback, cfg)).withColumn("weak_match", fallback | (F.col("_norm") < cfg.quality[1])).drop("_norm")


def route(text: Column) -> tuple[Column, Column]:
    """(mode, confidence) of a query text by the earliest strong and fuzzy words."""
    q = F.trim(F.coalesce(text, F.lit("")))
    found = F.regexp_extract(q, f"({ROUTER_ID})", 1)
    anchor = found != ""
    fast = first_place(q, ROUTER_FAST)
    anchored = anchor | fast.isNotNull()
    places = F.array_compact(F.array(F.when(anchor, F.call_function("locate", found, q) - 1), fast, F.when(anchored, first_place(q, ROUTER_TOOLS))))
    strong, fuzzy = F.array_min(places), first_place(q, ROUTER_FUZZY)
    mode = F.when(q == "", "dual").when(~q.rlike("[A-Za-z0-9]"), "fts").when(strong.isNotNull() & (fuzzy.isNull() | (strong < fuzzy)), "fts").when(fuzzy.isNotNull(), "dual").otherwise("dual")
    sure = F.when(q == "", 0.5).when(~q.rlike("[A-Za-z0-9]"), 0.8).when(strong.isNotNull() & (fuzzy.isNull() | (strong < fuzzy)), 0.9).when(fuzzy.isNotNull(), 0.85).otherwise(0.5)
    return mode, sure
