"""MinHash near-deduplication with odd sketches.

Every text's set of word shingles gives MinHash samples. Samples in bands of ``ROWS`` make candidates; all samples are
folded into a parity bitmap (an odd sketch), and the population count of two bitmaps' XOR estimates the
similarity of a candidate pair before the full sets are compared. With 40 bands of 6, a pair at 0.8 is missed
with a probability below 1e-5, one at 0.9 below 1e-13.

Texts with equal sets are one class from the start. In each bucket of a band the least document is the hub: it
is compared with all others, in as many pairs as rows. After linking, only buckets that still hold two or
more components are looked at pair by pair: in blocks, across components, on sketches and then on full sets. So a
group of thousands of near copies yields links, not squares of rows, and no link between components is lost.

Null, empty and white-space texts have an empty set and link with nothing. Rows with one doc_id are one
document: their texts' links are shared. A row with a null doc_id links with nothing and is kept. An empty table gives an
empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, joined_small, saved, tasks, with_row
from .components import components
from .line_dedup import NO_ID
from .shingles import mix, shingle_hashes

BANDS, ROWS = 40, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Estimated similarity below the threshold that still goes to the full sets: over five standard deviations.
SLACK = 0.15
#: Members of one hub, and of one side of a block of sketches, that a task holds at once.
BLOCK = 512
#: Shingles of one side of a block, so that a block of very long texts holds fewer rows.
BLOCK_SHINGLES = 1 << 19
#: Rows whose texts one task of Python is dealt.
EACH = 4 * BLOCK

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


def minhash(hashes: np.ndarray) -> np.ndarray:
    """SAMPLES minima (uint32) of a non-empty set of 64-bit hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 512):  # stays in the cache
        np.minimum(out, (_A[:, None] * x[None, at : at + 512] + _B[:, None]).min(axis=1), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + samples.reshape(BANDS, ROWS)[:, i])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> bytes:
    """Parity of the numbered samples that fall on each bit."""
    at = mix(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def sketch_similarity(odd_bits: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the population count of two sketches' XOR."""
    inside = np.maximum(1 - 2 * odd_bits / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS * np.log(inside) / (4 * SAMPLES)


def alike(both: int, a: int, b: int, percent: int) -> bool:
    """Whether two sets of a and b members, both of them common, are similar enough, in whole numbers."""
    return both > 0 and 100 * both >= percent * (a + b - both)


def _most_odd(threshold: float) -> int:
    """Largest XOR count whose estimate is still within SLACK of the threshold."""
    z = np.arange(SKETCH_BITS // 2)
    return int(z[sketch_similarity(z) >= threshold - SLACK].max())


def _signed(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                s = shingle_hashes(text, words)
                if len(s) == 0:
                    out.append((doc_id, 0, 0, 0, None, None))
                    continue
                digest = (np.add.reduce(mix(s)), np.bitwise_xor.reduce(mix(s + np.uint64(0x5851F42D4C957F2D))))
                m = minhash(s)
                out.append((doc_id, len(s), int(digest[0].astype(np.int64)), int(digest[1].astype(np.int64)), band_keys(m), odd_sketch(m)))
            yield pd.DataFrame(out, columns=["doc_id", "n", "ha", "hb", "bands", "sketch"])

    return run


def signed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, ha, hb, bands, sketch) of every document; ha and hb name its set. NO_ID stands for a null doc_id."""
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")
    return docs.select(ids, "text").mapInPandas(_signed(words), "doc_id long, n long, ha long, hb long, bands array<long>, sketch binary")


def _confirm(words: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, own = None, []  # more than one set if rows share the hub's doc_id
        for pdf in batches:
            out = []
            for a, part, b, text in zip(pdf["a"], pdf["part"], pdf["b"], pdf["text"], strict=True):
                s = shingle_hashes(text, words)
                if a == b:
                    own = [*own, s] if hub == (a, part) else [s]
                    hub = (a, part)
                    continue
                if hub != (a, part):
                    raise ValueError("a hub's own text must come before its members'")
                for mine in own:
                    if alike(len(np.intersect1d(mine, s, assume_unique=True)), len(mine), len(s), percent):
                        out.append((a, b))
                        break
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough. Members stream past their hub; hot hubs are split."""
    hot = saved(pairs.groupBy("a").agg(F.count("*").alias("_m")).where(F.col("_m") > BLOCK), "near-hot")
    parts = F.coalesce(F.ceil(F.col("_m") / BLOCK), F.lit(1))
    split = joined_small(pairs, hot, ["a"], "left").select("a", F.pmod(F.xxhash64("b"), parts).alias("part"), "b")
    split = saved(split, "near-split")
    rows = split.unionByName(split.select("a", "part", F.col("a").alias("b")).distinct())
    held = texts.select(F.col("doc_id").alias("b"), "text")
    return (
        rows.join(held, "b")
        .repartition(tasks(pairs.sparkSession, split.count(), EACH), "a", "part")
        .sortWithinPartitions("a", "part", F.col("b") != F.col("a"))
        .select("a", "part", "b", "text")
        .mapInPandas(_confirm(words, percent), "a long, b long")
    )


def _likely(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.frombuffer(b"".join(pdf["sa"]), np.uint64).reshape(len(pdf), -1)
            y = np.frombuffer(b"".join(pdf["sb"]), np.uint64).reshape(len(pdf), -1)
            yield pdf.loc[np.bitwise_count(x ^ y).sum(axis=1) <= most, ["a", "b"]]

    return run


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes and odd sketches allow the threshold."""
    a = nodes.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = nodes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    sized = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return sized.select("a", "b", "sa", "sb").mapInPandas(_likely(_most_odd(percent / 100)), "a long, b long")


def _candidates(pdf: pd.DataFrame, percent: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows of likely partners) in a block: other labels, sizes and sketches that allow the threshold.

    A pair that shares several buckets is looked at in the bucket of the first band that it shares, and nowhere else.
    """
    ids, label, n, side, band = (pdf[c].to_numpy() for c in ("doc_id", "label", "n", "side", "band"))
    words = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(len(pdf), -1)
    bands = np.stack(pdf["bands"].to_numpy())
    # side 0: a block against itself; sides 1 and 2: one block against another
    rows = np.flatnonzero(side < 2)
    cols = rows if (side == 0).all() else np.flatnonzero(side == 2)
    for i in rows:
        js = cols[(label[cols] != label[i]) & ((ids[cols] > ids[i]) | (side[i] == 1))]
        js = js[100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i])]
        js = js[np.bitwise_count(words[js] ^ words[i]).sum(axis=1) <= most]
        js = js[(bands[js] == bands[i]).argmax(axis=1) == band[i]]
        if len(js):
            yield i, js


def _open_members(percent: int):
    most = _most_odd(percent / 100)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken = np.zeros(len(pdf), bool)
        for i, js in _candidates(pdf, percent, most):
            taken[i] = True
            taken[js] = True
        return pdf.loc[taken, ["key", "doc_id"]]

    return run


def _open_links(words: int, percent: int):
    most = _most_odd(percent / 100)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, label, text = (pdf[c].to_numpy() for c in ("doc_id", "label", "text"))
        up = {x: x for x in label}
        sets: dict[int, np.ndarray] = {}

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        def own(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_hashes(text[i], words)
            return sets[i]

        out = []
        for i, js in _candidates(pdf, percent, most):
            for j in js:
                if root(label[i]) == root(label[j]):
                    continue  # linked already, in this block or before
                if alike(len(np.intersect1d(own(i), own(j), assume_unique=True)), len(own(i)), len(own(j)), percent):
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    up[root(label[i])] = root(label[j])
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _blocks(active: DataFrame) -> DataFrame:
    """Rows of buckets dealt into pairs of blocks (x, y), so that no group holds more than two blocks, bounded in rows and in shingles."""
    parts = active.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("_parts"))
    active = active.join(parts, "key").withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("int"))
    places = F.expr("transform(sequence(0, _parts - 1), p -> struct(least(p, _part) as x, greatest(p, _part) as y, case when p = _part then 0 when _part < p then 1 else 2 end as side))")
    return active.withColumn("_at", F.explode(places)).select("*", "_at.x", "_at.y", "_at.side").drop("_at", "_part", "_parts")


def links_across(buckets: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between rows of different labels that share a bucket (key, band, doc_id, label).

    A first pass over sketches finds the rows with a likely partner of another label; only their texts are sent to the
    second, which compares full sets and returns links that join labels, not all pairs.
    """
    spark, at = buckets.sparkSession, ("key", "x", "y")
    mixed = buckets.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high").select("key")
    active = saved(buckets.join(mixed, "key", "left_semi").join(nodes, "doc_id"), "near-active")
    dealt = _blocks(active).repartition(tasks(spark, active.count(), EACH), *at)
    taken = saved(dealt.groupBy(*at).applyInPandas(_open_members(percent), "key long, doc_id long").distinct(), "near-open")
    held = active.join(taken, ["key", "doc_id"], "left_semi").join(texts, "doc_id")
    dealt = _blocks(held).repartition(tasks(spark, taken.count(), EACH), *at)
    out = saved(dealt.groupBy(*at).applyInPandas(_open_links(words, percent), "a long, b long").distinct(), "near-links")
    dropped(active, taken)
    return out


def near_groups(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: components of all links of the threshold (in whole hundredths) or more."""
    percent = round(100 * threshold)
    marks = saved(signed(docs, words), "near-marks")
    linkable = marks.where(f"n > 0 and doc_id <> {NO_ID}")
    classes = linkable.groupBy("ha", "hb", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("_c")).where("_c > 1").drop("_c")
    classes = saved(classes, "near-classes")
    placed = joined_small(linkable, classes, ["ha", "hb", "n"], "left")
    nodes = placed.where("rep is null or doc_id = rep").select("doc_id", "n", "sketch", "bands")
    nodes = saved(nodes, "near-nodes")
    copies = saved(placed.where("rep is not null").select("doc_id", "rep").distinct(), "near-copies")
    bands = nodes.select(F.posexplode("bands").alias("band", "key"), "doc_id")
    shared = saved(bands.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("_m")).where("_m > 1").select("key", "hub"), "near-shared")
    buckets = saved(joined_small(bands, shared, ["key"]), "near-buckets")
    pairs = buckets.where("doc_id > hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    involved = buckets.select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = saved(texts.join(involved, "doc_id", "left_semi"), "near-texts")
    tested = saved(likely(pairs, nodes.select("doc_id", "n", "sketch"), percent), "near-tested")
    links = saved(confirmed(tested, texts, words, percent), "near-links")
    first = components(links)
    members = buckets.select("key", "band", "doc_id").join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    members = members.select("key", "band", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    extra = links_across(members, nodes, texts, words, percent)
    # The texts of rows that share a doc_id belong together: so do the representatives of their classes.
    shared_ids = copies.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("_far"))
    apart = copies.join(shared_ids.where("rep < _far").select("doc_id", F.col("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b"))
    own = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).join(nodes.select(F.col("doc_id").alias("a")), "a", "left_semi")
    final = components(links.unionByName(extra).unionByName(apart).unionByName(own))
    out = marks.select("doc_id", F.col("n").alias("n_shingles")).join(shared_ids.select("doc_id", "rep"), "doc_id", "left")
    out = out.withColumn("node", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id"))).join(final, "node", "left")
    real = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    component = F.when(real.isNotNull(), F.coalesce("label", "node"))
    out = saved(out.select(real.alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(real == component, F.lit(True)).alias("kept")), "near-groups")
    dropped(marks, classes, nodes, copies, shared, buckets, texts, tested, links, extra, first, final)
    return out


def one_of_each(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, one of each group: the one with the least doc_id, null last.

    Every row is a document of its own here: of repeated rows one stays, rows with a null doc_id are compared like all others, and so are
    the different texts of rows that share a doc_id. Rows without words all stay.
    """
    rows, row = with_row(docs)
    groups = near_groups(rows.select(F.col(row).alias("doc_id"), "text"), words, threshold).select(F.col("doc_id").alias(row), F.col("component_id").alias("_group"))
    sized = groups.groupBy("_group").agg(F.count("*").alias("_m")).where("_m > 1").select("_group")
    members = saved(joined_small(groups, saved(sized, "near-many"), ["_group"]), "near-members")
    ids = rows.select(F.col(row).alias("_n"), F.col("doc_id").alias("_id"))
    order = F.struct(F.col("_id").isNull().alias("a"), F.col("_id").alias("b"), F.col("_n").alias("c"))
    best = saved(members.join(ids, F.col(row) == F.col("_n")).groupBy("_group").agg(F.min(order)["c"].alias("_best")), "near-best")
    gone = saved(joined_small(members, best, ["_group"]).where(F.col(row) != F.col("_best")).select(row), "near-gone")
    dropped(members, best)
    out = rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if rows is not docs:
        out = saved(out, "near-kept")
        dropped(rows)
    return out
