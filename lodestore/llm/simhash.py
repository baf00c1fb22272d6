"""SimHash fingerprints and a search of all fingerprints within a Hamming radius.

A document's terms are its adjacent word pairs (its single word if it has one only); a pair of two
short words weighs 1, others 2. Each term's 64-bit hash votes with its weight on every bit, for
where the bit is set and against where it is not; the fingerprint holds the bits with more votes for. Votes are
summed two bits to a long, 32 sums for 64 bits, inside one hash aggregation.

Null and empty texts, and texts of white space only, have no terms and the fingerprint 0. Rows that share doc_id are
ordered by a hash of their text, repeated rows stand next to each other; null doc_ids come first. A single
row is its own next document. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, ranked, saved
from .line_dedup import NO_ID

BITS = 64
SHORT = 3  # characters of a short word
RADIUS = 3
BLOCKS = 6
QUERY_EVERY = 50


def term_votes(text: Column) -> Column:
    """Array of (hash, weight) of the terms of a text."""
    split = F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")

    def votes(words: Column) -> Column:
        pairs = F.transform(
            F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
            lambda w, i: F.struct(F.xxhash64(F.get(words, i), w).alias("h"), F.when((F.length(w) <= SHORT) & (F.length(F.get(words, i)) <= SHORT), F.lit(1)).otherwise(F.lit(2)).alias("w")),
        )
        one = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.struct(F.xxhash64(w).alias("h"), F.lit(2).alias("w")))
        return F.when(F.size(words) > 1, pairs).otherwise(one)

    return let(split, votes)


def _vote_sums() -> list[Column]:
    half = (1 << 32) + 1
    return [F.sum(F.expr(f"(shiftrightunsigned(_h, {k}) & {half}L) * _w")).alias(f"_v{k}") for k in range(32)] + [F.sum("_w").alias("_all")]


def _fingerprint() -> Column:
    bits = []
    for k in range(32):
        low, high = F.expr(f"_v{k} & 4294967295L"), F.expr(f"shiftrightunsigned(_v{k}, 32)")
        bits += [F.when(low * 2 > F.col("_all"), F.lit(1 << k)).otherwise(F.lit(0))]
        top = 1 << (k + 32)
        bits += [F.when(high * 2 > F.col("_all"), F.lit(top - (1 << 64) if top >= 1 << 63 else top)).otherwise(F.lit(0))]
    out = bits[0].cast("long")
    for b in bits[1:]:
        out = out.bitwiseOR(b.cast("long"))
    return out


def fingerprints(texts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Fingerprints (longs) of several text columns: keys and ``fp_<column>``.

    keys must name a row. If texts is already dealt by some of them, no further shuffle is needed.
    """
    def marked(i: int, c: str) -> Column:
        return F.transform(term_votes(F.coalesce(F.col(c), F.lit(""))), lambda t: F.struct(F.lit(i).alias("c"), t["h"].alias("h"), t["w"].alias("w")))

    votes = F.concat(*[marked(i, c) for i, c in enumerate(columns)])
    flat = texts.select(*keys, F.explode_outer(votes).alias("_term")).select(*keys, F.coalesce("_term.c", F.lit(0)).alias("_c"), F.coalesce("_term.h", F.lit(0)).alias("_h"), F.coalesce("_term.w", F.lit(0)).cast("long").alias("_w"))
    each = flat.groupBy(*keys, "_c").agg(*_vote_sums()).select(*keys, "_c", _fingerprint().alias("_fp"))
    return each.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("_c") == i, F.col("_fp"))), F.lit(0)).alias(f"fp_{c}") for i, c in enumerate(columns)])


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), BITS // 4, "0")


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """A mask for each choice of ``blocks - radius`` blocks: two words within the radius agree under one at least."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    own = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    out = [sum(own[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def within_radius(queries: DataFrame, words: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs (q, fp) of query words q and words fp at a Hamming distance of the radius or less, once each.

    Both inputs hold distinct longs. Every word is filed in C(blocks, radius) tables under the bits of the
    table's blocks; a pair is kept in the first table whose blocks agree, so none is counted twice.
    """
    masks = block_masks(radius, blocks)

    def filed(df: DataFrame, col: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col(col).bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
        return df.select(col, F.explode(keys).alias("_f")).select(col, "_f.t", "_f.k")

    apart = F.col("q").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    pairs = filed(queries, "q").join(filed(words, "fp"), ["t", "k"])
    return pairs.where((F.bit_count(apart) <= radius) & (first == F.col("t"))).select("q", "fp", F.bit_count(apart).alias("distance"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each text, and the text whose last quarter is replaced from the next document, with their likeness.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near. Only a prefix of the
    next text, as long as the edit needs, is sent to a document. n_near counts, for every row whose doc_id is
    divisible by 50, the documents (itself included) within Hamming distance 3 of its fingerprint; else null.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_d"), F.xxhash64(text).alias("_t"), "doc_id", text.alias("text"))
    counts = rows.groupBy("_d", "_t", "doc_id", F.length("text").alias("n_chars")).agg(F.count("*").alias("_k"))
    order = ranked(counts.select("_d", "_t", "doc_id", "n_chars", F.explode(F.sequence(F.lit(1), F.col("_k").cast("int"))).alias("_i")), [F.col("_d"), F.col("_t"), F.col("_i")], "_rank")
    order = saved(order, "simhash-order")
    total = order.count()
    if order.where("_i > 1").limit(1).count():
        rows = rows.dropDuplicates(["_d", "_t"])
    after = order.select(F.pmod(F.col("_rank") - 1, F.lit(max(1, total))).alias("_rank"), F.col("_d").alias("_nd"), F.col("_t").alias("_nt"))
    chain = order.join(after, "_rank")
    need = F.expr("int(n_chars div 4)")
    heads = chain.join(rows.select(F.col("_d").alias("_nd"), F.col("_t").alias("_nt"), F.col("text").alias("_next")), ["_nd", "_nt"])
    heads = heads.select("_d", "_t", "doc_id", "n_chars", "_rank", F.substring("_next", F.lit(1), need).alias("_head"))
    both = rows.select("_d", "_t", "text").join(heads, ["_d", "_t"])
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - need), F.col("_head"))
    both = both.withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256))
    marks = saved(fingerprints(both, ["_d", "_t", "doc_id", "_rank", "n_chars", "edited_sha256"], ["text", "edited"]), "simhash-marks")
    successor = marks.select(F.pmod(F.col("_rank") - 1, F.lit(max(1, total))).alias("_rank"), F.col("fp_text").alias("_fp_next"))
    words = marks.groupBy(F.col("fp_text").alias("fp")).agg(F.count("*").alias("_docs"))
    asked = marks.where(F.col("doc_id") % QUERY_EVERY == 0).select(F.col("fp_text").alias("q")).distinct()
    near = within_radius(asked, words.select("fp")).join(words, "fp").groupBy(F.col("q").alias("fp_text")).agg(F.sum("_docs").alias("n_near"))
    out = marks.join(successor, "_rank")
    found = out.where(F.col("doc_id") % QUERY_EVERY == 0).join(near, "fp_text", "left").select("_rank", "n_near")
    out = out.join(found, "_rank", "left")
    return out.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        as_hex(F.col("fp_text")).alias("fingerprint"),
        as_hex(F.col("fp_edited")).alias("edited_fingerprint"),
        likeness(F.col("fp_text"), F.col("fp_edited")).alias("near_edited"),
        likeness(F.col("fp_text"), F.col("_fp_next")).alias("near_next"),
        "n_near",
    )
