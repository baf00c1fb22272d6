"""Personal data: exact base patterns, and contextual extraction bootstrapped from what they find.

One pass over the texts finds the base spans (email, ip, card, phone) and every other token that is shaped like an identifier, each with the words around it.
Base spans are the seeds. A lexical pattern is the words in one of the places around a token; it is trusted for a kind when enough distinct seeds stand in it
and they make up most of all distinct tokens that do. Tokens that trusted patterns point at become instances of the kind, with a score of their own, and count for
patterns in the next round. Rounds are Spark joins and sums over the distinct (pattern, token) pairs, on whole tables; no text is read again.

Odd rows: a null text is an empty one. Rows are taken for themselves, whatever their doc_id; repeated rows are the same instances, so they do not
add to a pattern's support. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore import on_workers

from .common import dropped, joined_small, saved

KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that no start is tried twice over the same run.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Other identifiers: runs of these, with an @ or so many digits.
_IN_ID = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@._%+/-")
_FROM_MARK = re.compile(r"[0-9@][A-Za-z0-9@._%+/-]*")
LEAST_DIGITS, LEAST_ID, MOST_ID = 4, 5, 64
#: Words of a context are cut to so many code points: they are looked for in a bounded piece beside the token.
WORD = 40
_PIECE = 4 * WORD

#: A pattern needs so many distinct instances, and so large a share of all distinct tokens in it; a token so high a score.
SUPPORT, TRUST, ACCEPT = 3.0, 0.8, 0.8
ROUNDS = 5


def emails(text: str) -> list[tuple[int, int]]:
    out, last = [], 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            last = m.end()
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all base matches, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def other_tokens(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of tokens shaped like identifiers that touch no base span."""
    out, at, last, held = [], 0, 0, sorted((a, b) for _, a, b in taken)
    covered = 0  # no base span passed so far ends beyond it
    for m in _FROM_MARK.finditer(text):
        start, end = m.span()
        while start > last and text[start - 1] in _IN_ID:
            start -= 1
        last = end
        while start < end and text[start] in "._%+/-":
            start += 1
        while end > start and text[end - 1] in "._%+/-":
            end -= 1
        while at < len(held) and held[at][0] < end:
            covered = max(covered, held[at][1])
            at += 1
        if covered > start or not LEAST_ID <= end - start <= MOST_ID:
            continue
        own = text[start:end]
        if "@" in own or len(_NOT_DIGIT.sub("", own)) >= LEAST_DIGITS:
            out.append((start, end))
    return out


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPACES = " \t\n\x0b\x0c\r"


def _words(piece: str) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", piece.translate(_LOWER)) if w]


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns that a token stands in: two words before, one before, one before and one behind. ^ and $ are the text's ends."""
    before = ["^", "^", *_words(text[max(0, start - _PIECE) : start])]
    behind = [*_words(text[end : end + _PIECE]), "$"]
    a, b, c = before[-2][-WORD:], before[-1][-WORD:], behind[0][:WORD]
    return [f"2|{a} {b}", f"1|{b}", f"3|{b} _ {c}"]


READ = "row long, doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, units array<struct<kind:int,start:long,end:long,value:string,patterns:array<string>>>"


def scanned(docs: DataFrame) -> DataFrame:
    """One row a document: counts, base spans as text, and units (base spans and other tokens) with their patterns. A scratch table; texts are read once."""
    on_workers(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    units = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, base, found = [[], [], [], []], [], []
            for text in b["text"]:
                text = text.as_py() or ""
                own = base_spans(text)
                rest = other_tokens(text, own)
                for k, column in enumerate(counts):
                    column.append(sum(1 for s in own if s[0] == k))
                base.append(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in own))
                every = [*own, *((None, s, e) for s, e in rest)]
                found.append([{"kind": k, "start": s, "end": e, "value": text[s:e].translate(_LOWER), "patterns": patterns(text, s, e)} for k, s, e in every])
            yield pa.RecordBatch.from_arrays([b["row"], b["doc_id"], *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(found, units)], names=["row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "units"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return saved(rows.mapInArrow(run, READ.format(kind=kind)), "pii-scanned")


def trusted(known: DataFrame, size: DataFrame) -> DataFrame:
    """(pattern, kind, trust) from (pattern, kind, score): what distinct instances of a kind each pattern holds, against the number of its distinct tokens."""
    held = known.groupBy("pattern", "kind").agg(F.sum("score").alias("support")).where(F.col("support") >= SUPPORT)
    held = held.join(size, "pattern").withColumn("trust", F.least(F.lit(0.99), F.round(F.col("support") / F.col("tokens"), 9)))
    return held.where(F.col("trust") >= TRUST).select("pattern", "kind", "trust")


def bootstrapped(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value, kind, score) of the tokens found, and (pattern, kind, trust) of the patterns that found them, from units (kind or null, value, patterns).

    The distinct (pattern, token) pairs are written once. A round sums the instances of each pattern, joins the trusted patterns to the
    tokens, and takes for each token one minus the product of the patterns' doubts. It ends when no token is new, or after ROUNDS.
    """
    key = F.when(F.length("value") > MOST_ID, F.sha2("value", 256)).otherwise(F.col("value"))  # a long value by its hash
    pairs = units.select(key.alias("value"), "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.min("kind").alias("kind"))
    pairs = saved(pairs, "pii-pairs")
    # a pattern without SUPPORT distinct tokens can never be trusted: it and its pairs go before any round
    size = saved(pairs.groupBy("pattern").agg(F.count("*").alias("tokens")).where(F.col("tokens") >= SUPPORT), "pii-patterns")
    seeds = pairs.where("kind is not null").select("pattern", "kind", F.lit(1.0).alias("score"))
    open_ = saved(pairs.where("kind is null").select("pattern", "value").join(size.select("pattern"), "pattern", "left_semi"), "pii-open")
    rules, found, count = saved(trusted(seeds, size), "pii-rules"), None, 0
    for left in reversed(range(ROUNDS)):
        doubt = F.sum(F.log1p(-F.col("trust")))
        new = joined_small(open_, rules, ["pattern"]).groupBy("value", "kind").agg(F.round(1 - F.exp(doubt), 9).alias("score")).where(F.col("score") >= ACCEPT)
        # of several kinds the surest, then the first of KINDS
        last, found = found, saved(new.groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.max("score").alias("score")), "pii-found")
        dropped(*([last] if last is not None else []))
        n = found.count()
        if n == count or not left:
            break
        known = joined_small(open_, found, ["value"]).select("pattern", "kind", "score")
        count, last = n, rules
        rules = saved(trusted(seeds.unionByName(known), size), "pii-rules")
        dropped(last)
    dropped(pairs, size, open_)
    return found, rules


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found): base counts and digest, and all spans with those that bootstrapping adds."""
    rows = scanned(docs)
    units = rows.select("row", F.explode("units").alias("u")).select("row", "u.*")
    found, rules = bootstrapped(units)
    mine = joined_small(units.where("kind is null").select("row", "start", "end", "value"), found.select("value", F.col("kind").alias("kind")), ["value"])
    more = mine.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_more"))  # spans of one text
    own = F.transform(F.filter("units", lambda u: u["kind"].isNotNull()), lambda u: F.struct(u["kind"].alias("kind"), u["start"].alias("start"), u["end"].alias("end")))
    narrow = rows.select("row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), own.alias("_own"))
    out = joined_small(narrow, more, ["row"], "left")
    every = F.array_sort(F.concat("_own", F.coalesce("_more", F.array().cast("array<struct<kind:int,start:long,end:long>>"))))
    out = saved(out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", _listed(every).alias("spans"), F.greatest(F.size("_more"), F.lit(0)).cast("long").alias("n_found")), "pii")
    dropped(rows, found, rules)
    return out
