"""Fuzzy search for short license notices in whole texts.

Words are runs of ASCII digits, letters (A-Z lower-cased) and any code point above 0x7F; they are joined by one
space, so punctuation and line breaks inside a notice do not matter. A notice with a budget of k edits is
split into k + 1 seeds: a place within k edits holds one of them unchanged. All seeds are looked for at once by an
automaton; the regex library's bounded-error match runs at the few word starts that a seed allows, so no place within the
budget is missed, and the spans of a notice that do not overlap are reported, those with the fewest edits first.

Base places are exact word sequences. Null and empty texts have no words, a count of 0, empty labels, null
places and a score of 0. Repeated rows are scored alike, an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

# Base phrases and labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Longer notices with labels of their own.
NOTICES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "apache license version 2 0": "apache-2",
    "cc by nc 4 0": "cc-by-nc",
    "cc by sa 4 0": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "released under the mit license": "mit",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
}
#: One edit for so many characters of a notice; two at most if it holds digits, which must stand unchanged: they tell versions apart.
CHARS_AN_EDIT = 7
_BASE = {phrase: re.compile(rf"(?<![^ ])(?={re.escape(phrase)}(?![^ ]))") for phrase in BASE}
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def edit_budget(phrase: str) -> int:
    most = len(phrase) // CHARS_AN_EDIT
    return min(most, 2) if any(c.isdigit() for c in phrase) else most


def seeds(phrase: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of edits + 1 pieces that make up the phrase."""
    cuts = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(1)
def _searcher():
    import ahocorasick
    import regex

    found = ahocorasick.Automaton()
    by_seed: dict[str, list] = {}
    for phrase, label in (BASE | NOTICES).items():
        k = edit_budget(phrase)
        pattern = regex.compile(rf"(?b)(?:{regex.escape(phrase)}){{e<={k}}}(?!\S)")
        for at, piece in seeds(phrase, k):
            by_seed.setdefault(piece, []).append((phrase, label, k, at, pattern))
    for piece, uses in by_seed.items():
        found.add_word(piece, (piece, uses))
    found.make_automaton()
    return found


def apart(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (edits, start, end), the fewest edits first, those that overlap none taken before."""
    taken: list[tuple[int, int, int]] = []  # (start, end, edits), in order
    for edits, a, b in sorted(found):
        i = bisect_left(taken, (a, b, edits))
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
            taken.insert(i, (a, b, edits))
    return [(edits, a, b) for a, b, edits in taken]


def _digits(piece: str) -> str:
    return "".join(c for c in piece if c.isdigit())


@lru_cache(1 << 14)
def _match(pattern, piece: str) -> tuple[int, int, str] | None:
    """(edits, length, digits) of the best match at a piece's start: notices repeat, within a text and across texts."""
    m = pattern.match(piece)
    return (sum(m.fuzzy_counts), m.end(), _digits(m[0])) if m else None


def fuzzy_spans(words: str) -> list[tuple[str, int, int, int, float]]:
    """(label, first character, end, edits, score) of notices in a text of words joined by one space."""
    starts: dict[tuple[str, str], dict[int, tuple]] = {}
    for end, (piece, uses) in _searcher().iter(words):
        for phrase, label, k, at, pattern in uses:
            seed = end + 1 - len(piece) - at
            for start in range(max(0, seed - k), min(seed + k, end) + 1):
                if start == 0 or words[start - 1] == " ":
                    starts.setdefault((phrase, label), {})[start] = (k, pattern)
    out = set()
    for (phrase, label), own in starts.items():
        digits, found = _digits(phrase), []
        for start, (k, pattern) in own.items():
            # one character more than the longest match, for the look ahead
            m = _match(pattern, words[start : start + len(phrase) + k + 1])
            if m and m[2] == digits:
                found.append((m[0], start, start + m[1]))
        out.update((label, a, b, edits, 1 - edits / len(phrase)) for edits, a, b in apart(found))
    return sorted(out)


class Places:
    """Numbers of words by the character that they start at: spaces are found once, at the first question."""

    def __init__(self, words: str):
        self.words, self.spaces = words, None

    def __call__(self, at: int) -> int:
        if self.spaces is None:
            self.spaces = np.flatnonzero(np.frombuffer(self.words.encode("utf-32-le", "surrogatepass"), np.uint32) == 32).tolist()
        return bisect_left(self.spaces, at)


def base_places(words: str, number: Places | None = None) -> dict[str, list[int]]:
    """Word numbers at which each base phrase starts."""
    number, out = number or Places(words), {}
    for phrase, pattern in _BASE.items():
        if phrase in words:
            found = [number(m.start()) for m in pattern.finditer(words)]
            if found:
                out[phrase] = found
    return out


def scan_text(text: str | None) -> tuple:
    """The row of one text: n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    words = b" ".join(found).decode("utf-8", "surrogatepass")
    number = Places(words)
    places = base_places(words, number)
    starts = [at for own in places.values() for at in own]
    base = {BASE[phrase] for phrase in places}
    fuzzy = fuzzy_spans(words)
    score = max([1.0 if starts else 0.0, *(s[4] for s in fuzzy)])
    spans = [(label, number(a), number(b) + 1, edits) for label, a, b, edits, _ in fuzzy]
    return len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in fuzzy})), score, spans


_COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = pd.DataFrame([(i, *scan_text(t)) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True)], columns=_COLUMNS)
        for c in ("first_word", "last_word"):
            out[c] = out[c].astype("Int64")
        yield out


def license_scan(docs: DataFrame) -> DataFrame:
    """One row a document: counts, first and last base place, labels, score, and spans (label, start word, end word, edits)."""
    spans = "array<struct<label:string,start_word:long,end_word:long,edits:int>>"
    narrow = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = narrow.mapInPandas(_scan, f"doc_id string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {spans}")
    return saved(out.withColumn("doc_id", F.col("doc_id").cast("long")), "licenses")
