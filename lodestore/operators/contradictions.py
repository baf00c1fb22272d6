"""Contradictions among the few results of one query."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame

from ..config import CONTRADICTION_SIGNALS, OBJECT_CHARS, OBJECT_LIMIT, SAME_LIMIT


def alike(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def near_copies(a: dict, b: dict) -> bool:
    """Whether two entries record one thing: the first eight characters of their hashes, or their summaries, agree."""
    x, y = ((r.get("summary_hash") or "").strip()[:8] for r in (a, b))
    return bool(x and y and x == y) or alike(a.get("summary") or "", b.get("summary") or "") >= SAME_LIMIT


def claim(row: dict) -> tuple[bool, str, str]:
    """(whether it holds a signal of denial, what it is about, the whole text)."""
    summary = row.get("summary") or ""
    whole = summary + " " + (row.get("content") or "")
    signal = next((s for s in CONTRADICTION_SIGNALS if s in whole), None)
    about = summary[:OBJECT_CHARS] if signal is None else whole[whole.index(signal) + len(signal) :][:OBJECT_CHARS]
    return signal is not None, about, whole


def contradict(a: dict, b: dict) -> bool:
    """One of two near copies denies, the other does not, and what they speak of differs; texts that agree as a whole never contradict."""
    (denies_a, about_a, whole_a), (denies_b, about_b, whole_b) = claim(a), claim(b)
    if denies_a == denies_b or not about_a or not about_b:
        return False
    return alike(about_a, about_b) < OBJECT_LIMIT and alike(whole_a, whole_b) < SAME_LIMIT


def worth(row: dict) -> tuple:
    """By what the stronger entry is told: confidence (0.5 if none), then the later, then the better score."""
    c = row["confidence"]
    return (0.5 if c is None or c != c or c == 0 else c), row.get("timestamp") or "", row["score"]


def losers(rows: list[dict]) -> set[int]:
    """Places of the weaker entries of contradicting pairs, in rank order; an entry that has lost accuses no other."""
    out: set[int] = set()
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            if i in out:
                break
            if j not in out and near_copies(a, rows[j]) and contradict(a, rows[j]):
                out.add(j if worth(a) >= worth(rows[j]) else i)
    return out


def greedy_contradictions(rows: DataFrame) -> DataFrame:
    """Drop deprecated entries, and the weaker of contradicting ones, among each query's results.

    rows: qid, rank0, id, summary, confidence, timestamp, score; summary_hash, content and deprecated if known. A query holds its cut list
    only (tens of rows), never a group of the corpus.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank0", "id"])
        if "deprecated" in pdf:
            pdf = pdf[~(pdf["deprecated"].fillna(0) > 0)]
        gone = losers(pdf.to_dict("records"))
        return pdf[[n not in gone for n in range(len(pdf))]]

    return rows.groupBy("qid").applyInPandas(run, rows.schema)
