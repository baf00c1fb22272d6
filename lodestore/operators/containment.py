"""Which texts hold which strings of a stated set: one automaton, one pass over the texts for each block of the set."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import on_workers

#: Characters of strings that are sent to the executors at once; a larger set is taken in blocks.
BLOCK_CHARS = 16 << 20

_automata: dict[str, object] = {}  # the last block's automaton, kept by a worker between tasks


def _blocks(strings: DataFrame, key: str, string: str) -> Iterator[list[tuple]]:
    block, size = [], 0
    for k, s in strings.select(key, string).where(F.col(string).isNotNull()).toLocalIterator():
        if block and size + len(s) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((k, s))
        size += len(s)
    if block:
        yield block


class _Automaton:
    def __init__(self, block: list[tuple]):
        import ahocorasick

        self.always, by_string = [], {}
        for k, s in block:
            (by_string.setdefault(s, []) if s else self.always).append(k)
        self.found = ahocorasick.Automaton() if by_string else None
        for s, keys in by_string.items():
            self.found.add_word(s, keys)
        if by_string:
            self.found.make_automaton()

    def keys(self, text: str) -> set:
        out = set(self.always)
        if self.found is not None:
            for _, keys in self.found.iter(text):
                out.update(keys)
        return out


def holding(texts: DataFrame, row: str, text: str, strings: DataFrame, key: str, string: str) -> DataFrame:
    """(key, row) of every text that holds a string, once each; the empty string is in every text, null in none."""
    spark, kinds = texts.sparkSession, dict(texts.dtypes) | dict(strings.dtypes)
    on_workers(spark)
    schema = f"{key} {kinds[key]}, {row} {kinds[row]}"
    out = spark.createDataFrame([], schema)
    narrow = texts.select(row, text).where(F.col(text).isNotNull())
    for block in _blocks(strings, key, string):
        held, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame], held=held, name=name) -> Iterator[pd.DataFrame]:
            if name not in _automata:
                _automata.clear()
                _automata[name] = _Automaton(held.value)
            for pdf in batches:
                found = [(k, r) for r, t in zip(pdf[row], pdf[text], strict=True) for k in _automata[name].keys(t)]
                yield pd.DataFrame(found, columns=[key, row])

        out = out.unionByName(narrow.mapInPandas(run, schema))
    return out
