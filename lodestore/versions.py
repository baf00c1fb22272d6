"""Numbered states of a stored table: small JSON files, each written once, the last of which says what counts.

Files that no state names are as good as not there, so a writer that fails half-way changes nothing. Of two writers that start from one
state the second is refused, and may begin again from what the first left.
"""

from __future__ import annotations

import json

from pyspark import SparkContext
from pyspark.sql import SparkSession

from .scratch import _folder, exists, listed


class Conflict(RuntimeError):
    """Another writer has put a state since this one's was read."""


class Versions:
    """The states under ``root/manifest``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root}/manifest"

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in listed(self.path) if n.isdigit()) if exists(self.path) else []

    def read(self, version: int) -> dict | None:
        """A state, or None if its writer did not finish."""
        system, where = _folder(f"{self.path}/{version:08d}")
        stream = system.open(where)
        try:
            told = SparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(told)
        except ValueError:
            return None

    def all(self) -> list[int]:
        """Numbers of the states that are complete, ascending."""
        return [n for n in self._numbers() if self.read(n) is not None]

    def last(self) -> tuple[int, dict | None]:
        """(number, state) of the last complete state; (0, None) if there is none."""
        for n in reversed(self._numbers()):
            state = self.read(n)
            if state is not None:
                return n, state
        return 0, None

    def commit(self, base: int, state: dict) -> int:
        """Put a state after ``base``, which must still be the last; its number."""
        if self.last()[0] != base:
            raise Conflict(f"{self.path}: state {base} is not the last any more")
        number = max([0, *self._numbers()]) + 1
        system, where = _folder(f"{self.path}/{number:08d}")
        try:
            stream = system.create(where, False)  # fails if another writer was first
        except Exception as e:
            raise Conflict(f"{self.path}: state {number} is taken") from e
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        return number
