"""Word and shingle hashes of whole texts in numpy."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PIECE = 1 << 20
#: Powers of an odd base and of its inverse modulo 2**64, for texts up to a piece's length.
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power(base: int, name: str, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept and grown on demand up to a piece."""
    if name not in _powers or len(_powers[name]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        out = np.full(size, np.uint64(base), dtype=np.uint64)
        out[0] = 1
        _powers[name] = np.multiply.accumulate(out)
    return _powers[name][:n]


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words (runs of anything but ASCII white space) of a text, A-Z lower-cased."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    if len(raw) == 0:
        return np.empty(0, np.uint64)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    if ends[-1] <= _PIECE:
        return _spans(raw, starts, ends)
    out, first = [], 0  # long texts in pieces that end with a word
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _PIECE)))
        a, b = starts[first], ends[last - 1]
        out.append(_spans(raw[a:b], starts[first:last] - a, ends[first:last] - a))
        first = last
    return np.concatenate(out)


def _spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(_BASE, "base", n), out=sums[1:])
    value = (sums[ends] - sums[starts]) * _power(_INVERSE, "inverse", n)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * _P)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; the whole sequence as one if there are fewer words."""
    w = word_hashes(text or "")
    if len(w) == 0:
        return w
    size = min(words, len(w))
    out = np.full(len(w) - size + 1, np.uint64(size), dtype=np.uint64)
    for i in range(size):
        out = mix(out * _P + w[i : len(w) - size + 1 + i])
    return np.unique(out)
