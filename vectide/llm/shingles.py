"""Word hashes and sets of word shingles of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    table = np.full(n, _BASE, np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased; ASCII white space separates words."""
    data = np.frombuffer(text.lower(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    gap = _GAP[data]
    first = ~gap
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64)
    data, gap = data[starts[0] :], gap[starts[0] :]
    starts = starts - starts[0]
    spans = np.diff(starts, append=len(data))
    place = np.arange(len(data)) - np.repeat(starts, spans)
    values = _BYTE[data] * _powers(int(spans.max()))[place]
    values[gap] = 0
    return mixed(np.add.reduceat(values, starts))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; of the whole sequence if it is shorter."""
    if not len(words):
        return np.zeros(0, np.uint64)
    span = min(size, len(words))
    count = len(words) - span + 1
    total = np.full(count, span, np.uint64)
    for k in range(span):
        total *= _BASE
        total += words[k : k + count]
    return mixed(total)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; empty without words."""
    return np.unique(shingle_hashes(word_hashes(text), size))
