"""Words of whole texts as 64-bit hashes, found for many texts at once on their UTF-8 bytes.

A word is a longest run of ASCII letters and digits and of characters beyond ASCII; A-Z are
lower-cased. Words are hashed by sums of random values per byte times powers of an odd number, so
one running sum over a slice of texts gives the hashes of all its words without a loop over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from itemlake.llm.encode import plain_strings, text_slices

_ODD = 0x5851F42D4C957F2D
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256)
    lower[65:91] += 32
    inside = np.zeros(256, bool)
    inside[48:58] = inside[97:123] = inside[65:91] = inside[128:] = True
    values = mix((np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)))
    return inside, values[lower]


INSIDE, VALUES = _byte_tables()
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd number up to ``n``, and those of its inverse."""
    if len(_powers[0]) <= n:
        size = 1 << int(n).bit_length()
        with np.errstate(over="ignore"):
            for i, base in enumerate((_ODD, pow(_ODD, -1, 2**64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span ``values[start:end]``; equal spans have equal hashes wherever they lie."""
    power, inverse = powers(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[:len(values)], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * inverse[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


class Words(NamedTuple):
    """Word hashes of a slice of texts: text i has ``hashes[bounds[i]:bounds[i + 1]]``."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray  # byte offsets of the words in ``raw``
    ends: np.ndarray
    raw: np.ndarray
    text_bounds: np.ndarray


def words_of(texts: pa.Array) -> Words:
    """Words of every text of one array (no NULLs)."""
    texts = plain_strings(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    text_bounds = offsets - offsets[0]
    inside = np.concatenate([[False], INSIDE[raw], [False]])
    change = inside[1:] != inside[:-1]
    inner = text_bounds[(text_bounds > 0) & (text_bounds < len(raw))]
    both = inside[inner] & inside[inner + 1]  # two texts that touch without a gap between their words
    cuts = np.unique(inner[both]) if both.any() else inner[:0]
    edges = np.flatnonzero(change)
    starts = np.sort(np.concatenate([edges[0::2], cuts]))
    ends = np.sort(np.concatenate([edges[1::2], cuts]))
    hashes = span_hashes(VALUES[raw], starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return Words(hashes, np.searchsorted(starts, text_bounds), starts, ends, raw, text_bounds)


def word_slices(texts: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[tuple[int, int, Words]]:
    """``(first, last, words)`` for runs of texts of about ``limit`` bytes."""
    texts = plain_strings(texts)
    for first, last in text_slices(texts, limit):
        yield first, last, words_of(texts.slice(first, last - first))


def word_counts(texts: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> np.ndarray:
    """Number of words of every text (no NULLs); nothing is hashed."""
    texts = plain_strings(texts)
    counts = np.zeros(len(texts), np.int64)
    for first, last in text_slices(texts, limit):
        part = plain_strings(texts.slice(first, last - first))
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset:part.offset + len(part) + 1]
        data = part.buffers()[2]
        inside = INSIDE[np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]] if data is not None else np.zeros(0, bool)
        bounds = offsets - offsets[0]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = bounds[:-1][bounds[:-1] < len(inside)]
        begins[heads] = inside[heads]
        sums = np.concatenate([[0], np.cumsum(begins)])
        counts[first:last] = sums[bounds[1:]] - sums[bounds[:-1]]
    return counts


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive words; position i is the gram that starts at word i."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * _U(_ODD) + hashes[j:j + n]
        return mix(out + _U(k))
