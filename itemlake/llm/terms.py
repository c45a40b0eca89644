"""Runs of letters in whole texts, counted per text.

What belongs to a run is told byte by byte: all other bytes become blanks, A-Z their lower case, and Arrow splits
the rest and numbers the distinct runs, so no expression is matched text by text.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from itemlake.llm.encode import plain_strings

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True
_WIDE = _LETTERS.copy()
_WIDE[128:] = True


def any_letters(raw: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of all characters beyond ASCII."""
    return _WIDE[raw]


def latin_letters(raw: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of U+00C0-U+00FF, whose first byte in UTF-8 is C3 and no other character's."""
    first = raw == 0xC3
    inside = _LETTERS[raw] | first
    inside[1:] |= first[:-1]
    return inside


class Counted(NamedTuple):
    """``n`` occurrences of the run ``terms[code]`` in text ``doc``; a row per text and run."""

    doc: np.ndarray
    code: np.ndarray
    n: np.ndarray
    terms: pa.Array


def counted_terms(texts: pa.Array, inside: Callable[[np.ndarray], np.ndarray]) -> Counted:
    """Runs of every text of one array; NULL counts as empty."""
    texts = plain_strings(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    shown = np.where(inside(raw), _LOWER[raw], np.uint8(32))
    blanked = pa.Array.from_buffers(pa.large_string(), len(texts),
                                    [None, pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(shown)])
    parts = pc.split_pattern(blanked, " ")
    coded = parts.flatten().dictionary_encode()
    terms = coded.dictionary
    doc = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    code = coded.indices.to_numpy().astype(np.int64)
    none = pc.index(terms, pa.scalar("", terms.type)).as_py()
    if none >= 0:
        doc, code = doc[code != none], code[code != none]
    pair, n = np.unique(doc * max(1, len(terms)) + code, return_counts=True)
    return Counted(pair // max(1, len(terms)), pair % max(1, len(terms)), n, terms)
