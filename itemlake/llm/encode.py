"""Texts to token ids with a public tokenizer file, inside Spark tasks.

The tokenizer takes many microseconds per word, and words repeat. Texts are therefore cut at blanks
and line ends, which the pre-tokenizer drops anyway; Arrow reduces the pieces of a slice of texts to
the distinct ones, and each Python worker remembers the ids of pieces it has met. The ids of a
text are the ids of its pieces in order, exactly as the library gives them for the whole text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept per worker; beyond it the memory starts anew, which costs time and changes nothing.
REMEMBERED = 500_000
#: ASCII marks that the pre-tokenizer takes in one piece; not ``'`` (contractions) or ``<`` (special tokens).
MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
#: Bytes of text handled at once (one text may be longer).
SLICE = 4 << 20


#: First code point after the letters that go straight to the merges.
LATIN_END = "\u0250"


def _ends_word(core: str) -> bool:
    """Whether the pre-tokenizer cuts between ``core`` and marks behind it."""
    low = core[-1:].lower()
    return "<" not in core and low < LATIN_END and (low.isalpha() or low.isascii() and low.isdigit())


def text_slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """``(first, end)`` of consecutive runs of texts with about ``limit`` bytes each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(run)) + 1
    edges = [0, *cuts.tolist(), len(sizes)]
    return ((a, b) for a, b in zip(edges, edges[1:]) if b > a)


def plain_strings(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array with 64-bit offsets, NULL as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()), "")


class Encoder:
    """Ids of whole texts; holds at most about ``remembered`` pieces."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        self.closing: dict[str, list[int]] = {}
        # The characters that stand for the bytes of letters from U+0080 to U+024F.
        shown = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        shown |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in shown)}
        self.spell = {c: "".join(shown[b] for b in chr(c).encode()) for c in range(0x80, ord(LATIN_END))}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 14, np.int64)

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces. Latin letters, alone or before marks, go straight to the merges, as
        normaliser and pre-tokenizer do no more to them than lower their case, spell their bytes
        and cut before the marks. Marks are only cut from a remembered piece that ends in a Latin letter
        or ASCII digit: after anything else they belong to one run with it, and ``<`` may begin a special
        token. All other pieces take the whole way."""
        merge, spell = self.tokenizer.model.tokenize, self.spell
        found: list[list[int]] = [[]] * len(pieces)
        rest = []
        for i, piece in enumerate(pieces):
            core = piece.rstrip(MARKS)
            if len(core) < len(piece) and _ends_word(core) and (at := self.known.get(core)) is not None:
                found[i] = self.flat[self.bounds[at]:self.bounds[at + 1]].tolist() + self._marks(piece[len(core):])
            elif core.isalpha() and (low := core.lower()).isalpha() and max(low) < LATIN_END:
                found[i] = [t.id for t in merge(low if low.isascii() else low.translate(spell))]
                if len(core) < len(piece):
                    found[i] += self._marks(piece[len(core):])
            else:
                rest.append(i)
        if rest:
            whole = self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)
            for i, e in zip(rest, whole):
                found[i] = e.ids
        return found

    def _marks(self, marks: str) -> list[int]:
        if marks not in self.closing:
            if len(self.closing) > 10_000:
                self.closing.clear()
            self.closing[marks] = self.tokenizer.encode(marks, add_special_tokens=False).ids
        return self.closing[marks]

    def _learn(self, pieces: list[str]) -> None:
        ids = self._ids(pieces)
        first, at = len(self.known), int(self.bounds[len(self.known)])
        ends = at + np.cumsum([len(x) for x in ids])
        while len(self.bounds) <= first + len(ids):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        while len(self.flat) < ends[-1]:
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.bounds[first + 1:first + 1 + len(ids)] = ends
        self.flat[at:ends[-1]] = [i for x in ids for i in x]
        self.known.update(zip(pieces, range(first, first + len(ids))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, bounds)``: text i has ``ids[bounds[i]:bounds[i + 1]]``, unsigned 32-bit."""
        if not len(texts):
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        pieces = pc.split_pattern(pc.replace_substring(plain_strings(texts), "\n", " "), " ")
        per_text = pieces.offsets.to_numpy()
        coded = pieces.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = np.array(list(map(self.known.get, distinct, repeat(-1))), np.int64)
        new = np.flatnonzero(places < 0)
        if len(new):
            if self.known and len(self.known) + len(new) > self.remembered:
                self._forget()
                new = np.arange(len(distinct))
            places[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn([distinct[i] for i in new.tolist()])
        at = places[coded.indices.to_numpy()]
        starts = self.bounds[at]
        lengths = self.bounds[at + 1] - starts
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])]
        return ids, ends[per_text - per_text[0]]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_slices(path: str, texts: pa.Array | pa.ChunkedArray,
                  end: int | None = None) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """``(first, last, ids of each text)`` for runs of texts, so that few ids are held at a time.

    NULL counts as empty; ``end`` is appended to each text.
    """
    texts = plain_strings(texts)
    tail = np.array([] if end is None else [end], np.uint32)
    for first, last in text_slices(texts):
        ids, bounds = encoder(path).encode(texts.slice(first, last - first))
        yield first, last, [np.concatenate([ids[a:b], tail]) for a, b in zip(bounds[:-1], bounds[1:])]


def encode_texts(path: str, texts: pa.Array | pa.ChunkedArray, end: int | None = None) -> Iterator[np.ndarray]:
    """Ids of every text of a column, as in :func:`encode_slices`."""
    for _, _, ids in encode_slices(path, texts, end):
        yield from ids
