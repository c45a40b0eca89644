"""Benchmark decontamination by winnowing.

Of every ``WINDOW - K + 1`` consecutive K-word hashes the smallest is kept, on benchmark items and documents alike, so
equal windows of WINDOW words keep an equal hash, their print. A print of a document goes on if it passes a bitmap of the
benchmark's, and with it the check hashes of the windows that it stands for; windows meet the benchmark's distinct windows on
print and check together, and hit windows that touch or overlap are extended to spans. Items shorter than a window are one
window, whose print is the hash of all their words.

Distinct windows are joined, not items: a passage that many items share is one window to a document. Windows that stand in the
same items have one set of items, found by sums of hashes, and a text meets a set once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlake.llm.common import bitmap, cut_lineage, freeing, in_bitmap, typed
from itemlake.llm.words import grams, mix, word_counts, word_slices, words_of

WINDOW = 13
K = 6
FOUND = "n_hit long, spans array<struct<start:int,end:int>>"
#: Turns word hashes into others for the check of a window, which is thereby independent of its print.
_OTHER = np.uint64(0xA24BAED4963EE407)


def winnowed(gram: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours, by the place of the first of them."""
    low, span = gram, 1
    if len(gram) < width:
        return gram[:0]
    while span < width:  # running minimum, twice as wide each time
        step = min(span, width - span)
        low = np.minimum(low[:len(low) - step], low[step:])
        span += step
    return low


def _windows(hashes: np.ndarray, bounds: np.ndarray, short: list[int], whole: bool, window: int, k: int,
             bits: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """``(starts, size, prints, checks)`` of the windows of all texts of a slice, those whose print is in ``bits`` if given.

    Windows of fewer than ``window`` words come in the sizes ``short``; ``whole`` restricts them to texts of just that
    many words (the items).
    """
    lengths = np.diff(bounds)
    of = np.repeat(np.arange(len(lengths)), lengths)
    left = bounds[1:][of] - np.arange(len(hashes))  # words from here to the end of the text
    other = mix(hashes ^ _OTHER)
    for size in [window, *short]:
        n = max(0, len(hashes) - size + 1)
        prints = winnowed(grams(hashes, k), window - k + 1) if size == window else grams(hashes, size)
        fits = (left[:n] >= size) if size == window or not whole else (left[:n] == size) & (lengths[of[:n]] == size)
        if bits is not None and n:
            head = np.concatenate([[True], prints[1:] != prints[:-1]])  # neighbours mostly share their print
            fits = fits & in_bitmap(bits, prints[head])[np.cumsum(head) - 1]
        starts = np.flatnonzero(fits)
        checks = grams(other, size)
        yield starts, size, prints[starts], checks[starts]


def _item_windows(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, w in word_slices(batch.column(1)):
                items = np.array(batch.column(0).slice(first, last - first).to_pylist(), object)
                for at, size, prints, checks in _windows(w.hashes, w.bounds, list(range(1, window)), True, window, k):
                    of = np.searchsorted(w.bounds, at, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(items[of], pa.string()), pa.array(np.full(len(at), size, np.int32)),
                         pa.array(prints.view(np.int64)), pa.array(checks.view(np.int64))], ["item", "size", "print", "check"])
    return run


def _document_windows(short: list[int], bits: np.ndarray, check_bits: np.ndarray, window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, w in word_slices(batch.column(1)):
                keys, lengths = batch.column(0).slice(first, last - first), np.diff(w.bounds)
                for at, size, prints, checks in _windows(w.hashes, w.bounds, short, False, window, k, bits):
                    seen = in_bitmap(check_bits, checks)
                    at, prints, checks = at[seen], prints[seen], checks[seen]
                    of = np.searchsorted(w.bounds, at, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(of)), pa.array(lengths[of].astype(np.int64)), pa.array((at - w.bounds[of]).astype(np.int32)),
                         pa.array(np.full(len(at), size, np.int32)), pa.array(prints.view(np.int64)),
                         pa.array(checks.view(np.int64))], ["text_key", "n_words", "at", "size", "print", "check"])
    return run


def _extend():
    """Hit windows of each text, extended over those that touch or overlap them."""
    def spans_of(hits) -> list[dict]:
        merged: list[dict] = []
        for start, end in sorted((h["at"], h["at"] + h["size"]) for h in hits):
            if merged and start <= merged[-1]["end"]:
                merged[-1]["end"] = max(end, merged[-1]["end"])
            else:
                merged.append({"start": start, "end": end})
        return merged

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        for texts in batches:
            found = [spans_of(hits.as_py()) for hits in texts]
            yield pa.array([{"n_hit": sum(s["end"] - s["start"] for s in spans), "spans": spans} for spans in found], kind)
    return run


def _counts():
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(word_counts(texts))
    return run


def _item_words():
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            w = words_of(texts)
            yield pa.array([w.hashes[a:b].tobytes() for a, b in zip(w.bounds[:-1], w.bounds[1:])], pa.binary())
    return run


def _with_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(print, check, items_of)`` of the distinct windows and ``(items_of, item)`` of the distinct sets of items.

    A set is named by the number and three sums of hashes of its items, so no row ever holds a whole set; its items are those of
    one of its windows.
    """
    spread = [F.sum(F.xxhash64("item", F.lit(i)) % F.lit(1 << 32)).alias(f"s{i}") for i in (1, 2, 3)]
    named = (rows.groupBy("print", "check").agg(F.count(F.lit(1)).alias("s0"), *spread)
             .select("print", "check", F.sha2(F.concat_ws(" ", "s0", "s1", "s2", "s3"), 256).alias("items_of")))
    windows = cut_lineage(named)
    one = windows.groupBy("items_of").agg(F.min(F.struct("print", "check")).alias("w")).select("items_of", "w.print", "w.check")
    return windows, rows.join(one, ["print", "check"]).select("items_of", "item")


def _key(text: str) -> Column:
    return F.md5(F.col(f"`{text}`").cast("string"))


def hit_texts(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
              window: int = WINDOW, k: int = K) -> DataFrame:
    """``(text_key, n_words, n_hit, spans, items)``: one row for each different text with a hit, without the text.

    ``text_key`` is the text's md5; the rest is as in ``contamination``.
    """
    named = typed(benchmark, {"item": (item_id, "string"), "text": (item_text, "string")}).na.fill({"item": ""})
    worded = named.select("item", "text", F.arrow_udf(_item_words(), "binary")(F.coalesce("text", F.lit(""))).alias("words"))
    worded = cut_lineage(worded.filter(F.length("words") > 0).select(F.col("item").alias("name"), "text", F.sha2("words", 256).alias("item")))
    distinct = worded.groupBy("item").agg(F.min("text").alias("text"))
    rows = cut_lineage(distinct.mapInArrow(_item_windows(window, k), "item string, size int, print long, check long").distinct())
    short = sorted(r[0] for r in rows.select("size").distinct().collect() if r[0] < window)  # at most window - 1
    windows, sets = _with_sets(rows)

    texts = typed(docs, {"text": (text, "string")}).select(_key("text").alias("text_key"), "text")
    seen = texts.mapInArrow(freeing(_document_windows(short, bitmap(windows, "print"), bitmap(windows, "check"), window, k)),
                            "text_key string, n_words long, at int, size int, print long, check long")
    met = cut_lineage(seen.join(windows, ["print", "check"]).select("text_key", "n_words", "at", "size", "items_of"))
    spans = F.arrow_udf(_extend(), FOUND)(F.collect_set(F.struct("at", "size")))  # at most as many as the text has words
    hits = met.groupBy("text_key").agg(F.max("n_words").alias("n_words"), spans.alias("found"))
    held = (met.select("text_key", "items_of").distinct().join(sets, "items_of").select("text_key", "item").distinct()
            .join(worded.select("item", "name"), "item").groupBy("text_key").agg(F.sort_array(F.collect_set("name")).alias("items")))
    return cut_lineage(hits.join(held, "text_key").select("text_key", "n_words", "found.n_hit", "found.spans", "items"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", result: str = "contamination", **options) -> DataFrame:
    """``docs`` with a struct of what they share with the benchmark.

    ``n_words``; ``n_hit`` words that lie inside an occurrence of an item's window; their ``spans`` in
    words; ``items`` (ids as strings) with an occurring window. A window is ``window`` consecutive words;
    an item with fewer, but not none, is one window. ``options`` are those of ``hit_texts``.

    NULL and empty texts have no words and no hits. An item without id is taken for id ``''``; items
    with equal words are looked for once and all named. Rows of ``docs`` are neither lost nor doubled,
    whatever their ids, and their other columns stay; an empty benchmark hits nothing. Words are counted before hits are
    joined, so texts move only where the caller goes on to read them.
    """
    told = hit_texts(docs, benchmark, text=text, **options).select(
        F.col("text_key").alias("__text_key"), "n_hit", "spans", "items").withColumnsRenamed({c: f"__{c}" for c in ("n_hit", "spans", "items")})
    columns = [F.col(f"`{c}`") for c in docs.columns]
    n_words = F.arrow_udf(freeing(_counts()), "long")(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    joined = docs.select(*columns, _key(text).alias("__text_key"), n_words.alias("__n_words")).join(told, "__text_key", "left")
    return joined.select(*columns, F.struct(
        F.col("__n_words").alias("n_words"), F.coalesce("__n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("__spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.coalesce("__items", F.array().cast("array<string>")).alias("items")).alias(result))


def _too_many(n_words: Column, n_hit: Column, share: int) -> Column:
    return (n_hit > 0) & (n_hit * share >= n_words)


def contaminated(result: str = "contamination", share: int = 20) -> Column:
    """Whether at least one in ``share`` words is hit."""
    return _too_many(F.col(result)["n_words"], F.col(result)["n_hit"], share)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", share: int = 20, **options) -> DataFrame:
    """The documents that are not contaminated, unchanged. Only the keys of the others are joined."""
    bad = hit_texts(docs, benchmark, text=text, **options).filter(_too_many(F.col("n_words"), F.col("n_hit"), share))
    return docs.join(bad.select(F.col("text_key").alias("__text_key")), _key(text) == F.col("__text_key"), "left_anti")
