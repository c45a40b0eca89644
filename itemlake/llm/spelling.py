"""Spelling variants: words of a corpus that differ by one character, and the form each of them goes back to.

Words are joined by asymmetric chunks. The longer word (of equally long ones either) is cut into two disjoint chunks,
its halves, which carry its length and their place. The other word contributes its positional grams of the chunks' lengths:
for its own length and the next, all that fit within a shift of one of a chunk's place. One edit leaves one of the
chunks whole: the first at its place, or the second, moved by the difference of lengths. So two near words agree in a
chunk and a gram, and one threshold edit distance verifies each pair.

A chunk that many words share (a common beginning or ending) would bring all of them together. Such keys are refined by
the other half: with one place left out, both words' halves are equal. Those keys meet true pairs only, so
no pair is dropped and no group of pairs grows with the square of a common chunk.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlake.llm.common import cut_lineage, freeing, typed
from itemlake.llm.encode import plain_strings, text_slices
from itemlake.llm.terms import counted_terms, latin_letters

#: Code points and occurrences of a word; how much more frequent a form is than its variant.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: One of so many (document, word) pairs is read with a character missing.
SLIPS = 199
#: Words with one chunk beyond which its key is refined.
COMMON = 256
_U = np.uint32


def _crc_steps() -> list[np.ndarray]:
    """For j = 0, 1, …: tables (4, 256) that append 2 ** j zero bytes to a CRC-32."""
    last = np.array([zlib.crc32(bytes([i]), 0) ^ zlib.crc32(b"\0", 0) for i in range(256)], _U)
    columns = np.array([(1 << b) >> 8 ^ int(last[1 << b & 255]) for b in range(32)], _U)
    steps = []
    for _ in range(31):
        value, table = np.arange(256, dtype=_U), np.zeros((4, 256), _U)
        for byte in range(4):
            for bit in range(8):
                table[byte] ^= np.where(value >> _U(bit) & _U(1) == 1, columns[8 * byte + bit], _U(0))
        steps.append(table)
        columns = _append(table, columns)
    return steps


def _append(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & _U(255)] ^ table[1][crc >> _U(8) & _U(255)] ^ table[2][crc >> _U(16) & _U(255)] ^ table[3][crc >> _U(24)]


_STEPS = _crc_steps()


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings after each other, from their own CRCs and the second's length."""
    crc = first.copy()
    for j in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero(length >> j & 1)
        crc[at] = _append(_STEPS[j], crc[at])
    return crc ^ second


def _observed(least: int, slips: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = plain_strings(batch.column(1)), pc.fill_null(batch.column(0), "").to_pylist()
            for first, last in text_slices(texts):
                found = counted_terms(texts.slice(first, last - first), latin_letters)
                lengths = pc.utf8_length(found.terms).to_numpy(zero_copy_only=False)
                sizes = pc.binary_length(found.terms).to_numpy(zero_copy_only=False).astype(np.int64)
                long = np.flatnonzero(lengths >= least)
                own = np.zeros(len(lengths), _U)
                own[long] = [zlib.crc32(t.encode()) for t in found.terms.take(pa.array(long)).to_pylist()]
                mine = np.flatnonzero(lengths[found.code] >= least)
                doc, code, n = found.doc[mine], found.code[mine], found.n[mine]
                opened = np.array([zlib.crc32(f"{i}:".encode()) for i in ids[first:last]], _U)
                h = joined_crc(opened[doc], own[code], sizes[code])
                slip = h % _U(slips) == 0
                total = np.bincount(code[~slip], n[~slip], len(lengths)).astype(np.int64)
                missed: Counter = Counter()
                at = np.flatnonzero(slip)
                for word, where, k in zip(found.terms.take(pa.array(code[at])).to_pylist(), h[at].tolist(), n[at].tolist()):
                    where %= len(word)
                    if len(word) > least:
                        missed[word[:where] + word[where + 1:]] += k
                whole = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([found.terms.take(pa.array(whole)).cast(pa.string()), pa.array(missed.keys(), pa.string())]),
                     pa.concat_arrays([pa.array(total[whole]), pa.array(missed.values(), pa.int64())])], ["word", "n"])
    return run


def observed_words(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
                   least_count: int = LEAST_COUNT, slips: int = SLIPS) -> DataFrame:
    """``(word, n)``: the words of whole texts, read with a character missing in one of ``slips`` (document, word) pairs.

    Which ones is told by the CRC-32 of ``<doc_id>:<word>``; NULL ids count as empty there. NULL texts have no words;
    repeated rows count again; no rows give no words; other columns are not looked at.
    """
    rows = typed(docs, {"doc_id": (doc_id, "string"), "text": (text, "string")})
    counted = rows.mapInArrow(freeing(_observed(least_length, slips)), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _half(length: Column) -> Column:
    return F.floor(length / 2).cast("int")


def _keys(entries: list[tuple[Column, Column, Column, Column]]) -> Column:
    """Structs (part, key, rest) of (length, part, gram, rest of the word)."""
    return F.array(*[F.struct(part.alias("part"), F.xxhash64(length, part, gram).alias("key"), rest.alias("rest"))
                     for length, part, gram, rest in entries])


def _chunks(words: DataFrame) -> DataFrame:
    """Two disjoint chunks of every word."""
    word, length = F.col("word"), F.length("word")
    half = _half(length)
    front, back = F.substring(word, F.lit(1), half), F.substring(word, half + 1, length)
    return words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(_keys([
        (length, F.lit(0), front, back), (length, F.lit(1), back, front)])).alias("k")).select("a", "a_n", "k.*")


def _grams(words: DataFrame) -> DataFrame:
    """The positional grams of every word that can equal a chunk of an equally long word or of one longer by one."""
    word, m = F.col("word"), F.length("word")
    entries = []
    for length in (m, m + 1):
        half = _half(length)
        shifted = half + (m - length)  # where the second chunk lies in this word
        entries += [(length, F.lit(0), F.substring(word, F.lit(1), half), F.substring(word, half + 1, m)),
                    (length, F.lit(1), F.substring(word, shifted + 1, m), F.substring(word, F.lit(1), shifted))]
    return words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode(_keys(entries)).alias("k")).select("b", "b_n", "k.*")


def _refined(key: Column, rest: Column, every: Column, own: Column) -> Column:
    """Keys of a common chunk by the rest of the word: with each place left out where ``every``, and the rest itself
    where ``own``; the place counts where both words leave one out."""
    size = F.length(rest)
    without = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(
        F.substring(rest, F.lit(1), i - 1), F.substring(rest, i + 1, size)))
    replaced = F.transform(without, lambda w, i: F.xxhash64(key, i, w))
    removed = F.transform(without, lambda w: F.xxhash64(key, F.lit(-1), w))
    none = F.array().cast("array<bigint>")
    return F.array_distinct(F.concat(F.when(size > 0, F.concat(replaced, F.when(every, removed).otherwise(none))).otherwise(none),
                                     F.when(own, F.array(F.xxhash64(key, F.lit(-1), rest))).otherwise(none)))


def near_pairs(words: DataFrame, common: int = COMMON) -> DataFrame:
    """``(a, a_n, b, b_n)``: every two of the distinct ``words (word, n)`` at one edit, once, the longer as ``a``."""
    chunks, grams = _chunks(words), _grams(words)
    sizes = cut_lineage(chunks.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > common).select(F.col("key").alias("hot")))
    marked_a = chunks.join(sizes, F.col("key") == F.col("hot"), "left")
    marked_b = grams.join(sizes, F.col("key") == F.col("hot"), "left")

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        both = left.join(right.withColumnRenamed("part", "b_part").drop("rest"), "key")
        ahead = (F.length("a") > F.length("b")) | (F.col("a") < F.col("b"))
        half = _half(F.length("a"))
        again = (F.col("part") == 1) & (F.substring("a", F.lit(1), half) == F.substring("b", F.lit(1), half))  # found by the first chunk
        return both.filter((F.col("part") == F.col("b_part")) & ahead & ~again & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")

    plain = met(marked_a.filter("hot IS NULL").drop("hot"), marked_b.filter("hot IS NULL").drop("hot"))
    fine = [side.filter("hot IS NOT NULL").drop("hot").withColumn("key", F.explode(_refined(F.col("key"), F.col("rest"), every, own)))
            for side, every, own in ((marked_a, F.lit(True), F.lit(False)), (marked_b, F.lit(False), F.lit(True)))]
    return plain.unionByName(met(*fine).distinct())


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of every word with a form: the end of its forms. Counts grow along forms, so paths are short
    and have no circle; each round doubles what is followed."""
    state = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(state.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        state = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return state


def variant_groups(words: DataFrame, *, times: int = TIMES) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for every row of the distinct ``words (word, n)``.

    Of the near words the most frequent (ties: the first in code-point order) is the form, if it has ``times`` the
    word's occurrences; the root is the last of the forms that follow, the word itself where there is none.
    """
    known = cut_lineage(words.select("word", "n"))
    pairs = cut_lineage(near_pairs(known))
    sides = pairs.select(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("m"), F.col("b").alias("w")).alias("near")).unionByName(
        pairs.select(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("m"), F.col("a").alias("w")).alias("near")))
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("best"))
    chosen = -F.col("best.m") >= times * F.col("n")
    formed = cut_lineage(known.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, F.col("best.w")).alias("form"), F.when(chosen, -F.col("best.m")).alias("form_n")))
    roots = _roots(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
