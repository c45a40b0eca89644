"""Document fingerprints from content-defined chunks.

A gear hash of the last WINDOW bytes says where a text may be cut. Chunk sizes are normalised: up to
the usual size a cut needs more zero bits than after it. Cuts depend on nearby bytes only, so an
edit changes the chunks around it and leaves the others, wherever they move. A fingerprint is the set of
chunk digests with their lengths; likeness is the length of common chunks against all, containment
against one side's.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlake.llm.common import freeing, tasks, typed
from itemlake.llm.encode import plain_strings, text_slices
from itemlake.llm.words import VALUES, mix, span_hashes

WINDOW = 8  # bytes; not above LEAST, so a cut never looks beyond its own chunk
LEAST, USUAL, MOST = 8, 32, 128
STRICT_BITS, LOOSE_BITS = 6, 4
_GEAR = mix(VALUES + np.uint64(1))
_U = np.uint64


def _cuts(start: int, end: int, strict: list[int], loose: list[int]) -> Iterator[int]:
    """Ends of the chunks of one text; ``strict`` and ``loose`` are sorted places where it may be cut."""
    while end - start > LEAST:
        usual = start + USUAL
        i = bisect_left(strict, start + LEAST)
        if i < len(strict) and strict[i] < usual:
            cut = strict[i]
        else:
            i = bisect_left(loose, usual)
            cut = loose[i] if i < len(loose) and loose[i] < start + MOST else start + MOST
        if cut >= end:
            break
        yield cut
        start = cut
    if end > start:
        yield end


def chunk_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct chunks of each text, each chunk as (32-bit digest << 8 | length)."""
    texts = plain_strings(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = (offsets - offsets[0]).tolist()
    gear, span = _GEAR[raw], 1
    with np.errstate(over="ignore"):
        while span < WINDOW:
            gear[span:] = gear[span:] + (gear[:-span] << _U(span))
            span *= 2
    gear *= _U(0x9E3779B97F4A7C15)
    loose = np.flatnonzero(gear >> _U(64 - LOOSE_BITS) == 0)
    strict = loose[gear[loose] >> _U(64 - STRICT_BITS) == 0] + 1
    loose = loose + 1
    in_loose, in_strict = np.searchsorted(loose, bounds), np.searchsorted(strict, bounds)
    ends: list[int] = []
    counts = []
    for i in range(len(bounds) - 1):
        before = len(ends)
        ends.extend(_cuts(bounds[i], bounds[i + 1], strict[in_strict[i]:in_strict[i + 1]].tolist(),
                          loose[in_loose[i]:in_loose[i + 1]].tolist()))
        counts.append(len(ends) - before)
    last = np.array(ends, np.int64)
    first = np.concatenate([[0], last[:-1]])[:len(last)]
    digests = span_hashes(VALUES[raw], first, last) if len(last) else np.zeros(0, np.uint64)
    chunks = ((digests >> _U(32)) << _U(8)) | (last - first).astype(np.uint64)
    places = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return [np.unique(chunks[a:b]) for a, b in zip(places[:-1], places[1:])]


def as_text(chunks: np.ndarray) -> str:
    """A fingerprint as hexadecimal text, ten digits per chunk."""
    return np.ascontiguousarray(chunks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 5)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 3:] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def _length(chunks: np.ndarray) -> int:
    return int((chunks & _U(255)).sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Bytes of common chunks divided by bytes of all; two empty texts are alike."""
    both = _length(np.intersect1d(a, b, assume_unique=True))
    every = _length(a) + _length(b) - both
    return both / every if every else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of ``a``'s bytes that lie in chunks which ``b`` has too; an empty text is contained."""
    own = _length(a)
    return _length(np.intersect1d(a, b, assume_unique=True)) / own if own else 1.0


def fingerprint(text: str | Column) -> Column:
    """Fingerprint of a text column; NULL counts as empty."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            texts = plain_strings(texts)
            yield pa.array([as_text(c) for a, b in text_slices(texts, 1 << 20) for c in chunk_sets(texts.slice(a, b - a))],
                           pa.string())
    return F.arrow_udf(run, "string")(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, contained_edited double, contained_next double")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (bucket, guest, doc_id); each is compared with the row after it in its bucket."""
    held = None
    for batch in batches:
        texts = plain_strings(batch.column(3))
        for a, b in text_slices(texts, 1 << 20):
            part = texts.slice(a, b - a)
            rows = list(zip(*[batch.column(i).slice(a, b - a).to_pylist() for i in range(3)], part.to_pylist(), chunk_sets(part)))
            rows = ([held] if held else []) + rows
            pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x[1] and x[0] == y[0]]
            held = rows[-1]
            edited = [x[3][:len(x[3]) - len(x[3]) // 4] + y[3][:len(x[3]) // 4] for x, y in pairs]
            after = [c for p, q in text_slices(plain_strings(pa.array(edited, pa.string())), 1 << 20)
                     for c in chunk_sets(pa.array(edited[p:q], pa.string()))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[2] for x, _ in pairs], pa.int64()), pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                 pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                 pa.array([as_text(x[4]) for x, _ in pairs], pa.string()), pa.array([as_text(c) for c in after], pa.string()),
                 pa.array([likeness(x[4], c) for (x, _), c in zip(pairs, after)], pa.float64()),
                 pa.array([likeness(x[4], y[4]) for x, y in pairs], pa.float64()),
                 pa.array([containment(x[4], c) for (x, _), c in zip(pairs, after)], pa.float64()),
                 pa.array([containment(x[4], y[4]) for x, y in pairs], pa.float64())],
                [f.split()[0] for f in RESULT.split(", ")])


def compare_with_edits(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, their likeness and containment.

    ``contained_edited`` and ``contained_next`` are the shares of the document's bytes that lie in chunks which the
    edited text, the next document has too.

    In the edited text the last quarter of the characters (rounded down) is replaced by as many from the
    start of the next document in ascending id order, or all it has; after the last comes the first.

    NULL texts count as empty; rows without id come first; rows with equal ids follow in the order of a
    hash of their texts; a single row is its own next; no rows give none.

    Documents are dealt into ranges of ids, and each range also gets the first document of the next
    one, so texts are moved once. Range borders and least ids (one each per range) pass the driver.
    """
    spark = docs.sparkSession
    inputs = typed(docs, {"doc_id": (doc_id, "long"), "text": (text, "string")}).na.fill({"text": ""})
    ranges = 3 * tasks(spark)
    borders = np.array(sorted(set(inputs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges))))

    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            at = np.searchsorted(borders, ids.fill_null(0).to_numpy(zero_copy_only=False), "right")
            yield pa.array(np.where(np.asarray(ids.is_null()), -1, at).astype(np.int32))

    placed = inputs.withColumn("bucket", F.arrow_udf(place, "int")("doc_id")).select("bucket", "doc_id", "text")
    least = sorted(tuple(r) for r in placed.groupBy("bucket").agg(F.min("doc_id")).collect())
    before = {b: least[i - 1][0] for i, (b, _) in enumerate(least)}
    heads = spark.createDataFrame([(before[b], i) for b, i in least] or [(0, 0)], "to int, id long").filter(F.lit(bool(least)))
    guests = (inputs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("id")))
              .select(F.col("to").alias("bucket"), F.lit(1).alias("guest"), "doc_id", "text"))
    rows = placed.select("bucket", F.lit(0).alias("guest"), "doc_id", "text").union(guests)
    ordered = (rows.repartition(tasks(spark), "bucket")
               .sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text")))
    return ordered.mapInArrow(freeing(_compare), RESULT)
