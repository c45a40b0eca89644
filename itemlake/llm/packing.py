"""Packing: concatenate and cut.

All documents' ids, each with an end id, form one long row of tokens that is cut every ``length``
tokens, so only the last sequence is not full. Pass one encodes the texts and writes their ids
once, each with its place inside its task; prefix sums over the tasks' totals turn these places
into places in the long row. Pass two cuts each document at the multiples of ``length`` and returns
a boundary record per piece. No row is moved between tasks, whatever the texts' lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlake.llm.common import cut_lineage, freeing, offsets_by_part, typed
from itemlake.llm.encode import encode_slices

LENGTH = 4096
ENCODED = "doc_id long, __part int, __at long, __n long, __ids binary"


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, ids in encode_slices(path, batch.column(1), end):
                counts = np.array([len(x) for x in ids], np.int64)
                starts = at + np.cumsum(counts) - counts
                at += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(starts),
                     pa.array(counts), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())],
                    ["doc_id", "__part", "__at", "__n", "__ids"])
    return run


def pack(docs: DataFrame, tokenizer: str, *, end: int = 2, length: int = LENGTH, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens.

    Columns: ``doc_id``; ``start`` (ids of the document before the piece); ``length``; ``ids`` (the
    piece, little-endian unsigned 32-bit); ``doc_tokens`` (with the end id); ``sequence_id`` and
    ``offset`` in it. Pieces of a sequence leave no gap; only the last sequence may be short.

    A NULL or empty text is its end id alone; a NULL ``doc_id`` stays NULL; equal rows are packed as
    often as they come; no rows give no pieces; other columns are not looked at.
    """
    inputs = typed(docs, {"doc_id": (doc_id, "long"), "text": (text, "string")})
    encoded = cut_lineage(inputs.mapInArrow(freeing(_encode(tokenizer, end)), ENCODED))
    bases = offsets_by_part(encoded, "__part", "__n", "__base")
    size = F.lit(length).cast("long")
    placed = (encoded.join(F.broadcast(bases), "__part")
              .withColumn("__from", F.col("__base") + F.col("__at")))

    def piece(window):
        low = F.greatest(F.col("__from"), window * size)
        high = F.least(F.col("__from") + F.col("__n"), (window + 1) * size)
        start = low - F.col("__from")
        return F.struct(
            start.alias("start"), (high - low).alias("length"),
            F.substring("__ids", (start * 4 + 1).cast("int"), ((high - low) * 4).cast("int")).alias("ids"),
            F.col("__n").alias("doc_tokens"), window.alias("sequence_id"), (low - window * size).alias("offset"))

    first = F.floor(F.col("__from") / size)
    last = F.floor((F.col("__from") + F.col("__n") - 1) / size)
    pieces = placed.select("doc_id", F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    return pieces.select("doc_id", "p.*")


def sequences(pieces: DataFrame, *, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """``(sequence_id, n_tokens, ids)``: the sequences themselves, as bytes.

    A short sequence is filled up with ``pad`` unless its length is a power of two. One row holds at
    most ``length`` tokens, so the groups are bounded.
    """
    grouped = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("__p"))
    joined = F.aggregate("__p", F.lit(b""), lambda whole, p: F.concat(whole, p["ids"]))
    filler = F.lit(int(pad).to_bytes(4, "little") * length)
    keep = F.expr("n_tokens & (n_tokens - 1)") == 0
    full = F.concat(joined, F.substring(filler, F.lit(1), ((F.lit(length) - F.col("n_tokens")) * 4).cast("int")))
    return grouped.select("sequence_id", "n_tokens", F.when(keep, joined).otherwise(full).alias("ids"))
