"""Helpers shared by the operators: typed inputs, written stages, prefix sums over tasks."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemlake.session import cut_lineage, new_folder

__all__ = ["bitmap", "cut_lineage", "freeing", "in_bitmap", "may_match", "new_folder", "small_batches", "read", "typed", "offsets_by_part", "tasks"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of texts that go to a Python worker at a time; texts are handled in slices of a few MiB.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES: a batch of whole texts is held several times."""
    now = int(re.sub(r"\D", "", spark.conf.get(_BATCH_SETTING)) or 0)
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def freeing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for a task; when it ends, unused memory goes back, as Python workers outlive tasks."""
    @functools.wraps(run)
    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc can trim
            ctypes.CDLL(None).malloc_trim(0)
    return task


def typed(df: DataFrame, columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Only the named inputs as ``{internal name: (column, type)}``; other columns cannot clash."""
    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`").cast(t).alias(n) for n, (c, t) in columns.items()])


def offsets_by_part(written: DataFrame, part: str, amount: str | Column, name: str) -> DataFrame:
    """Per task that wrote ``written`` the sum of ``amount`` over all tasks before it.

    There is one row per writing task, however long the tasks' rows, so one ordered window and a
    broadcast of its result stay small: sixteen bytes for every file of the table.
    """
    amount = F.col(amount) if isinstance(amount, str) else amount
    totals = written.groupBy(part).agg(F.sum(amount).alias("__total"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, F.coalesce(F.sum("__total").over(before), F.lit(0)).cast("long").alias(name))


def tasks(spark: SparkSession) -> int:
    """Partitions for an exchange whose rows are dealt by a key."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bits of a filter for an exact join that follows; its size does not depend on the data (1 MiB).
FILTER_BITS = 1 << 23


def bitmap(rows: DataFrame, column: str) -> np.ndarray:
    """Filter of the hashes in a column, put together by Spark in words of 64 bits: at most
    FILTER_BITS / 64 rows come back. The fuller it is the less it keeps off; it never drops a match."""
    bit = F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1))
    words = np.zeros(FILTER_BITS // 64, np.int64)
    for r in (rows.groupBy(F.shiftright(bit, 6).cast("int").alias("word"))
              .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits"))
              .toLocalIterator()):
        words[r["word"]] = r["bits"]
    return words.view(np.uint8)


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes & np.uint64(FILTER_BITS - 1)
    return (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def may_match(bits: np.ndarray, column: str) -> Column:
    """Whether a hash column's value can be among those of the filter."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for hashes in batches:
            yield pa.array(in_bitmap(bits, hashes.to_numpy(zero_copy_only=False).view(np.uint64)))
    return F.arrow_udf(run, "boolean")(F.col(column))
