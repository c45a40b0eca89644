"""Line dedup by site-relative frequency.

Per host, the pages that contain a line are divided by all pages of the host; lines above a ratio
are boilerplate and are dropped from the host's pages. Copies of a page count once, so a page is not
taken apart because it was fetched often. At most (lines per page / ratio) lines of a host can be
boilerplate, however many pages it has, so the list joined to its pages is short by nature. Long lines, which
do not repeat on a host by chance, can have a lower ratio of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlake.llm.common import cut_lineage, typed

RATIO = 0.1
MIN_PAGES = 5
LONG_CHARS = 40


def boilerplate_lines(docs: DataFrame, *, host: str = "source", text: str = "text", ratio: float = RATIO,
                      min_pages: int = MIN_PAGES, long_ratio: float | None = None) -> DataFrame:
    """``(host, lines)``: hashes of the lines on at least ``min_pages`` pages and on more than ``ratio`` of
    the host's pages; ``long_ratio``, where given, holds instead for lines of LONG_CHARS characters or more.
    Lines of blanks only are none."""
    inputs = typed(docs, {"host": (host, "string"), "text": (text, "string")}).filter(F.col("text").isNotNull())
    pages = inputs.select("host", F.xxhash64("text").alias("page"), "text")
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    hashed = F.array_distinct(F.transform(lines, lambda x: F.struct(
        F.xxhash64(x).alias("line"), (F.length(F.trim(x)) >= LONG_CHARS).alias("long"))))
    counted = (pages.select("host", "page", F.explode(hashed).alias("l")).select("host", "page", "l.line", "l.long")
               .groupBy("host", "line", "long").agg(F.count_distinct("page").alias("pages"))
               .filter(F.col("pages") >= min_pages))
    totals = (pages.groupBy("host").agg(F.count_distinct("page").alias("host_pages"))
              .withColumnRenamed("host", "__host"))
    return (counted.join(totals, F.col("host").eqNullSafe(F.col("__host")))
            .filter(F.col("pages") / F.col("host_pages") > F.when(F.col("long"), ratio if long_ratio is None else long_ratio).otherwise(ratio))
            .groupBy("host").agg(F.collect_set("line").alias("lines")))


def drop_boilerplate(docs: DataFrame, *, host: str = "source", text: str = "text", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES, long_ratio: float | None = None, counts: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; no row is dropped.

    With ``counts`` also ``n_lines`` and ``n_dropped``. A NULL text stays NULL with no lines; an empty one
    has one (empty) line; a text of boilerplate only becomes empty; rows without host are one host.
    """
    lists = cut_lineage(boilerplate_lines(docs, host=host, text=text, ratio=ratio, min_pages=min_pages, long_ratio=long_ratio))
    marked = lists.select(F.col("host").alias("__host"), F.col("lines").alias("__drop"))
    joined = docs.join(marked, F.col(f"`{host}`").cast("string").eqNullSafe(F.col("__host")), "left")
    own = F.split(F.col(f"`{text}`").cast("string"), "\n", -1)
    kept = F.when(F.col("__drop").isNull(), own).otherwise(
        F.filter(own, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__drop"), F.xxhash64(x))))
    columns = [F.array_join(kept, "\n").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        n = F.coalesce(F.size(own), F.lit(0))
        n = F.when(F.col(f"`{text}`").isNull(), 0).otherwise(n).cast("long")
        left = F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(kept)).cast("long")
        columns += [n.alias("n_lines"), (n - left).alias("n_dropped")]
    return joined.select(*columns)
