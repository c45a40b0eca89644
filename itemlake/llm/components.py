"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlake.llm.common import cut_lineage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link every larger (or smaller) neighbour of a vertex to the least vertex around it.

    The least neighbour is a partially aggregated minimum and the join brings one row per vertex, so a
    vertex with very many links is spread over tasks.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))) if large else links
    least = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
    joined = both.join(least, both["a"] == least["v"]).withColumn("m", F.least("a", "m"))
    if large:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return moved.filter(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(vertex, root)`` for every vertex of ``links (a, b)`` except the roots, the least of each class.

    Large and small stars alternate until nothing changes; each round is written to the shared folder.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state = cut_lineage(pairs.filter(F.col("a") > F.col("b")).distinct())
    seen = None
    while True:
        sign = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sign == seen or not sign[0]:
            return state.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        seen = sign
        state = cut_lineage(_star(_star(state, True), False))
