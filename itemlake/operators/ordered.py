"""Ordered scans that never put a whole group into one task.

A plain ``Window.partitionBy(doc)`` sorts every row of a document in one task, which fails
when one document, user or paper holds a large share of all rows. Here a group is cut into
*buckets*: runs of rows that are consecutive in the order. Each bucket is scanned on its own,
buckets are summarised by a partially aggregated ``groupBy``, the few summary rows of a group
are scanned, and each bucket takes over what its neighbours carry to it. All windows share one
shuffle on ``(keys, buckets)``, and the join with the summaries keeps that partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65536


def by_range(order: str | Column, chunk: int = CHUNK) -> Column:
    """Bucket of a whole-number order column; at most ``chunk`` rows when it is unique."""
    column = F.col(order) if isinstance(order, str) else order
    return F.floor(column / F.lit(chunk)).cast("long")


def by_hash_prefix(digest: str) -> Column:
    """Bucket of a hexadecimal digest used as the order: 4096 even slices of a group."""
    return F.substring(digest, 1, 3)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    buckets: Sequence[Column] | None = None,
    position: str | None = None,
    running: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    prior: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add columns computed along ``order`` within ``keys``.

    ``position``  0-based dense position of the row.
    ``running``   running sum up to and including the row (NULL counts as 0).
    ``last``      last non-NULL value at or before the row.
    ``prior``     last non-NULL value strictly before the row.
    ``following`` first non-NULL value strictly after the row.

    ``order`` must not be NULL and must be unique within ``keys``. Rows with a NULL key are kept,
    but nothing is carried to them from other buckets.
    ``buckets`` must not decrease along the order; by default ranges of the first order column.
    """
    running, last = dict(running or {}), dict(last or {})
    prior, following = dict(prior or {}), dict(following or {})
    buckets = list(buckets or [by_range(order[0])])
    slots = [f"__b{i}" for i in range(len(buckets))]
    keys, order = list(keys), list(order)
    scan_key = F.col(order[0]) if len(order) == 1 else F.struct(*order)

    tagged = df.withColumns(dict(zip(slots, buckets)))
    forward = Window.partitionBy(*keys, *slots).orderBy(*order)
    upto = forward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = forward.rowsBetween(Window.unboundedPreceding, -1)
    after = (Window.partitionBy(*keys, *slots).orderBy(*[F.desc(c) for c in order])
             .rowsBetween(Window.unboundedPreceding, -1))

    local: dict[str, Column] = {}
    summary: dict[str, Column] = {}
    carried: dict[str, Column] = {}
    result: dict[str, Column] = {}
    earlier = Window.partitionBy(*keys).orderBy(*slots).rowsBetween(Window.unboundedPreceding, -1)
    later = (Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in slots])
             .rowsBetween(Window.unboundedPreceding, -1))

    def known(value: Column) -> Column:
        return F.when(value.isNotNull(), scan_key)

    if position:
        local["__l_pos"] = F.row_number().over(forward).cast("long")
        summary["__s_pos"] = F.count(F.lit(1))
        carried["__c_pos"] = F.sum("__s_pos").over(earlier)
        result[position] = F.col("__l_pos") - 1 + F.coalesce("__c_pos", F.lit(0))
    for name, value in running.items():
        amount = F.coalesce(value, F.lit(0)).cast("long")
        local[f"__l_{name}"] = F.sum(amount).over(upto)
        summary[f"__s_{name}"] = F.sum(amount)
        carried[f"__c_{name}"] = F.sum(f"__s_{name}").over(earlier)
        result[name] = F.col(f"__l_{name}") + F.coalesce(f"__c_{name}", F.lit(0))
    for wanted, frame in ((last, upto), (prior, before)):
        for name, value in wanted.items():
            local[f"__l_{name}"] = F.last(value, True).over(frame)
            summary[f"__s_{name}"] = F.max_by(value, known(value))
            carried[f"__c_{name}"] = F.last(f"__s_{name}", True).over(earlier)
            result[name] = F.coalesce(f"__l_{name}", f"__c_{name}")
    for name, value in following.items():
        local[f"__l_{name}"] = F.last(value, True).over(after)
        summary[f"__s_{name}"] = F.min_by(value, known(value))
        carried[f"__c_{name}"] = F.last(f"__s_{name}", True).over(later)
        result[name] = F.coalesce(f"__l_{name}", f"__c_{name}")

    summaries = tagged.groupBy(*keys, *slots).agg(*[c.alias(n) for n, c in summary.items()])
    carries = summaries.select(*keys, *slots, *[c.alias(n) for n, c in carried.items()])
    joined = tagged.withColumns(local).join(carries, [*keys, *slots], "left")
    kept = [c for c in df.columns if c not in result]
    return joined.select(*kept, *[c.alias(n) for n, c in result.items()])


def ranked_by_digest(
    df: DataFrame, keys: Sequence[str], digest: Column, tie: str, position: str
) -> DataFrame:
    """0-based position of each row in the order of ``digest`` then ``tie`` within ``keys``."""
    hashed = df.withColumn("__digest", digest)
    ranked = ordered_scan(hashed, keys, ["__digest", tie],
                          buckets=[by_hash_prefix("__digest")], position=position)
    return ranked.drop("__digest")
