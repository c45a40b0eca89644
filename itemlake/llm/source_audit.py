"""How the sources of a language differ from it and from each other.

A term's share of a source or a language is smoothed by one and kept as a whole number of billionths, so all
arithmetic is exact. Two results come from the same counts:

* **Distinctive terms** by dominance. A term can only have a smaller value than one with a higher count in the source,
  a lower count in the language and an earlier spelling (each or equal). So a task keeps of the rows it has
  the *skyband*: terms that fewer than ``k`` others dominate, whatever the totals are. Skybands of tasks are merged to
  skybands of sources in two steps, which keep all of the first ``k``, and only these terms are ranked.
* **Distances of sources**, without comparing sources term by term where one of them has no occurrence: those
  parts depend on counts only and come from each source's histogram of counts. Only terms that two sources
  share are brought together, in cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemlake.llm.common import cut_lineage, freeing, tasks, typed
from itemlake.llm.encode import plain_strings, text_slices
from itemlake.llm.terms import any_letters, counted_terms

UNIT = 1_000_000_000
#: Documents of a language that a kept term is in; terms reported per source.
LEAST_DOCS, TOP = 3, 200
#: Rows of a source that are reduced at once, and rows a task holds before it gives its skybands away.
REDUCE, HELD = 32_768, 262_144
#: Slices of a source in the first merge of skybands.
MERGES = 16
#: Sources of one term that meet in a cell, and pairs that a task compares at once.
CELL, PAIRS = 512, 2_000_000


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, source, term, n, docs)`` of slices of texts."""
    for batch in batches:
        texts = plain_strings(batch.column(2))
        names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for first, last in text_slices(texts):
            own = sorted(set(names[first:last]))
            place = {g: i for i, g in enumerate(own)}
            group = np.array([place[g] for g in names[first:last]], np.int64)
            found = counted_terms(texts.slice(first, last - first), any_letters)
            width = max(1, len(found.terms))
            key, docs = group[found.doc] * width + found.code, np.ones(len(found.n), np.int64)
            order = np.argsort(key, kind="stable")
            start = np.flatnonzero(np.diff(key[order], prepend=-1))
            if not len(start):
                continue
            at = key[order][start]
            langs, sources = (pa.array([g[i] for g in own], pa.string()).take(pa.array(at // width)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [langs, sources, found.terms.take(pa.array(at % width)).cast(pa.string()),
                 pa.array(np.add.reduceat(found.n[order], start)), pa.array(np.add.reduceat(docs, start))],
                ["lang", "source", "term", "n", "docs"])


def skyband(terms: pa.Array, high: np.ndarray, low: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that fewer than ``k`` others dominate: not below in ``high``, not above in ``low`` and
    earlier in UTF-8. Terms are distinct.

    Whoever is dominated by ``k`` rows is dominated by ``k`` rows of the skyband, so rows are counted against
    those kept before, in an order in which dominating rows come first.
    """
    rank = np.empty(len(high), np.int64)
    rank[pc.sort_indices(terms).to_numpy()] = np.arange(len(high))
    order = np.lexsort((rank, low, -high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    order = order[nth < k]  # of equal counts only the first k spellings can stay
    kept_low, kept_rank = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    kept, m = [], 0
    for i in order.tolist():
        if m < k or np.count_nonzero((kept_low[:m] <= low[i]) & (kept_rank[:m] < rank[i])) < k:
            kept_low[m], kept_rank[m] = low[i], rank[i]
            m += 1
            kept.append(i)
    return np.array(kept, np.int64)


def _skybands(k: int):
    """Rows ``(gid, term, high, low)`` to the skybands of their groups, as far as this task sees them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        size: dict[int, int] = {}

        def reduce(gid: int) -> None:
            rows = pa.Table.from_batches(held[gid]).combine_chunks()
            at = skyband(rows.column(1).chunk(0), rows.column(2).to_numpy(), rows.column(3).to_numpy(), k)
            held[gid] = rows.take(pa.array(at)).combine_chunks().to_batches()
            size[gid] = len(at)

        for batch in batches:
            gids = batch.column(0).to_numpy()
            order = np.argsort(gids, kind="stable")
            edges = [*np.flatnonzero(np.diff(gids[order], prepend=gids.min(initial=0) - 1)).tolist(), len(order)]
            for a, b in zip(edges, edges[1:]):
                gid = int(gids[order[a]])
                held.setdefault(gid, []).append(batch.take(pa.array(order[a:b])))
                before, size[gid] = size.get(gid, 0), size.get(gid, 0) + b - a
                if size[gid] // REDUCE > before // REDUCE:
                    reduce(gid)
            if sum(size.values()) > HELD:  # many groups: give away what is known of them
                for gid in held:
                    reduce(gid)
                    yield from held[gid]
                held, size = {}, {}
        for gid in held:
            reduce(gid)
            yield from held[gid]
    return run


def term_skybands(rows: DataFrame, k: int = TOP) -> DataFrame:
    """The rows of ``rows (gid long, term, high, low)`` that fewer than ``k`` of their group dominate.

    First where the rows lie, without a shuffle; what is left is merged in slices of a group and then per group.
    """
    kind = "gid long, term string, high long, low long"
    local = rows.select("gid", "term", "high", "low").mapInArrow(freeing(_skybands(k)), kind)
    sliced = local.repartition(tasks(rows.sparkSession), "gid", F.pmod(F.xxhash64("term"), F.lit(MERGES)))
    return (sliced.mapInArrow(freeing(_skybands(k)), kind).repartition(tasks(rows.sparkSession), "gid")
            .mapInArrow(freeing(_skybands(k)), kind))


def _share(count: str, total: str, terms: str) -> Column:
    """Billionths of a smoothed share; decimals, since counts of a corpus times a billion pass 64 bits."""
    return F.expr(f"1 + coalesce(cast({UNIT} as decimal(10, 0)) * cast({count} + 1 as decimal(20, 0))"
                  f" div nullif(cast({total} + {terms} as decimal(20, 0)), cast(0 as decimal(20, 0))), 0L)")


def _value(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms that two sources share add to the distance: ``(a, b, value)`` summed per pair; the rows
    ``(tid, cell, half, across, gid, p, p0)`` come sorted by cell."""
    def compare(rows: list[np.ndarray], sizes: np.ndarray) -> pa.RecordBatch:
        half, across, gid, p, p0 = rows
        start = np.repeat(np.cumsum(sizes) - sizes, sizes)
        width = np.repeat(sizes, sizes)
        left = np.repeat(np.arange(len(gid)), width)
        right = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width) + start[left]
        wanted = (left != right) & (~across[left] | (half[left] != half[right]))
        left, right = left[wanted], right[wanted]

        def f(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return (x[left] - y[right]) ** 2 // y[right]
        value = f(p, p) - f(p, p0) - f(p0, p) + f(p0, p0)
        names, place = np.unique(gid, return_inverse=True)
        pair = place[left] * len(names) + place[right]
        order = np.argsort(pair, kind="stable")
        first = np.flatnonzero(np.diff(pair[order], prepend=-1))
        at = pair[order][first]
        return pa.RecordBatch.from_arrays(
            [pa.array(names[at // len(names)]), pa.array(names[at % len(names)]),
             pa.array(np.add.reduceat(value[order], first) if len(first) else np.zeros(0, np.int64))], ["a", "b", "value"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = rows if held is None else [np.concatenate([h, r]) for h, r in zip(held, rows)]
        new = np.flatnonzero(np.diff(held[0], prepend=held[0][:1] - 1) | np.diff(held[1], prepend=0))
        cut = int(new[-1]) if len(new) else 0  # the last cell may go on
        yield from _bounded(compare, [h[:cut] for h in held])
        held = [h[cut:] for h in held]
    if held is not None:
        yield from _bounded(compare, held)


def _bounded(compare, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """``compare`` on runs of whole cells with about PAIRS pairs."""
    if not len(rows[0]):
        return
    start = np.flatnonzero(np.diff(rows[0], prepend=rows[0][0] - 1) | np.diff(rows[1], prepend=0))
    sizes = np.diff(np.append(start, len(rows[0])))
    run = np.cumsum(sizes ** 2) // PAIRS
    for r in np.unique(run):
        mine = np.flatnonzero(run == r)
        a, b = start[mine[0]], start[mine[-1]] + sizes[mine[-1]]
        yield compare([x[a:b] for x in rows[2:]], sizes[mine])


def _distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``(a, b, value)`` for every two groups of a language.

    With p0 for the share of a term that does not occur, the sum over all terms of f(pa, pb) is the sum of f(pa, p0b)
    over a's histogram, plus that of f(p0a, pb) - f(p0a, p0b) over b's, plus what the shared terms differ from both.
    """
    spark = kept.sparkSession
    seen = kept.groupBy("gid", "n").agg(F.count(F.lit(1)).alias("k"))
    absent = groups.select("gid", F.lit(0).cast("long").alias("n"), (F.col("terms") - F.col("own")).alias("k"))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / F.lit(64)).cast("int").alias("blocks"))
    dealt = groups.join(blocks, "lang")
    hist = (seen.unionByName(absent).join(dealt, "gid")
            .select("lang", "gid", "n", "k", _share("n", "total", "terms").alias("p"), "p0",
                    F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    others = dealt.select("lang", F.col("gid").alias("other"), F.col("p0").alias("o0"),
                          F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int").alias("block"))
    met = hist.join(others, ["lang", "block"]).filter("gid <> other")
    sides = F.array(
        F.struct(F.col("gid").alias("a"), F.col("other").alias("b"), (F.col("k") * _value("p", "o0")).alias("value")),
        F.struct(F.col("other").alias("a"), F.col("gid").alias("b"), F.when(F.col("n") > 0, F.col("k") * (
            _value("o0", "p") - _value("o0", "p0"))).otherwise(F.lit(0).cast("long")).alias("value")))
    by_counts = met.select(F.explode(sides).alias("s")).select("s.*")

    cells = F.ceil(F.col("spread") / F.lit(CELL)).cast("int")
    mine = F.pmod(F.xxhash64("gid"), cells).cast("int")
    place = F.transform(F.sequence(F.lit(0), cells - 1), lambda j: F.struct(
        (F.least(j, mine).cast("long") * cells + F.greatest(j, mine)).alias("cell"), (mine > j).cast("int").alias("half"),
        (mine != j).alias("across")))
    dealt = (kept.filter("spread > 1").join(groups.select("gid", "total", "terms", "p0"), "gid")
             .select("tid", F.explode(place).alias("c"), "gid", _share("n", "total", "terms").alias("p"), "p0")
             .select("tid", "c.*", "gid", "p", "p0")
             .repartition(tasks(spark), "tid", "cell").sortWithinPartitions("tid", "cell"))
    shared = dealt.mapInArrow(freeing(_shared), "a long, b long, value long")
    return by_counts.unionByName(shared).groupBy("a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", top: int = TOP,
          least: int = LEAST_DOCS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` has a row for every other source of the language, part
    ``term`` the ``top`` terms with a larger share in the source than in the language.

    NULL in any of the three columns counts as the empty string; repeated rows are documents of their own; a
    source without kept terms has a share of every kept term too, and a language without any gives value 0 for its
    pairs and no terms. No rows give none; other columns are not looked at. Equal values rank by UTF-8.
    """
    rows = typed(docs, {"lang": (lang, "string"), "source": (source, "string"), "text": (text, "string")}).na.fill("")
    counts = cut_lineage(
        rows.mapInArrow(freeing(_counts), "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = cut_lineage(
        counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("spread"))
        .filter(F.col("docs") >= least).drop("docs").withColumn("tid", F.monotonically_increasing_id()))
    present = rows.select("lang", "source").distinct()
    of_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_total"))
    named = cut_lineage(present.withColumn("gid", F.monotonically_increasing_id()))
    kept = cut_lineage(counts.drop("docs").join(terms, ["lang", "term"]).join(named, ["lang", "source"])
                       .select("gid", "tid", "term", "n", "all", "spread"))
    of_group = kept.groupBy("gid").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    groups = cut_lineage(
        named.join(of_group, "gid", "left").join(of_lang, "lang", "left").na.fill(0)
        .withColumn("p0", _share("0L", "total", "terms")))

    distances = _distances(kept, groups)
    names = groups.select(F.col("gid").alias("b"), F.col("source").alias("item"))
    pairs = distances.join(names, "b").select(F.col("a").alias("gid"), F.lit("pair").alias("part"), "item", "value")
    shares = (kept.join(groups.select("gid", "total", "terms", "lang_total"), "gid")
              .select("gid", "term", F.col("n").alias("high"), F.col("all").alias("low"),
                      _share("n", "total", "terms").alias("p"), _share("all", "lang_total", "terms").alias("q")))
    best = term_skybands(shares.filter("p > q"), top)
    ranked_terms = (best.join(groups.select("gid", "total", "terms", "lang_total"), "gid")
                    .select("gid", "term", _share("high", "total", "terms").alias("p"), _share("low", "lang_total", "terms").alias("q"))
                    .select("gid", F.lit("term").alias("part"), F.col("term").alias("item"), _value("p", "q").alias("value")))
    order = Window.partitionBy("gid", "part").orderBy(F.desc("value"), "item")
    ranked = (pairs.withColumn("rank", F.row_number().over(order)).unionByName(
        ranked_terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)))
    return ranked.join(groups.select("gid", "lang", "source"), "gid").select("lang", "source", "part", "item", "value", "rank")
