"""MinHash near-dedup with DartMinHash signatures.

Texts with equal words are one text from the start. A text's elements are its distinct shingles of five
words, all of weight 1, so signatures estimate the Jaccard similarity of sets that the exact check computes,
however often a shingle is repeated. The DartMinHash signature is cut into bands, and texts that agree in
a band meet in a bucket. In a bucket, texts are compared by whole signatures with *leaders*: a text
unlike all leaders so far becomes one, so a group of near copies costs a comparison per copy and not one
per pair. Buckets larger than a block are cut into blocks by hash and only the blocks' leaders go
on to the next level; a bucket whose leaders do not get fewer is split by further coordinates.
Which text leads differs from band to band, so links missed in one bucket are found in others.

A block gives a spanning forest of its links, and the links of all buckets join texts to *candidate groups*, loosely, so
that texts alike enough are in one group. Each group is then checked once, not bucket by bucket: the texts' shingle sets
come together in blocks of the group, pairs are compared there from the likeliest down, and only links that hold on the
exact sets and join two classes leave the task. So rows grow with the texts, never with their pairs, and a
failed pair is forgotten where it was met.

A group of one block is done then. Blocks of a larger group also hold some texts in common, which join what belongs
together across blocks. Only where classes are still apart do all blocks of the group meet once more; there texts of
the group's largest class meet just the others. Classes are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlake.llm.common import bitmap, cut_lineage, freeing, may_match, tasks, typed
from itemlake.llm.components import components
from itemlake.llm.dart_minhash import signatures
from itemlake.llm.words import Words, grams, mix, word_slices

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
#: Texts compared in one group at most.
BLOCK = 2048
#: Bytes of shingle sets in one block at most (one set may be larger), and texts that all blocks of a group hold.
BLOCK_BYTES, COMMON = 24 << 20, 64
#: Estimates from which texts are of one candidate group, from which a pair is checked (four standard deviations below
#: the threshold), and from which a text does not become a leader.
LOOSE, UNSURE, ALIKE = 0.60, 0.68, 0.84
#: Failed checks per text after which the sets of a block are compared all at once, and columns of that at a time.
FAILS, COLUMNS = 8, 2048
_U = np.uint64


def text_keys(words: Words) -> np.ndarray:
    """128-bit keys of the texts' word sequences; texts without words are told apart by their bytes."""
    out = np.zeros((len(words.bounds) - 1, 2), np.uint64)
    for half, base in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        with np.errstate(over="ignore"):
            place = np.arange(len(words.hashes)) - np.repeat(words.bounds[:-1], np.diff(words.bounds))
            spread = mix(words.hashes ^ _U(base)) * mix(place.astype(np.uint64) * _U(base) + _U(1))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(spread))])
            out[:, half] = mix(sums[words.bounds[1:]] - sums[words.bounds[:-1]])
    for i in np.flatnonzero(np.diff(words.bounds) == 0):
        raw = words.raw[words.text_bounds[i]:words.text_bounds[i + 1]].astype(np.uint64)
        for half in (0, 1):
            with np.errstate(over="ignore"):
                place = np.arange(len(raw), dtype=np.uint64)
                out[i, half] = mix(np.uint64(len(raw) + 1) + mix(raw + (place << _U(8)) + _U(half << 60)).sum())
    return out


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, their counts, and bounds. A text with fewer than ``size``
    words, but not none, is one shingle."""
    lengths = np.diff(words.bounds)
    gram = grams(words.hashes, size)
    of = np.repeat(np.arange(len(lengths)), lengths)
    inside = words.bounds[1:][of[:len(gram)]] - np.arange(len(gram)) >= size
    values, owner = gram[inside], of[:len(gram)][inside]
    brief = np.flatnonzero((lengths > 0) & (lengths < size))
    whole = [grams(words.hashes[words.bounds[i]:words.bounds[i + 1]], int(lengths[i]))[0] for i in brief]
    values = np.concatenate([values, np.array(whole, np.uint64)])
    owner = np.concatenate([owner, brief])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(values)))
    return values[first], counts, np.searchsorted(owner[first], np.arange(len(lengths) + 1))


def _sign(size: int, bands: int, rows: int):
    k = bands * rows
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, last, w in word_slices(batch.column(2), 1 << 20):
                n = last - first
                values, _, bounds = shingles(w, size)
                signs = signatures(values, np.ones(len(values)), bounds, k)
                parts = signs.reshape(n, bands, rows).astype(np.uint64)
                with np.errstate(over="ignore"):
                    band = np.broadcast_to(salt, (n, bands)).copy()
                    for r in range(rows):
                        band = mix(band * _U(0xD6E8FEB86659FD93) + parts[:, :, r])
                empty = np.diff(bounds) == 0
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(empty, 0, bands))]).astype(np.int32)),
                    pa.array(band[~empty].reshape(-1).view(np.int64)))
                marks = (signs & np.uint32(255)).astype(np.uint8)
                keys = text_keys(w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + n)), batch.column(0).slice(first, n), batch.column(1).slice(first, n),
                     pa.array([x.tobytes() for x in keys], pa.binary()), lists,
                     pa.array([x.tobytes() for x in marks], pa.binary())],
                    ["uid", "doc_id", "text_key", "words_key", "bands", "marks"])
                uid += n
    return run


SIGNED = "uid long, doc_id long, text_key long, words_key binary, bands array<long>, marks binary"
LED = "a long, b long, bucket long, rest binary"


def _forest(size: int, found: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of a block's links: joins whatever they join, with fewer rows than texts."""
    taken: list[tuple[int, int]] = []
    joined = list(range(size))
    for links in found:
        for i, j in zip(*links.tolist()):
            a, b = i, j
            while joined[a] != a:
                joined[a] = a = joined[joined[a]]
            while joined[b] != b:
                joined[b] = b = joined[joined[b]]
            if a != b:
                joined[a] = b
                taken.append((i, j))
    return taken


def _estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    same = np.count_nonzero(x == y, axis=-1) / y.shape[-1]
    return (same - 1 / 256) / (1 - 1 / 256)


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaders and links of every (bucket, block); rows come sorted by them.

    A link is (text, leader); where a bucket has more blocks its leaders are also given back,
    with their marks, for the next level.
    """
    def groups():
        held: list[tuple] = []
        for batch in batches:
            bucket, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            uid = batch.column(2).to_numpy()
            width = len(batch.column(3)[0].as_py()) if len(bucket) else 0
            marks = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(bucket), width)
            more = batch.column(4).to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero((bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])) + 1,
                                    [len(bucket)]])
            for a, b in zip(edges[:-1], edges[1:]):
                if b <= a:
                    continue
                if held and (held[-1][0], held[-1][1]) != (bucket[a], block[a]):
                    yield held
                    held = []
                held.append((bucket[a], block[a], uid[a:b], marks[a:b], more[a]))
        if held:
            yield held

    def flush():
        names, kinds = ["a", "b", "bucket", "rest"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(4)], names)

    out: list[tuple] = []
    for held in groups():
        bucket, more = int(held[0][0]), bool(held[0][4])
        uid = np.concatenate([h[2] for h in held])
        marks = np.concatenate([h[3] for h in held])
        leaders = np.empty_like(marks)
        chosen: list[int] = []
        edges = []
        for i in range(len(uid)):
            like = _estimate(leaders[:len(chosen)], marks[i])
            at = np.flatnonzero(like >= LOOSE)
            if len(at):
                edges.append(np.stack([np.full(len(at), i), np.array(chosen)[at]]))
            if not len(like) or like.max() < ALIKE:
                leaders[len(chosen)] = marks[i]
                chosen.append(i)
        out.extend((int(uid[i]), int(uid[j]), None, None) for i, j in _forest(len(uid), edges))
        if more:
            out.extend((int(uid[i]), None, bucket, marks[i].tobytes()) for i in chosen)
        if len(out) > 20_000:
            yield flush()
            out = []
    yield flush()


def _split(rows: DataFrame, parts: int = 8, taken: int = 3) -> DataFrame:
    """The rows of buckets that did not shrink, in ``parts`` smaller buckets each: texts meet again where
    ``taken`` further coordinates agree."""
    size = F.length("marks")
    subs = [F.xxhash64(F.col("bucket"), F.lit(s), *[
        F.substring("marks", (F.pmod(F.xxhash64(F.col("bucket"), F.lit(s * taken + t)), size) + 1).cast("int"), F.lit(1))
        for t in range(taken)]) for s in range(parts)]
    return rows.select(F.explode(F.array(*subs)).alias("bucket"), "uid", "marks")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of every two sets, by products of the elements that several sets hold."""
    sizes = [len(x) for x in sets]
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    shared = count[place] > 1
    column, row = number[place[shared]], np.repeat(np.arange(len(sets)), sizes)[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[row[a:b], column[a:b] - low] = 1
        both += held @ held.T
    return both


def alike_links(uid: np.ndarray, marks: np.ndarray, sets: list[np.ndarray], own: np.ndarray, half: np.ndarray | None,
                similarity: float) -> list[tuple[int, int]]:
    """Links that join all texts of a block whose exact sets are alike, directly or over others; fewer than texts.

    ``own`` numbers the classes known so far, which need no link; with ``half`` only texts of different halves are compared.
    """
    found = []
    for i in range(len(uid) - 1):
        wanted = own[i + 1:] != own[i]
        if half is not None:
            wanted &= half[i + 1:] != half[i]
        at = np.flatnonzero(wanted) + i + 1
        if len(at):
            like = _estimate(marks[at], marks[i])
            near = like >= UNSURE
            if near.any():
                found.append(np.stack([np.full(near.sum(), i), at[near], like[near]]))
    if not found:
        return []
    left, right, like = np.concatenate(found, axis=1)
    order = np.argsort(-like, kind="stable")
    _, first, place = np.unique(own, return_index=True, return_inverse=True)
    joined, taken, failed, overlaps = first[place].tolist(), [], 0, None
    for i, j in zip(left[order].astype(int).tolist(), right[order].astype(int).tolist()):
        a, b = i, j
        while joined[a] != a:
            joined[a] = a = joined[joined[a]]
        while joined[b] != b:
            joined[b] = b = joined[joined[b]]
        if a == b:
            continue
        if overlaps is None and failed > FAILS * len(uid):
            overlaps = _overlaps(sets)
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True)) if overlaps is None else int(overlaps[i, j])
        if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
            joined[a] = b
            taken.append((int(uid[i]), int(uid[j])))
        else:
            failed += 1
    return taken


def _check(similarity: float):
    """The links of every (comp, block); rows ``(comp, block, uid, marks, shingles, class, half)`` come sorted by them."""
    def links(members: list[tuple]) -> list[tuple[int, int]]:
        uid, own = np.array([m[0] for m in members]), np.array([m[3] for m in members])
        marks = np.frombuffer(b"".join(m[1] for m in members), np.uint8).reshape(len(uid), -1)
        half = np.array([m[4] for m in members])
        return alike_links(uid, marks, [np.frombuffer(m[2], _U) for m in members], own, half if half.min() >= 0 else None, similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, out = None, [], []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for comp, block, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if (comp, block) != key:
                    out.extend(links(members) if len(members) > 1 else [])
                    key, members = (comp, block), []
                members.append(row)
            if len(out) > 20_000:
                yield flush()
                out = []
        out.extend(links(members) if len(members) > 1 else [])
        yield flush()
    return run


def _blocks(total: Column) -> Column:
    return F.greatest(F.ceil(total), F.lit(1)).cast("int")


def _own_blocks(texts: DataFrame) -> DataFrame:
    """Texts of candidate groups in blocks by hash; a few of a large group are in all of its blocks."""
    sized = texts.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), _blocks(F.sum("weight")).alias("blocks")).filter("n > 1")
    placed = texts.join(sized, "comp")
    mine = F.array(F.pmod(F.xxhash64("uid", F.lit(7)), "blocks").cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    common = F.pmod(F.xxhash64("uid", F.lit(11)), "n") < COMMON
    return placed.select("comp", F.explode(F.when(common, every).otherwise(mine).cast("array<string>")).alias("block"), "uid",
                         F.col("uid").alias("class"), F.lit(-1).alias("half"))


def _cells(classed: DataFrame) -> DataFrame:
    """``(comp, block, uid, class, half)`` for ``classed (comp, uid, class, weight)``, of groups of several blocks:
    places where all texts of different classes of a group meet.

    Texts of a group's largest class meet only the others: with few others a large class is not repeated.
    """
    kinds = classed.groupBy("comp", "class").agg(F.sum("weight").alias("k"))
    sized = (kinds.groupBy("comp").agg(F.sum("k").alias("all"), F.max(F.struct("k", "class")).alias("top"), F.count(F.lit(1)).alias("classes"))
             .filter("classes > 1 AND all > 1")  # all pairs of one block have met
             .select("comp", F.col("top.class").alias("main"), _blocks(F.col("top.k")).alias("mains"), _blocks(F.col("all") - F.col("top.k")).alias("others")))
    rows = classed.join(sized, "comp")
    main = F.col("class") == F.col("main")
    text = lambda *parts: F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    mine = F.pmod(F.xxhash64("uid", F.lit(7)), F.when(main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    cell = lambda name, half: F.struct(name.alias("block"), half.cast("int").alias("half"))
    with_other = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda x: cell(text("m", mine, x), F.lit(0)))
    with_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda x: cell(text("m", x, mine), F.lit(1)))
    among = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda x: cell(
        text("o", F.least(x, mine), F.greatest(x, mine)), F.when(mine == x, -1).otherwise((mine > x).cast("int"))))
    places = F.when(main, with_other).otherwise(F.concat(with_main, among))
    return rows.select("comp", "uid", "class", F.explode(places).alias("p")).select("comp", "p.block", "uid", "class", "p.half")


def shared_buckets(signed: DataFrame) -> DataFrame:
    """``(bucket, uid, n)`` of the buckets in which ``n > 1`` texts of ``signed (uid, bands)`` meet."""
    rows = signed.select("uid", F.explode("bands").alias("bucket"))
    # Most shared buckets hold two texts, which their least and greatest id name without a join.
    shared = cut_lineage(rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("uid").alias("low"), F.max("uid").alias("high")).filter(F.col("n") > 1))
    two = shared.filter("n = 2").select("bucket", F.explode(F.array("low", "high")).alias("uid"), "n")
    return cut_lineage(two.union(rows.join(shared.filter("n > 2").select("bucket", "n"), "bucket").select("bucket", "uid", "n")))


def candidate_links(signed: DataFrame, met: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(a, b)`` between texts of ``signed (uid, marks)`` that meet in ``met``: links of texts with leaders, and
    of the leaders of large buckets among themselves, that join all candidate groups."""
    spark = signed.sparkSession
    level = met.join(signed.select("uid", "marks"), "uid")
    found = None
    while True:
        blocks = F.ceil(F.col("n") / F.lit(block))
        # In half of the buckets the least ids lead, so groups agree on leaders; in the others the order
        # differs from bucket to bucket, so that links missed in one are found in the next.
        order = F.when(F.col("bucket") % 2 == 0, F.col("uid")).otherwise(F.xxhash64("uid", "bucket"))
        dealt = (level.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(7)), blocks).cast("int"))
                 .repartition(tasks(spark), "bucket", "block")
                 .sortWithinPartitions("bucket", "block", order)
                 .select("bucket", "block", "uid", "marks", (blocks > 1).alias("more")))
        led = cut_lineage(dealt.mapInArrow(freeing(_lead), LED))
        links = led.filter(F.col("b").isNotNull()).select("a", "b")
        found = links if found is None else found.union(links)
        left = led.filter(F.col("bucket").isNotNull()).select("bucket", F.col("a").alias("uid"), F.col("rest").alias("marks"))
        sizes = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("now"))
        if sizes.isEmpty():
            break
        before = level.groupBy("bucket").agg(F.max("n").alias("was"))
        sized = cut_lineage(left.join(sizes.join(before, "bucket"), "bucket"))
        fewer = sized.filter(F.col("now") * 2 <= F.col("was")).select("bucket", "uid", "marks", F.col("now").alias("n"))
        split = _split(sized.filter(F.col("now") * 2 > F.col("was")))
        counted = split.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        level = cut_lineage(fewer.union(split.join(counted, "bucket").select("bucket", "uid", "marks", "n")))
        if level.isEmpty():
            break
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, w in word_slices(batch.column(1)):
                values, _, bounds = shingles(w, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array([x.tobytes() for x in text_keys(w)], pa.binary()),
                     pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
                    ["text_key", "words_key", "shingles"])
    return run


def _texts_of_groups(docs: DataFrame, signed: DataFrame, groups: DataFrame, size: int, block: int) -> DataFrame:
    """``(comp, uid, marks, shingles, weight)`` of the texts in candidate groups ``(uid, comp)``; blocks hold a weight of one."""
    wanted = cut_lineage(signed.join(groups, "uid").select("comp", "uid", "text_key", "words_key", "marks"))
    # The filter keeps nearly all other texts out of the join.
    likely = docs.select("text_key", "text").filter(may_match(bitmap(wanted, "text_key"), "text_key"))
    texts = likely.join(wanted.select("text_key").distinct(), "text_key", "left_semi").dropDuplicates(["text_key", "text"])
    sets = texts.select("text_key", "text").mapInArrow(freeing(_sets(size)), "text_key long, words_key binary, shingles binary")
    weight = F.greatest(F.lit(1 / block), F.length("shingles") / BLOCK_BYTES)
    return cut_lineage(wanted.drop("text_key").join(sets.drop("text_key").dropDuplicates(["words_key"]), "words_key")
                       .select("comp", "uid", "marks", "shingles", weight.alias("weight")))


def checked_links(texts: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: links that hold on the exact sets and join the classes of the candidate groups of ``texts``."""
    spark = texts.sparkSession

    def within(cells: DataFrame) -> DataFrame:
        dealt = (cells.join(texts.select("uid", "marks", "shingles"), "uid")
                 .repartition(tasks(spark), "comp", "block").sortWithinPartitions("comp", "block", "uid")
                 .select("comp", "block", "uid", "marks", "shingles", "class", "half"))
        return cut_lineage(dealt.mapInArrow(freeing(_check(similarity)), "a long, b long"))

    known = within(_own_blocks(texts))
    large = texts.groupBy("comp").agg(F.sum("weight").alias("w")).filter("w > 1").select("comp")
    several = cut_lineage(texts.join(large, "comp", "left_semi").select("comp", "uid", "weight"))
    if several.isEmpty():
        return known
    roots = components(known)
    classed = several.join(roots, F.col("uid") == F.col("vertex"), "left").select(
        "comp", "uid", F.coalesce("root", "uid").alias("class"), "weight")
    return known.union(within(_cells(cut_lineage(classed))))


def _classes(docs: DataFrame, size: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """``(doc_id, text_key, class)`` of every row; equal classes have equal numbers."""
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    signed = cut_lineage(keyed.select("doc_id", "text_key", "text").mapInArrow(
        freeing(_sign(size, BANDS, ROWS)), SIGNED))
    first = cut_lineage(signed.groupBy("words_key").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("rows")))
    several = first.filter("rows > 1").select("words_key", F.col("uid").alias("kept"))
    copies = signed.select("words_key", "uid").join(several, "words_key").filter(F.col("uid") != F.col("kept"))
    distinct = cut_lineage(signed.join(copies.select("uid"), "uid", "left_anti").drop("doc_id"))
    loose = components(candidate_links(distinct, shared_buckets(distinct), block))
    groups = cut_lineage(loose.select(F.col("vertex").alias("uid"), F.col("root").alias("comp")).union(
        loose.select("root", "root").distinct()))
    texts = _texts_of_groups(keyed, distinct, groups, size, block)
    roots = components(checked_links(texts, similarity))
    named = (first.drop("rows").join(roots, first["uid"] == roots["vertex"], "left")
             .select("words_key", F.coalesce("root", "uid").alias("class")))
    return signed.select("doc_id", "text_key", "words_key").join(named, "words_key").drop("words_key")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
                    similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (the least id of its class), ``class_rows``.

    Texts with equal words, or without words and with equal bytes, are one class; NULL counts as empty.
    Rows without id belong to a class but do not name it (a class of such rows only has no id). Repeated
    rows each come back; no rows give none; other columns are not looked at.
    """
    inputs = typed(docs, {"doc_id": (doc_id, "long"), "text": (text, "string")}).na.fill({"text": ""})
    rows = cut_lineage(_classes(inputs, size, similarity))
    named = rows.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_rows"))
    return rows.join(named, "class").select("doc_id", "class_id", "class_rows")


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
                         similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class, that of the least id; all columns unchanged."""
    inputs = typed(docs, {"doc_id": (doc_id, "long"), "text": (text, "string")}).na.fill({"text": ""})
    rows = cut_lineage(_classes(inputs, size, similarity))
    kept = rows.groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("k")).select("k.*")
    counted = rows.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("__rows"))
    chosen = cut_lineage(kept.withColumnsRenamed({"doc_id": "__id", "text_key": "__key"}).join(
        counted, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__key") == F.col("text_key")))
        .select("__id", "__key", "__rows"))
    own_id, own_text = F.col(f"`{doc_id}`").cast("long"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    joined = docs.join(chosen, own_id.eqNullSafe(F.col("__id")) & (F.xxhash64(own_text) == F.col("__key")))
    if not chosen.filter(F.col("__rows") > 1).isEmpty():  # the same id and text more than once
        joined = joined.dropDuplicates(["__id", "__key"])
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
