"""SimHash fingerprints and the groups of those that differ in few bits, by trees of masks and vantage points.

A node of the tree cuts in one of two ways, whichever brings fewer rows for what it tells apart. By masks: it has
``RADIUS + 1`` sets of bits without a common bit, and a fingerprint goes once for each set to those with equal bits there.
At most ``RADIUS`` bits cannot differ in all sets, so every near pair meets. This cuts fingerprints that are spread, however
many. By a vantage point and a radius, for what is dense: fingerprints nearer than the radius go left, the others
right. Two fingerprints at most ``RADIUS`` bits apart that part there are both near the border, by the triangle inequality:
the left one lies within ``RADIUS`` of it. So the left ones in that belt also go right, and what lies farther from
the border is pruned.

A tree over a bounded sample cuts the distinct fingerprints into shards and every shard gets the fingerprints
that its cuts bring in. In a task the tree goes on down to small leaves. Equal fingerprints are one from the start, and a shard
gives a spanning forest of its links, so a group of copies gives no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlake.llm.common import cut_lineage, freeing, tasks, typed
from itemlake.llm.components import components
from itemlake.llm.encode import plain_strings, text_slices

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of the sample that the upper tree is built from, fewest of them in a shard, and distinct fingerprints a shard should get.
SAMPLE, LEAST_SAMPLE, SHARD = 1 << 17, 32, 8192
#: Distinct fingerprints of a shard beyond which it is compared block by block.
LARGEST = 1 << 20
#: Points of a leaf, and points that a node's choice looks at.
LEAF, LOOK = 768, 1024
#: Points of equal bits that are compared side by side, without a leaf of their own.
FEW = 48
#: Times the size of a leaf beyond which what has equal bits is cut on in the upper tree.
HEAVY = 4
#: Shingles hashed at once.
AT_ONCE = 1 << 16
_U = np.uint64
_PLAIN = bytes(32 if c in (32, 9, 10, 11, 12, 13) else c + 32 if 65 <= c < 91 else c for c in range(256))


# --- Fingerprints --------------------------------------------------------------------------

def _shingles(raw: bytes, size: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text with single blanks, and where its shingles start and end."""
    plain = raw.translate(_PLAIN)
    while b"  " in plain:
        plain = plain.replace(b"  ", b" ")
    plain = plain.strip(b" ")
    if not plain:
        return plain, np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(plain))
    least = min(size, len(starts))
    return plain, starts[:len(starts) - least + 1], ends[least - 1:]


def fingerprints_of(texts: pa.Array, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Unsigned 64-bit fingerprint of every text; bits that are set in over half of the shingles' hashes."""
    texts = plain_strings(texts)
    ones, shingles = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    hashed, owner, held = [], [], 0

    def flush() -> None:
        h = np.fromiter((x for part in hashed for x in part), _U, held)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sizes = np.array([len(part) for part in hashed])
        np.add.at(ones, owner, np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64))
        np.add.at(shingles, owner, sizes)

    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        plain, starts, ends = _shingles(text.as_buffer().to_pybytes(), size)
        for a in range(0, len(starts), AT_ONCE):
            part = [digest(plain[s:e], seed) for s, e in zip(starts[a:a + AT_ONCE].tolist(), ends[a:a + AT_ONCE].tolist())]
            hashed.append(part)
            owner.append(i)
            held += len(part)
            if held >= AT_ONCE:
                flush()
                hashed, owner, held = [], [], 0
    if held:
        flush()
    set_bits = (2 * ones > shingles[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1).view(">u8").reshape(-1).astype(_U)


def _sign(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain_strings(batch.column(1))
            for first, last in text_slices(texts):
                marks = fingerprints_of(texts.slice(first, last - first), size, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(marks.view(np.int64))],
                                                 ["doc_id", "fingerprint"])
    return run


# --- Trees -----------------------------------------------------------------------------------

def _apart(x: np.ndarray, y) -> np.ndarray:
    return np.bitwise_count(x ^ y)


class Cut(NamedTuple):
    """Masks without a common bit, or a vantage point and its border."""

    masks: np.ndarray | None
    vantage: np.uint64 = _U(0)
    border: int = 0


def _masks(look: np.ndarray, radius: int, least: float) -> tuple[float, np.ndarray] | None:
    """Share of pairs with equal bits in a mask if all bits are dealt to ``radius + 1`` masks, and masks of so few bits
    that the share falls to ``least``. Bits are dealt by how evenly they are set, so that masks tell about the same."""
    ones = np.unpackbits(look.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].sum(axis=0, dtype=np.int64)
    even = np.minimum(ones, len(look) - ones)
    most = np.count_nonzero(even) // (radius + 1)
    if not most:
        return None
    bits = np.argsort(-even, kind="stable")[:most * (radius + 1)].astype(_U).reshape(most, radius + 1)
    bits[::2] = bits[::2, ::-1].copy()

    def of(k: int) -> tuple[float, np.ndarray]:
        masks = np.bitwise_or.reduce(_U(1) << bits[:k], axis=0)
        sizes = np.concatenate([np.unique(look & m, return_counts=True)[1] for m in masks])
        return (sizes * (sizes - 1)).sum() / (radius + 1) / (len(look) * (len(look) - 1)), masks

    share, masks = of(most)
    for k in range(max(1, int(-np.log2(2 * least))), most):  # fewer bits cannot do
        fewer, found = of(k)
        if fewer <= least:
            masks = found
            break
    return (max(share, 1 / len(look) ** 2), masks) if share < 1 else None


def split_at(points: np.ndarray, radius: int = RADIUS, size: int = 1) -> Cut | None:
    """Cut that brings the fewest rows for what it tells apart; None where no cut helps. Masks get no more bits than
    parts of ``size`` points need."""
    look = points[np.linspace(0, len(points) - 1, min(LOOK, len(points))).astype(np.int64)]
    best, found = 0.95, None
    masked = _masks(look, radius, size / len(points))
    if masked and np.log2(radius + 1) < best * -np.log2(masked[0]):
        best, found = np.log2(radius + 1) / -np.log2(masked[0]), Cut(masked[1])
    for at in np.linspace(0, len(look) - 1, 6).astype(np.int64):
        share = np.bincount(_apart(look, look[at]), minlength=66) / len(look)
        below = np.concatenate([[0], np.cumsum(share)])  # below[b]: share nearer than b
        for border in range(1, 65):
            left = below[border]
            belt = left - below[max(0, border - radius)]
            if not 1 / 16 <= left <= 15 / 16 or 1 - left + belt > 15 / 16:
                continue
            told = -left * np.log2(left) - (1 - left) * np.log2(1 - left)
            if np.log2(1 + belt) / told < best:
                best, found = np.log2(1 + belt) / told, Cut(None, look[at], border)
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _parts(points: np.ndarray, node: np.ndarray, masks: np.ndarray, j: int) -> np.ndarray:
    """Number of the part of a node's mask ``j`` that a point is in. Parts of one number are one, which only adds points."""
    return _mixed((points & masks) ^ _mixed((node * 64 + j + 1).astype(_U))).view(np.int64)


class Tree(NamedTuple):
    """Nodes by number: masks (zeros at a vantage point), vantage point, border and children; a child below zero is
    leaf ``-1 - child``. A part of equal bits is a leaf by its number, or goes on at a child where ``heavy`` has it."""

    masks: np.ndarray
    vantage: np.ndarray
    border: np.ndarray
    near: np.ndarray
    far: np.ndarray
    heavy: np.ndarray
    child: np.ndarray


def build_tree(sample: np.ndarray, leaves: int, radius: int = RADIUS) -> Tree:
    """A tree of about ``leaves`` leaves, or ``radius + 1`` times as many by masks, with equal parts of the sample."""
    size = max(LEAST_SAMPLE, len(sample) // max(1, leaves))
    nodes: list[list] = []
    heavy: dict[int, int] = {}
    count, todo = 0, [(sample, {}, 0)]
    while todo:
        points, parent, side = todo.pop()
        cut = split_at(points, radius, size) if len(points) > size else None
        if cut is None:
            parent[side], count = -1 - count, count + 1
            continue
        parent[side] = child = len(nodes)
        if cut.masks is None:
            nodes.append([np.zeros(radius + 1, _U), cut.vantage, cut.border, 0, 0])
            d = _apart(points, cut.vantage)
            todo += [(points[d < cut.border], nodes[child], 3), (points[d >= cut.border], nodes[child], 4)]
        else:
            nodes.append([cut.masks, 0, 0, 0, 0])
            for j, mask in enumerate(cut.masks):
                part = _parts(points, np.array([child]), mask, j)
                found, sizes = np.unique(part, return_counts=True)
                todo += [(points[part == p], heavy, int(p)) for p in found[sizes > HEAVY * size]]
    kinds = (_U, _U, np.int64, np.int64, np.int64)
    at = sorted(heavy)
    return Tree(*[np.array([n[i] for n in nodes], k) for i, k in enumerate(kinds)],
                np.array(at, np.int64), np.array([heavy[p] for p in at], np.int64))


def shards_of(tree: Tree, points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """``(place, leaf)``: the leaves in which a point can meet one within ``radius``."""
    at, node = np.arange(len(points)), np.full(len(points), 0 if len(tree.border) else -1)
    places, leaves = [], []
    while len(at):
        done = node < 0
        places.append(at[done])
        leaves.append(-1 - node[done])
        at, node = at[~done], node[~done]
        masked = tree.border[node] == 0
        m_at, m_node = at[masked], node[masked]
        at, node = at[~masked], node[~masked]
        d, border = _apart(points[at], tree.vantage[node]).astype(np.int64), tree.border[node]
        left, right = d < border, d >= border - radius
        ats, nodes = [at[left], at[right]], [tree.near[node[left]], tree.far[node[right]]]
        for j in range(radius + 1 if len(m_at) else 0):
            part = _parts(points[m_at], m_node, tree.masks[m_node, j], j)
            where = np.minimum(np.searchsorted(tree.heavy, part), max(0, len(tree.heavy) - 1))
            on = tree.heavy[where] == part if len(tree.heavy) else np.zeros(len(part), bool)
            places.append(m_at[~on])
            leaves.append(part[~on])
            ats.append(m_at[on])
            nodes.append(tree.child[where[on]])
        at, node = np.concatenate(ats), np.concatenate(nodes)
    return np.concatenate(places), np.concatenate(leaves)


# --- Links within a shard ------------------------------------------------------------------------

def _connect(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all distinct points within ``radius``, directly or over others.

    Points of a leaf are all compared. Else balls are cut around leaders: members within half the radius are linked to
    their leader, leaders with each other, and only balls that are still apart and near enough are compared.
    """
    if len(points) <= LEAF:
        i, j = np.nonzero(np.triu(_apart(points[:, None], points[None, :]) <= radius, 1))
        return points[i], points[j]
    inner, rest, leaders, balls = radius // 2, points, [], []
    while len(rest):
        mine = _apart(rest, rest[0]) <= inner
        leaders.append(rest[0])
        balls.append(rest[mine])
        rest = rest[~mine]
    lead = np.array(leaders, _U)
    sizes = np.array([len(b) for b in balls])
    members, ends = np.concatenate(balls), np.cumsum(sizes)
    label, pairs = np.arange(len(lead)), []

    def join(i: int, others: np.ndarray, ends_of) -> None:
        for other in np.unique(label[others]):
            if other != label[i]:
                j = others[label[others] == other][0]
                pairs.append(ends_of(j))
                label[label == other] = label[i]

    for i in range(len(lead) - 1):
        others = np.flatnonzero(_apart(lead[i + 1:], lead[i]) <= radius) + i + 1
        if len(others):
            join(i, others, lambda j: (lead[i], lead[j]))
    for i in range(len(lead) - 1):
        others = np.flatnonzero((_apart(lead[i + 1:], lead[i]) <= radius + 2 * inner) & (label[i + 1:] != label[i])) + i + 1
        if not len(others):
            continue
        owner = np.repeat(others, sizes[others])
        cand = np.concatenate([members[ends[j] - sizes[j]:ends[j]] for j in others])
        for point in balls[i]:
            hit = np.flatnonzero((_apart(cand, point) <= radius) & (label[owner] != label[i]))
            if len(hit):
                first = {int(j): cand[h] for j, h in zip(owner[hit][::-1], hit[::-1])}
                join(i, np.array(sorted(first)), lambda j: (point, first[int(j)]))
    return (np.concatenate([np.repeat(lead, sizes), np.array([p[0] for p in pairs], _U)]),
            np.concatenate([members, np.array([p[1] for p in pairs], _U)]))


def _side_by_side(points: np.ndarray, mask: np.uint64, radius: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Links of points with equal bits in the mask where they are few; the others, by their bits."""
    points = points[np.argsort(points & mask)]
    first = np.flatnonzero(np.diff(points & mask, prepend=~(points[:1] & mask)))
    sizes = np.diff(first, append=len(points))
    after = np.repeat(np.where(sizes <= FEW, first + sizes, 0), sizes) - np.arange(len(points)) - 1
    at, step, a, b = np.flatnonzero(after > 0), 1, [points[:0]], [points[:0]]
    while len(at):
        hit = at[_apart(points[at], points[at + step]) <= radius]
        a.append(points[hit])
        b.append(points[hit + step])
        step += 1
        at = at[after[at] >= step]
    many = [points[x:x + n] for x, n in zip(first[sizes > FEW].tolist(), sizes[sizes > FEW].tolist())]
    return np.concatenate(a), np.concatenate(b), many


class _Forest:
    """Links that join what was apart, of all links shown to it."""

    def __init__(self, points: np.ndarray):
        self.points = np.sort(points)
        self.root = np.arange(len(points))
        self.taken: list[np.ndarray] = []

    def tops(self, at: np.ndarray) -> np.ndarray:
        top = self.root[at]
        while (up := self.root[top]).tobytes() != top.tobytes():
            top = up
        self.root[at] = top
        return top

    def whole(self, points: np.ndarray) -> bool:
        """Whether the points are joined already."""
        top = self.tops(np.searchsorted(self.points, points))
        return bool((top == top[:1]).all())

    def take(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every class takes its link to the least class below it, until no link leads to another."""
        i, j = np.searchsorted(self.points, a), np.searchsorted(self.points, b)
        while True:
            x, y = self.tops(i), self.tops(j)
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            if not len(i):
                return
            lower, upper = np.minimum(x, y), np.maximum(x, y)
            order = np.lexsort([lower, upper])
            one = order[np.flatnonzero(np.diff(upper[order], prepend=-1))]
            self.root[upper[one]] = lower[one]  # always to a lower number: no rings
            self.taken.append(np.stack([i[one], j[one]]))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.concatenate([np.zeros((2, 0), np.int64), *self.taken], axis=1)
        return self.points[i], self.points[j]


def links_among(points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between distinct points at most ``radius`` bits apart."""
    forest, todo = _Forest(points), [points]
    while todo:
        now = todo.pop()
        if forest.whole(now):
            continue
        cut = split_at(now, radius) if len(now) > LEAF else None
        if cut is None:
            forest.take(*_connect(now, radius))
        elif cut.masks is not None:
            for mask in cut.masks:
                a, b, many = _side_by_side(now, mask, radius)
                forest.take(a, b)
                todo += many
        else:
            d = _apart(now, cut.vantage)
            todo += [now[d < cut.border], now[d >= cut.border - radius if cut.border > radius else d >= 0]]
    return forest.links()


def _route(tree: Tree, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(_U)
            for a in range(0, len(points), AT_ONCE):
                place, leaf = shards_of(tree, points[a:a + AT_ONCE], radius)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(points[a:a + AT_ONCE][place].view(np.int64))],
                                                 ["shard", "fingerprint"])
    return run


def _within(radius: int):
    """Links of every (shard, cell); rows come sorted by them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: list[np.ndarray]) -> pa.RecordBatch:
            a, b = links_among(np.unique(np.concatenate(held)), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        key, held = None, []
        for batch in batches:
            shard, cell, points = (c.to_numpy() for c in batch.columns)
            edges = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(cell) != 0)) + 1).tolist(), len(shard)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    if held and key != (shard[a], cell[a]):
                        yield links(held)
                        held = []
                    key = (shard[a], cell[a])
                    held.append(points[a:b].view(_U))
        if held:
            yield links(held)
    return run


# --- Spark -------------------------------------------------------------------------------------------

def fingerprint_links(marks: DataFrame, *, radius: int = RADIUS, shard: int = SHARD, largest: int = LARGEST) -> DataFrame:
    """``(a, b)``: links that join all of the distinct ``marks (fingerprint long)`` within ``radius`` bits.

    The sample for the upper tree is the SAMPLE fingerprints of least hash; it decides where fingerprints go and not
    which pairs are found. A shard of more than ``largest`` is cut into blocks and every two of its blocks meet.
    """
    known = marks.select("fingerprint")
    total = known.count()
    chosen = known.orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(SAMPLE).toLocalIterator()
    sample = np.array([r[0] for r in chosen], np.int64).view(_U)
    tree = build_tree(sample, -(-total // shard), radius)
    routed = cut_lineage(known.mapInArrow(freeing(_route(tree, radius)), "shard long, fingerprint long"))
    sizes = routed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(largest)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fingerprint"), "blocks").cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (
        F.least(j, mine).cast("long") * F.col("blocks") + F.greatest(j, mine)))
    dealt = (routed.join(F.broadcast(sizes), "shard")  # a row per leaf of the tree: a few times SAMPLE / LEAST_SAMPLE
             .select("shard", F.explode(cells).alias("cell"), "fingerprint")
             .repartition(tasks(marks.sparkSession), "shard", "cell").sortWithinPartitions("shard", "cell"))
    return cut_lineage(dealt.mapInArrow(freeing(_within(radius)), "a long, b long")).distinct()


def near_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, seed: int = SEED,
                radius: int = RADIUS) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint long``, ``component_id`` (the least id reachable over links).

    NULL counts as the empty text, whose fingerprint is zero, linked like any other; repeated rows each come back; rows
    without id belong to a component and do not name it (one of such rows only has no id). No rows give none; other
    columns are not looked at.
    """
    inputs = typed(docs, {"doc_id": (doc_id, "long"), "text": (text, "string")})
    signed = cut_lineage(inputs.mapInArrow(freeing(_sign(size, seed)), "doc_id long, fingerprint long"))
    distinct = cut_lineage(signed.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    roots = components(fingerprint_links(distinct, radius=radius))
    placed = distinct.join(roots, F.col("fingerprint") == F.col("vertex"), "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = placed.select("fingerprint", "root").join(named, "root").select("fingerprint", "component_id")
    return signed.join(joined, "fingerprint").select("doc_id", "fingerprint", "component_id")
