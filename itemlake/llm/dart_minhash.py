"""DartMinHash signatures of weighted sets.

Darts fall on the plane over every element: one axis is the element's weight, the other a rank. Where
they fall depends on the element alone, so all sets see the same darts, and those below the
set's weight of the element hit it. A dart names one of ``k`` coordinates; each coordinate keeps the hit
of lowest rank. Two sets agree in a coordinate with the probability of their weighted Jaccard
similarity. Only ranks up to about ``k ln k`` expected hits are thrown, so a signature costs
``k log k`` darts plus the elements, not ``k`` times the elements.

The plane is cut into cells whose borders are powers of two. A cell's darts are drawn from a hash of
(element, cell): a Poisson count with the cell's area as mean, then places, coordinates and ids.
"""

from __future__ import annotations

import math

import numpy as np

from itemlake.llm.words import mix

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
LOWEST = 2.0 ** -4  # height of the cells at rank 0
_counts: dict[float, np.ndarray] = {}


def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of the counts 0, 1, 2, …"""
    if mean not in _counts:
        n = np.arange(int(mean + 12 * math.sqrt(mean) + 20))
        log = n * math.log(mean) - mean - np.array([math.lgamma(x + 1) for x in n])
        _counts[mean] = np.cumsum(np.exp(log))
    return _counts[mean]


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(32)).astype(np.float64) * 2.0 ** -32


def signatures(elements: np.ndarray, weights: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """A row of ``k`` 32-bit values for each set ``elements[bounds[i]:bounds[i + 1]]``.

    Elements are 64-bit hashes, distinct within a set, with weights above 0. An empty set has zeros.
    """
    sizes = np.diff(bounds)
    count = len(sizes)
    best = np.full(count * k, np.iinfo(np.uint64).max, np.uint64)
    of = np.repeat(np.arange(count), sizes)
    total = np.zeros(count)
    np.add.at(total, of, weights)
    limit = k * (math.log(k) + 2) / np.where(total > 0, total, 1)
    pending = total > 0
    floor = np.zeros(count)
    while pending.any():
        mine = np.flatnonzero(pending[of])
        _throw(elements[mine], weights[mine], of[mine], floor[of[mine]], limit[of[mine]], k, best)
        pending &= (best.reshape(count, k) == np.iinfo(np.uint64).max).any(axis=1)
        floor, limit = limit, limit * 2  # the rare sets with an empty coordinate get more darts
    out = (best & _U(0xFFFFFFFF)).astype(np.uint32).reshape(count, k)
    out[total <= 0] = 0
    return out


def _throw(elements, weights, of, floor, limit, k, best) -> None:
    """Throw the darts with ranks from ``floor`` to ``limit`` at all elements and keep the earliest."""
    top_rank, top_weight = float(limit.max(initial=0)), float(weights.max(initial=0))
    gold = int(_GOLD)
    low_weight, wide, level = 0.0, 1.0, 0
    while low_weight < top_weight:
        heavy = weights > low_weight
        low_rank, high, row = 0.0, LOWEST, 0
        while low_rank < top_rank:
            at = np.flatnonzero(heavy & (limit > low_rank) & (floor < low_rank + high))
            if len(at):
                cell = mix(elements[at] + _U((level * 64 + row + 1) * gold % 2**64))
                n = np.searchsorted(_poisson(wide * high), _unit(cell), "right")
                dart = np.repeat(cell, n)
                nth = np.arange(len(dart)) - np.repeat(np.cumsum(n) - n, n)
                dart = mix(dart + (nth + 1).astype(np.uint64) * _GOLD)
                src = np.repeat(at, n)
                rank = low_rank + _unit(dart) * high
                other = mix(dart ^ _U(0xA24BAED4963EE407))
                hit = (rank < limit[src]) & (rank >= floor[src])
                if low_weight + wide > 1.0:
                    hit &= low_weight + _unit(other) * wide < weights[src]
                else:  # the lowest cell lies below most weights as a whole
                    hit &= (weights[src] >= 1.0) | (_unit(other) * wide < weights[src])
                dart, other, src, rank = dart[hit], other[hit], src[hit], rank[hit]
                place = ((dart & _U(0xFFFFFFFF)) * _U(k)) >> _U(32)
                key = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << _U(32)) | (other & _U(0xFFFFFFFF))
                np.minimum.at(best, of[src] * k + place.astype(np.int64), key)
            low_rank, high, row = low_rank + high, low_rank + high, row + 1
        low_weight, wide, level = low_weight + wide, low_weight + wide, level + 1
