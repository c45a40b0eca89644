"""Weighted string similarity for chapter names, after the published description of the
weighted-ratio composite (plain, token-sort, token-set and partial ratios, scaled by length).
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors get these functions with the job and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BEST = T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("score", T.DoubleType())])


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def _ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 * 2 * _common(a, b) / total if total else 100.0


def _partial(a: str, b: str) -> float:
    """Best ratio of the shorter text against any window of the longer one."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0 if long else 100.0
    m, n = len(short), len(long)
    windows = {long[max(0, i):min(n, i + m)] for i in range(1 - m, n)}
    best = max(_ratio(short, w) for w in windows)
    if len(a) == len(b):
        windows = {short[max(0, i):min(m, i + n)] for i in range(1 - n, m)}
        best = max(best, max(_ratio(long, w) for w in windows))
    return best


def _token_ratio(a: str, b: str) -> float:
    ta, tb = a.split(), b.split()
    if not ta or not tb:
        return 0.0
    sort_score = _ratio(" ".join(sorted(ta)), " ".join(sorted(tb)))
    sa, sb = set(ta), set(tb)
    both = " ".join(sorted(sa & sb))
    only_a, only_b = " ".join(sorted(sa - sb)), " ".join(sorted(sb - sa))
    if both and (not only_a or not only_b):
        return 100.0
    gap = 1 if both else 0
    len_a, len_b = len(both) + gap + len(only_a), len(both) + gap + len(only_b)
    dist = len(only_a) + len(only_b) - 2 * _common(only_a, only_b)
    scores = [sort_score, 100.0 * (1 - dist / (len_a + len_b))]
    if both:
        scores += [100.0 * (1 - (gap + len(o)) / (len(both) + total))
                   for o, total in ((only_a, len_a), (only_b, len_b))]
    return max(scores)


def _partial_token_ratio(a: str, b: str) -> float:
    ta, tb = a.split(), b.split()
    if not ta or not tb:
        return 0.0
    sa, sb = set(ta), set(tb)
    if sa & sb:
        return 100.0
    return max(_partial(" ".join(sorted(ta)), " ".join(sorted(tb))),
               _partial(" ".join(sorted(sa)), " ".join(sorted(sb))))


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    score = _ratio(a, b)
    if spread < 1.5:
        return max(score, 0.95 * _token_ratio(a, b))
    scale = 0.9 if spread <= 8.0 else 0.6
    return max(score, scale * _partial(a, b), 0.95 * scale * _partial_token_ratio(a, b))


@F.pandas_udf(BEST)
def best_match(name: pd.Series, corpus: pd.Series) -> pd.DataFrame:
    """Index and score of the entry most like ``name``; the first wins a tie."""
    rows = []
    for text, entries in zip(name, corpus):
        scores = [weighted_ratio(text, e) for e in entries] if entries is not None else []
        top = max(range(len(scores)), key=scores.__getitem__) if scores else None
        rows.append((top, None if top is None else scores[top]))
    return pd.DataFrame(rows, columns=["idx", "score"]).astype({"idx": "Int32"})
