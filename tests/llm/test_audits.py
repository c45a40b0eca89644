"""Fingerprint groups, spelling variants and the source audit against brute force, with awkward rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from itemlake.llm import simhash, source_audit, spelling
from itemlake.llm.terms import any_letters, counted_terms, latin_letters

LOWER = {c: c + 32 for c in range(65, 91)}
ODD = [(1, "Hello, world. It's <|endoftext|> é."), (2, None), (3, ""), (None, "no id"), (3, "same id"), (3, "same id"),
       (7, "long " * 30_000), (9, "\n\n\t "), (-4, "Ünïcode Ölwärts 中文 123abc×÷ÿ x"), (10**17, "a\x0bb\x0cc d\re")]


def frame(spark, rows, kinds="doc_id long, text string"):
    """Rows with further columns whose names the operators use inside."""
    data = [(*r, 5, "clash", 1, 2) for r in rows]
    return spark.createDataFrame(data, f"{kinds}, n long, fingerprint string, key long, gid long").repartition(3)


# --- Fingerprints ---

def brute_mark(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(marks, radius):
    """Least position reachable from each position."""
    near = np.bitwise_count(marks[:, None] ^ marks[None, :]) <= radius
    label = np.arange(len(marks))
    while True:
        new = np.where(near, label[None, :], len(marks)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_marks_equal_brute_force():
    texts = [t for _, t in ODD] + ["one two three four " * 3, "Ä b C d e f", "x"]
    got = simhash.fingerprints_of(pa.array(texts, pa.string()))
    assert got.tolist() == [brute_mark(t) for t in texts]


@pytest.mark.parametrize("shape", ["spread", "tight", "ball", "chain", "mixed"])
def test_tree_finds_all_links(shape, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 60)
    monkeypatch.setattr(simhash, "LOOK", 100)
    rng = np.random.default_rng(len(shape))

    def flipped(base, n, bits):
        out = np.full(n, base, np.uint64)
        for _ in range(bits):
            out ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        return out
    spread = rng.integers(0, 2**64, 900, np.uint64)
    parts = {"spread": [spread, flipped(spread[0], 20, 3), spread[:200] ^ np.uint64(5)], "tight": [flipped(7, 1500, 4)],
             "ball": [flipped(7, 900, 9), flipped(2**60, 700, 12)],
             "chain": [np.array([(1 << k) - 1 for k in range(64)], np.uint64), spread],
             "mixed": [flipped(b, 60, 6) for b in spread[:20]]}[shape]
    points = np.unique(np.concatenate(parts))
    want = brute_groups(points, 4)
    a, b = simhash.links_among(points)
    assert (np.bitwise_count(a ^ b) <= 4).all() and len(a) == len(points) - len(set(want.tolist()))
    tree = simhash.build_tree(points[::3], 12)
    place, leaf = simhash.shards_of(tree, points)
    links = [simhash.links_among(points[np.sort(place[leaf == x])]) for x in np.unique(leaf)]
    index = {p: i for i, p in enumerate(points.tolist())}
    root = list(range(len(points)))
    for x, y in links:
        for i, j in zip(x.tolist(), y.tolist()):
            i, j = index[i], index[j]
            while root[i] != i:
                i = root[i]
            while root[j] != j:
                j = root[j]
            root[max(i, j)] = min(i, j)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    assert [top(i) for i in range(len(points))] == want.tolist()


def test_spread_fingerprints_cost_in_proportion(monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, 40_000, np.uint64)
    bit = [np.uint64(1) << np.uint64(b) for b in (3, 17, 40, 63)]
    near = np.concatenate([base[k * 20:k * 20 + 20] ^ np.bitwise_or.reduce(bit[:k + 1]) for k in range(4)])
    points = np.unique(np.concatenate([base, near]))
    compared, apart = [], simhash._apart
    monkeypatch.setattr(simhash, "_apart", lambda x, y: (compared.append(np.broadcast_shapes(np.shape(x), np.shape(y))), apart(x, y))[1])
    a, b = simhash.links_among(points)
    assert {(min(x), max(x)) for x in zip(a.tolist(), b.tolist())} >= {
        (min(x), max(x)) for x in zip(near.tolist(), base[:80].tolist())} and len(a) == 80
    assert sum(int(np.prod(s)) for s in compared) < 50 * len(points)  # 25 times; 18,000 times by vantage points alone
    tree = simhash.build_tree(points[::3], 40)
    place, leaf = simhash.shards_of(tree, points)
    assert len(place) <= 5 * len(points) and np.unique(leaf, return_counts=True)[1].max() < 2000
    meet = set(zip(place.tolist(), leaf.tolist()))
    spot = {p: i for i, p in enumerate(points.tolist())}
    shards = {}
    for at, x in meet:
        shards.setdefault(at, set()).add(x)
    assert all(shards[spot[x]] & shards[spot[y]] for x, y in zip(near.tolist(), base[:80].tolist()))


@pytest.mark.parametrize("flips, share", [(6, 0.0), (9, 0.5)])
def test_heavy_parts_are_cut_on(flips, share):
    rng = np.random.default_rng(9)
    dense = np.uint64(7) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (flips, 6000)).astype(np.uint64), axis=0)
    points = np.unique(np.concatenate([dense, rng.integers(0, 2**64, int(6000 * share) + 20_000, np.uint64)]))
    tree = simhash.build_tree(points, 60)
    place, leaf = simhash.shards_of(tree, points)
    i, j = np.nonzero(np.triu(np.bitwise_count(dense[:1500, None] ^ dense[None, :1500]) <= 4, 1))
    i, j = (np.searchsorted(points, dense[k]) for k in (i, j))
    shards = {}
    for at, x in zip(place.tolist(), leaf.tolist()):
        shards.setdefault(at, set()).add(x)
    assert len(tree.heavy) > 0 or share
    assert len(i) and all(shards[x] & shards[y] for x, y in zip(i.tolist(), j.tolist()))


def test_forest_of_a_star_takes_few_rounds(monkeypatch):
    points = np.arange(3000, dtype=np.uint64)
    rounds, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: (rounds.append(1), lexsort(keys))[1])
    forest = simhash._Forest(points)
    forest.take(np.full(2999, 2999, np.uint64), points[:2999][::-1])
    a, b = forest.links()
    assert len(a) == 2999 and forest.whole(points) and len(rounds) <= 3


def simhash_rows():
    random.seed(3)
    pool = [f"w{i}" for i in range(400)]
    base = random.choices(pool, k=300)
    rows = list(ODD)
    for i in range(100, 260):
        w = list(base) if i % 2 else random.choices(pool, k=random.randint(1, 30))
        w[random.randrange(len(w))] = "X" * (i % 3)
        rows.append((i, " ".join(w)))
    return rows + [(i, rows[40][1]) for i in range(300, 340)]


@pytest.mark.parametrize("shard, largest", [(8192, 1 << 20), (16, 12)])
def test_near_groups(spark, shard, largest, monkeypatch):
    monkeypatch.setattr(simhash.fingerprint_links, "__kwdefaults__", {"radius": 4, "shard": shard, "largest": largest})
    monkeypatch.setattr(simhash, "LEAST_SAMPLE", 4)
    rows = simhash_rows()
    marks = np.array([brute_mark(t) for _, t in rows], np.uint64)
    label = brute_groups(marks, 4)
    least = [min((d for (d, _), x in zip(rows, label) if x == mine and d is not None), default=None) for mine in label]
    got = simhash.near_groups(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in got) == Counter(
        (d, int(m), c) for (d, _), m, c in zip(rows, marks, least))
    assert simhash.near_groups(frame(spark, rows).limit(0)).count() == 0


# --- Spelling ---

def test_counted_terms_equal_expressions():
    texts = [t for _, t in ODD] + ["ÀÿĀ-aÃ̀b", "C3ÃÃ é", "İstanbul"]
    for inside, pattern in ((any_letters, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), (latin_letters, r"[A-Za-zÀ-ÿ]+")):
        found = counted_terms(pa.array(texts, pa.string()), inside)
        got = Counter({(d, found.terms[c].as_py()): n for d, c, n in zip(found.doc.tolist(), found.code.tolist(), found.n.tolist())})
        want = Counter((i, w.translate(LOWER)) for i, t in enumerate(texts) for w in re.findall(pattern, t or ""))
        assert got == want


def test_joined_crc():
    random.seed(1)
    parts = [(random.randbytes(random.randint(0, 9)), random.randbytes(random.choice([0, 1, 2, 7, 33, 5000]))) for _ in range(200)]
    first, second = (np.array([zlib.crc32(p[i]) for p in parts], np.uint32) for i in (0, 1))
    got = spelling.joined_crc(first, second, np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


def brute_words(rows, least=6, often=5, slips=199):
    count = Counter()
    for d, t in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % slips == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= least and n >= often}


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute_variants(words):
    out = {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 5 * n else None
        out[w] = (n, len(others), form, words.get(form))
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w] += (root,)
    return out


def spelling_rows():
    random.seed(8)
    stems = ["aaaaaa", "prefixone", "prefixtwo", "prefixten", "überschwang", "lettres", "lettre", "aaaaaab", "baaaaaa", "prefix", "ÿÿÿÿÿÿ", "abcabc"]
    letters = "abé"
    words = []
    for s in stems:
        variants = [s]
        for _ in range(25):
            i = random.randrange(len(s) + 1)
            variants.append(random.choice([s[:i] + random.choice(letters) + s[i:], s[:i] + random.choice(letters) + s[i + 1:], s[:i] + s[i + 1:]]))
        words += [v for j, v in enumerate(variants) for _ in range(random.choice([1, 4, 5, 30, 160]) if j else 900)]
    random.shuffle(words)
    rows = [(i, " ".join(words[a:a + 40])) for i, a in enumerate(range(0, len(words), 40))]
    return rows + ODD + [(None, "Überschwang " * 12), (5, "x" * 50_000 + " " + "é" * 9)]


@pytest.mark.parametrize("common, slips", [(256, 199), (0, 3), (6, 199)])
def test_variant_groups(spark, common, slips, monkeypatch):
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (common,))
    rows = spelling_rows()
    words = spelling.observed_words(frame(spark, rows), slips=slips)
    want_words = brute_words(rows, slips=slips)
    assert {r.word: r.n for r in words.collect()} == want_words and len(want_words) > 90
    got = spelling.variant_groups(words).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == brute_variants(want_words) and len(got) == len(want_words)
    assert spelling.variant_groups(spelling.observed_words(frame(spark, rows).limit(0))).count() == 0


def test_every_edit_is_found(spark):
    """All single edits of words of many lengths, at every place, with and without common chunks."""
    words = {}
    for length in range(6, 16):
        w = "abcdefghijklmnopq"[:length]
        for v in [w] + [w[:i] + "z" + w[i:] for i in range(length + 1)] + [w[:i] + "y" + w[i + 1:] for i in range(length)]:
            words.setdefault(v, len(words) + 5)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = {tuple(sorted((a, b))) for a in words for b in words if a < b and near(a, b)}
    for common in (256, 0):
        got = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(df, common).collect()]
        assert len(got) == len(set(got)) and set(got) == want


# --- Source audit ---

def test_skyband_equals_brute_force():
    rng = np.random.default_rng(2)
    for n, k in ((0, 3), (1, 1), (300, 1), (300, 4), (800, 20)):
        high, low = rng.integers(1, 9, n), rng.integers(1, 9, n)
        terms = rng.permutation(n).astype(str)
        got = set(source_audit.skyband(pa.array(terms, pa.string()), high, low, k).tolist())
        dominated = [sum(high[j] >= high[i] and low[j] <= low[i] and terms[j] < terms[i] for j in range(n)) for i in range(n)]
        assert got == {i for i in range(n) if dominated[i] < k}


def brute_audit(rows, top):
    docs = [(lang or "", source or "", [w.translate(LOWER) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")])
            for lang, source, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df, every = Counter(), Counter()
        for _, _, w in mine:
            df.update(set(w))
        terms = sorted((t for t in df if df[t] >= 3), key=str.encode)
        counts = {}
        for _, s, w in mine:
            counts.setdefault(s, Counter()).update(x for x in w if df[x] >= 3)
        for c in counts.values():
            every.update(c)

        def share(c):
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(terms)) for t in terms}
        shares, whole = {s: share(c) for s, c in counts.items()}, share(every)
        for s, p in shares.items():
            far = [(o, sum((p[t] - q[t]) ** 2 // q[t] for t in terms)) for o, q in shares.items() if o != s]
            own = [(t, (p[t] - whole[t]) ** 2 // whole[t]) for t in terms if counts[s][t] and p[t] > whole[t]]
            for part, found in (("pair", far), ("term", own)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(found, 1) if part == "pair" or r <= top]
    return Counter(out)


@pytest.mark.parametrize("cell, held, top", [(512, 262_144, 200), (2, 40, 5)])
def test_audit(spark, cell, held, top, monkeypatch):
    for name, value in (("CELL", cell), ("HELD", held), ("REDUCE", held // 2), ("PAIRS", 50 * cell)):
        monkeypatch.setattr(source_audit, name, value)
    random.seed(6)
    pool = [f"{chr(97 + i % 26)}{'é' * (i % 3)}x{chr(97 + i // 26)}" for i in range(300)]
    rows = [(random.choice(["en", "de", None, ""]), random.choice(["a", "b", "c", "d", None, "Z", "é"]),
             " ".join(random.choices(pool, weights=range(300, 0, -1), k=random.randint(0, 60)))) for _ in range(250)]
    rows += [("xx", "one", "alpha"), ("xx", "two", None), ("yy", "one", "b b b"), ("yy", "two", "b"), ("yy", "two", "b"), ("yy", "three", "")]
    got = source_audit.audit(frame(spark, rows, "lang string, source string, text string"), top=top)
    assert Counter(tuple(r) for r in got.collect()) == brute_audit(rows, top)
    assert source_audit.audit(frame(spark, rows, "lang string, source string, text string").limit(0)).count() == 0


def test_shares_beyond_64_bits(spark):
    """A count of a corpus times a billion."""
    row = spark.range(1).select(F.lit(4 * 10**12).alias("c"), F.lit(9 * 10**12).alias("t"), F.lit(7).cast("long").alias("v"))
    assert row.select(source_audit._share("c", "t", "v")).first()[0] == 1 + 10**9 * (4 * 10**12 + 1) // (9 * 10**12 + 7)
