"""Operators on small fixtures: brute force, exact round trips, and awkward rows."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from itemlake.llm import (decontaminate, fingerprints, language, line_dedup, near_dedup, packing, token_files, toxicity,
                          warc)
from itemlake.llm.components import components
from itemlake.llm.dart_minhash import signatures
from itemlake.llm.encode import Encoder, encode_texts
from itemlake.llm.queries import tokenizer
from itemlake.llm.words import words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [(1, "Hello, world. It's <|endoftext|> é."), (2, None), (3, ""), (None, "no id"), (3, "same id"), (3, "same id"),
       (7, "long " * 30_000), (9, "\n\n\t "), (-4, "Ünïcode Ölwärts 中文 123abc")]


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def frame(spark, rows, more="start long, ids string"):
    data = [(*r, 5, "clash") for r in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, {more}").repartition(3)


def test_encoder_is_exact():
    encoder = Encoder(tokenizer(), remembered=40)
    random.seed(4)
    parts = ["ab", "Q", " ", "\n", "é", "́", "İ", "***", "'s", "<|endoftext|>", "<", "9", "ß.", ",,", " ", "中"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(3000)]
    for a in range(0, 3000, 500):
        ids, bounds = encoder.encode(pa.array(texts[a:a + 500]))
        for i, text in enumerate(texts[a:a + 500]):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("remembered", [250_000, 500])
def test_encoder_equals_library_on_every_letter_and_mark(remembered):
    """All of U+0080-U+2FFF and all ASCII marks behind every kind of last character, on a memory that knows the shorter pieces."""
    encoder = Encoder(tokenizer(), remembered=remembered)
    random.seed(remembered)
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    shown = [chr(c) for c in range(0x80, 0x3000)]
    cores = ["said", "dogs'", "it's", "x9", "€", "…", "—", "“no”", "dogs’", "²", "١", "é", "e\u0301", "ª", "ß", "'", "<|endoftext", "<", "a<b",
             "中", "I'LL", "İ", "ǅ", "ﬀ", "a\u00a0b", "\u0345", "'", ""]
    pieces = [c for c in cores] + [c + m for c in cores for m in marks] + [c + m + n for c in cores for m in marks for n in random.sample(marks, 4)]
    pieces += [f"{a}{c}{b}" for c in shown for a, b in (("", ""), ("a", "n"), ("", "n"), ("a", ""), ("a", ".'"), ("'", "'s"))]
    random.shuffle(pieces)
    texts = cores + pieces + [" ".join(random.sample(pieces, 40)) for _ in range(300)] + random.sample(pieces, 20_000)
    wanted = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for a in range(0, len(texts), 5000):
        ids, bounds = encoder.encode(pa.array(texts[a:a + 5000]))
        wrong = [(t, w) for i, (t, w) in enumerate(zip(texts[a:a + 5000], wanted[a:a + 5000])) if ids[bounds[i]:bounds[i + 1]].tolist() != w]
        assert not wrong, (len(wrong), wrong[:20])


def library_ids(texts, end):
    """Ids as the library gives them for whole texts, without this package's encoder."""
    from tokenizers import Tokenizer

    encoded = Tokenizer.from_file(tokenizer()).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array([*e.ids, end], "<u4") for e in encoded]


def test_packing_and_token_files(spark):
    ids = library_ids([t for _, t in ODD], 2)
    pieces = packing.pack(frame(spark, ODD), tokenizer(), length=1024)
    rows = pieces.collect()
    assert sum(r.length for r in rows) == sum(map(len, ids))
    at = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert all(s[1] + s[2] == (t[1] if t[0] == s[0] else 1024) for s, t in zip(at, at[1:])) and at[0][:2] == (0, 0)
    whole = sorted(b"".join(bytes(r.ids) for r in sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start))
                   for d in (1, 2, 7, 9, -4))
    assert whole == sorted(x.tobytes() for (d, _), x in zip(ODD, ids) if d in (1, 2, 7, 9, -4))
    assert all(len(r.ids) == 4096 or r.n_tokens & (r.n_tokens - 1) == 0 for r in packing.sequences(pieces, length=1024).collect())
    assert packing.pack(frame(spark, ODD).limit(0), tokenizer()).count() == 0

    got = token_files.round_trip(frame(spark, ODD), tokenizer(), end=2, shard_docs=2).collect()
    sums = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got)
    assert sums == sorted((d is not None, d or 0, len(x), zlib.crc32(x.tobytes())) for (d, _), x in zip(ODD, ids))
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert token_files.round_trip(frame(spark, ODD).limit(0), tokenizer()).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300, 5000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).permutation(10 * n + 1)[:n]
    nulls = np.zeros(n, bool)
    index = token_files.PerfectHash.build(keys, nulls)
    assert sorted(index.slots(keys, nulls).tolist()) == list(range(n))


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    elements = rng.integers(1, 2**63, 900).astype(np.uint64)
    one, two = 1 + rng.random(600) * 3, 1 + rng.random(600) * 3
    sign = signatures(np.concatenate([elements[:600], elements[300:]]), np.concatenate([one, two]), np.array([0, 600, 1200, 1200]), 2000)
    low, high = np.minimum(one[300:], two[:300]).sum(), np.maximum(one[300:], two[:300]).sum() + one[:300].sum() + two[300:].sum()
    assert abs((sign[0] == sign[1]).mean() - low / high) < 0.04 and not sign[2].any()


def brute_classes(rows):
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else None for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = (rows[i][1] or "") == (rows[j][1] or "") if a is None or b is None else len(a & b) >= 0.8 * len(a | b)
            if same and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return [min(d for (d, _), k in zip(rows, label) if k == x) for x in label]


def near_rows():
    random.seed(9)
    pool = [f"w{i}" for i in range(3000)]
    base = random.choices(pool, k=150)
    rows = [(i, " ".join(random.choices(pool, k=random.randint(1, 90)))) for i in range(60)]
    for i in range(60, 200):  # a chain of near copies
        w = list(base)
        for _ in range(random.randint(0, 3)):
            w[random.randrange(150)] = random.choice(pool)
        rows.append((i, " ".join(w)))
    return rows + [(200, ""), (201, None), (202, "***"), (203, "***"), (204, rows[3][1].upper()), (205, rows[3][1])]


@pytest.mark.parametrize("block", [2048, 16])
def test_near_duplicates(spark, block, monkeypatch):
    monkeypatch.setattr(near_dedup._classes, "__defaults__", (block,))
    rows = near_rows()
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert [got[d] for d, _ in rows] == brute_classes(rows)


def repeated_rows():
    """Texts against themselves written twice, a phrase repeated unequally often, and blocks whose short tails differ."""
    random.seed(12)
    rows = []
    for i in range(8):
        w = " ".join(f"d{i}x{j}" for j in range(400))
        phrase, block = " ".join(f"p{i}x{j}" for j in range(10)), " ".join(f"b{i}x{j}" for j in range(100))
        rows += [(10 * i, w), (10 * i + 1, f"{w} {w}"), (10 * i + 2, " ".join([phrase] * 10)), (10 * i + 3, " ".join([phrase] * 100))]
        rows += [(10 * i + 4 + k, " ".join([block] * 50 + [f"t{i}y{k}z{j}" for j in range(16)])) for k in (0, 1)]
    return rows


def test_near_duplicates_with_repeated_words(spark):
    rows = repeated_rows()
    want = brute_classes(rows)
    assert [want[i] - 10 * (i // 6) for i in range(6)] == [0, 0, 2, 2, 4, 5]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert [got[d] for d, _ in rows] == want


def loose_rows(n):
    """One group whose texts are mostly just under 0.8 alike."""
    random.seed(21)
    base, rows = [f"g{i}" for i in range(400)], []
    for i in range(n):
        w = list(base)
        for j in range(6):
            w[random.randrange(400)] = f"r{i}x{j}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [2048, 100])
def test_near_duplicates_of_a_loose_group(spark, block, monkeypatch):
    monkeypatch.setattr(near_dedup._classes, "__defaults__", (block,))
    rows = loose_rows(240)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert [got[d] for d, _ in rows] == brute_classes(rows)


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    """Many blocks with texts on both sides of 0.8, and stragglers that only blocks of different halves bring together."""
    monkeypatch.setattr(near_dedup._classes, "__defaults__", (60,))
    monkeypatch.setattr(near_dedup, "COMMON", 3)
    random.seed(5)
    base, rows = [f"g{i}" for i in range(200)], []
    for i in range(600):
        w = list(base)
        for j in range(random.choice([0, 1, 2, 3, 3, 4, 5])):
            w[random.randrange(200)] = f"r{i % 150}x{j}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert [got[d] for d, _ in rows] == brute_classes(rows)


@pytest.mark.parametrize("fails", [0, 10**6])
def test_links_of_a_block_are_exact_and_few(fails, monkeypatch):
    """All pairs of a block, checked one by one and all at once, with halves and known classes."""
    monkeypatch.setattr(near_dedup, "FAILS", fails)
    monkeypatch.setattr(near_dedup, "COLUMNS", 64)
    texts = pa.array([t for _, t in loose_rows(120)])
    w = words_of(texts)
    values, _, bounds = near_dedup.shingles(w)
    sets = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    marks = (signatures(values, np.ones(len(values)), bounds, 160) & np.uint32(255)).astype(np.uint8)
    uid = np.arange(120)
    for own, half in ((uid, None), (uid // 3, None), (uid, uid % 2)):
        links = near_dedup.alike_links(uid, marks, sets, own, half, 0.8)
        label, want = own.copy(), own.copy()
        for a, b in links:
            both = len(np.intersect1d(sets[a], sets[b]))
            assert both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) and (half is None or half[a] != half[b])
            label[label == label[b]] = label[a]
        for a in range(120):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) and (half is None or half[a] != half[b]):
                    want[want == want[b]] = want[a]
        assert len(set(zip(label.tolist(), want.tolist()))) == len(set(label.tolist())) == len(set(want.tolist()))
        assert len(links) < 120


def test_drop_near_duplicates_keeps_one_row(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "A b c d e f g"), (8, "x"), (9, None), (9, None)]
    kept = near_dedup.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "start", "ids"] and kept.count() == 3
    assert near_dedup.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}}


def test_decontamination(spark):
    random.seed(2)
    pool = [f"t{i}" for i in range(30)]
    bench = [(str(i), " ".join(random.choices(pool, k=n))) for i, n in enumerate([0, 1, 2, 5, 12, 13, 14, 40, 40])]
    bench += [("9", bench[7][1]), ("x", None), ("7", "t1 t2 t3")]
    docs = [(i, " ".join(random.choices(pool, k=random.randint(0, 60)) + bench[random.randrange(2, 10)][1].split()[:random.randint(0, 40)]))
            for i in range(150)] + ODD
    items = spark.createDataFrame(bench, "item_id string, text string")
    rows = decontaminate.contamination(frame(spark, docs), items).collect()
    assert len(rows) == len(docs)
    for r in rows:
        w, hit, found = words(r.text), set(), set()
        for name, text in bench:
            b = words(text)
            n = min(13, len(b))
            windows = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add(name)
        assert (r.contamination.n_words, r.contamination.n_hit, r.contamination["items"]) == (len(w), len(hit), sorted(found))
    assert decontaminate.drop_contaminated(frame(spark, ODD), items.limit(0)).count() == len(ODD)


def test_line_dedup(spark):
    rows = [(i, "site", f"Menu\nline {i}\n\nFoot" + ("\nrare" if i < 3 else "")) for i in range(40)]
    rows += [(50, None, "Menu\nx"), (51, "site", None), (52, "site", ""), (53, "site", "Menu\nMenu"), (0, "site", rows[0][2])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = line_dedup.drop_boilerplate(docs, counts=True).collect()
    texts = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and texts[1].text == "line 1\n\nrare" and texts[5].text == "line 5\n"
    assert texts[50].text == "Menu\nx" and texts[51].text is None and texts[51].n_lines == 0 and texts[53].text == ""
    assert line_dedup.drop_boilerplate(docs.limit(0)).count() == 0


def test_pipeline_drops_lines_below_a_tenth_of_a_site(spark):
    import corpus_pipeline
    passage = "A passage of more than forty characters that many pages of a site repeat."
    rows = [(i, "site", "\n".join([f"own {i}", *["Menu"] * (i < 16), *[passage] * (20 <= i < 26), *["Yes."] * (30 <= i < 36)])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate(spark, docs, "").collect()}
    assert got == {i: f"own {i}" + "\nYes." * (30 <= i < 36) for i in range(200)}


def test_fingerprints(spark):
    docs = [(d, t) for d, t in ODD if d is not None and d != 3] + [(3, "")]
    want = sorted((d, t or "") for d, t in docs)
    got = sorted(fingerprints.compare_with_edits(frame(spark, docs)).collect(), key=lambda r: r.doc_id)
    for i, ((d, t), r) in enumerate(zip(want, got, strict=True)):
        n, after = len(t) // 4, want[(i + 1) % len(want)][1]
        edited = t[:len(t) - n] + after[:n]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (d, len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = fingerprints.from_text(r.fingerprint), fingerprints.from_text(r.edited_fingerprint)
        assert r.near_edited == pytest.approx(fingerprints.likeness(a, b)) and 0 <= r.near_next <= 1
        assert r.contained_edited == pytest.approx(fingerprints.containment(a, b)) and r.contained_next >= r.near_next
    random.seed(1)
    text = "".join(random.choices("abcdefgh ", k=5000))
    a, b = fingerprints.chunk_sets(pa.array([text, "shifted " + text]))
    assert fingerprints.containment(a, b) > 0.95 and fingerprints.as_text(a) == fingerprints.as_text(fingerprints.from_text(fingerprints.as_text(a)))
    assert fingerprints.compare_with_edits(frame(spark, ODD)).count() == len(ODD)
    assert fingerprints.compare_with_edits(frame(spark, ODD).limit(0)).count() == 0


def test_toxicity(spark):
    random.seed(3)
    calm = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(400):
        w = random.choices(calm, k=random.randint(5, 60))
        if bad := i % 5 == 0:
            w[2:2] = ["you", random.choice(["blargo", "blargix", "snorful"])]
        rows.append((i, " ".join(w), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (900, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(rows) + 2 and all(0 <= r.score <= 1 for r in got)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).filter("score = 0").count() == len(rows) + 2


@pytest.mark.parametrize("ids", [[10**12, 5, -10**12], [2**63 - 1, -2**63, 2**62, 0, -1]])
def test_warc_of_extreme_ids(spark, ids):
    pages = spark.createDataFrame([(i, f"http://a.de/{n % 2}", "y" * 120) for n, i in enumerate(ids)], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.round_trip(pages).collect()}
    assert got == {i: "response" if i == min(ids) else "revisit" for i in ids}


def test_lexicon_keeps_rare_strong_words(spark, monkeypatch):
    """Forms are ranked by odds over all forms, however many common words are in toxic texts too."""
    monkeypatch.setattr(toxicity, "LEXICON", 30)
    common = " ".join(f"common{i}" for i in range(400))
    rows = [(f"{common} {'rarebad' if i < 4 and bad else ''}", bad) for i in range(40) for bad in (0, 1)]
    forms, toxic, other, bad, rest = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int"))
    assert words_of(pa.array(["rarebad"])).hashes[0] in forms.tolist() and (bad, rest) == (40, 40)
    assert len(forms) == 4 and set(toxic.tolist()) == {4} and not other.any() and (np.diff(forms.astype(object)) > 0).all()


def test_warc(spark):
    rows = [(i, f"https://www.Site{i % 3}.org/a?{i}", "x" * (50 if i % 2 else 150)) for i in range(20)]
    rows += [(None, None, None), (30, "no url\r\nX: y", "é" * 99_999), (31, "", "é" * 99_999), (4, "http://b.de", "x" * 150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.round_trip(pages).collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    for r in got:
        mine = [h or "" for p, _, h in rows if p == r.page_id]
        body = mine[0].encode()
        first = min((p for p, _, h in rows if p is not None and (h or "") == mine[0]), default=None)
        again = len(body) >= 100 and r.page_id != first
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(body), hashlib.sha256(body).hexdigest(), first if again else None)
        assert r.record_type == ("revisit" if again else "response")
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 8, 13])
def test_loser_tree(k):
    random.seed(k)
    runs = [sorted((random.randint(0, 30), i) for _ in range(random.randint(0, 20))) for i in range(k)]
    assert [x[0] for x in warc.LoserTree(runs)] == sorted(x[0] for r in runs for x in r)


def test_language(spark):
    random.seed(6)
    sound = {"aa": "kivo lura mesta", "bb": "tschn grumpf zwick"}
    docs = [(i, " ".join(random.choices(sound[x].split(), k=20)), x) for i, x in enumerate(["aa", "bb"] * 60)]
    model = language.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    rows = [(d, t, "h.x.org", None, None) for d, t, _ in docs] + [(500, "123", "h.x.org", "bb", "bb"), (501, None, None, None, None)]
    table = spark.createDataFrame(rows, "id long, text string, host string, declared string, address string")
    got = {r.id: r for r in language.identify(table, model).collect()}
    assert len(got) == len(rows) and all(got[d].lang == x for d, _, x in docs) and got[500].lang == "bb"
    assert language.identify(table.limit(0), model).count() == 0


def test_language_of_documents_with_many_pages(spark):
    """All pages of a document count, against the same sums in plain Python."""
    random.seed(7)
    sound = {"aa": "kivo lura mesta", "bb": "tschn grumpf zwick", "cc": "oey uai aei"}
    langs = sorted(sound)
    docs = [(i, " ".join(random.choices(sound[x].split(), k=i % 9)), random.choice(["s.org", "t.s.org", "u.net", None]))
            for i, x in enumerate(langs * 30)] + [(5, "kivo grumpf", "u.net"), (None, "lura", "s.org"), (None, None, None)]
    model = language.fit(spark.createDataFrame([(d, t, langs[d % 3]) for d, t, _ in docs if d is not None and t],
                                               "doc_id long, text string, lang string"))
    said = [(random.randrange(80), random.choice(["s.org", "v.net", None]), random.choice([*langs, "zz", None]),
             random.choice(["aa", "yy", None])) for _ in range(150)]
    said += [(3, "hot.org", "bb", None)] * 400 + [(None, "s.org", "aa", "aa"), (10**6, "s.org", "bb", "bb")]
    rows = spark.createDataFrame([(d, t, h, None, None) for d, t, h in docs], "id long, text string, host string, declared string, address string")
    pages = spark.createDataFrame(said, "id long, host string, declared string, address string").repartition(5)
    scores = [r[0] for r in rows.coalesce(1).select(language.text_evidence(model, "text")).collect()]

    def softmax(v):
        top = max(v)
        e = [math.exp(x - top) for x in v]
        return [x / sum(e) for x in e]

    def known(x):
        return x if x in langs or x is None else "other"

    facts = []  # row, host, declared, address, share
    for i, (d, _, host) in enumerate(docs):
        own = [(h or host, known(a), known(b)) for p, h, a, b in said if p is not None and p == d] or [(host, None, None)]
        facts += [(i, *f, softmax(scores[i])) for f in own]
    size = range(len(langs))
    whole = [sum(f[4][i] for f in facts) for i in size]
    corpus = [(whole[i] + 1) / (sum(whole) + len(langs)) for i in size]

    def smooth(rows_, parent):
        own = [sum(f[4][i] for f in rows_) for i in size]
        return [(own[i] + parent[i] * language.HOST) / (sum(own) + language.HOST) for i in size]

    def trust(at, value):
        if value is None:
            return [0.0] * len(langs)
        all_ = [sum(f[4][i] for f in facts if f[at] is not None) for i in size]
        mine = [sum(f[4][i] for f in facts if f[at] == value) for i in size]
        guess = [0.7 if value == x else 0.3 / len(langs) for x in langs]
        return [math.log((mine[i] + language.TRUST * guess[i]) / (all_[i] + language.TRUST)) for i in size]

    def domain(host):
        return ".".join(host.split(".")[-2:])

    want = []
    for i, (d, _, _) in enumerate(docs):
        own = [f for f in facts if f[0] == i]
        total = list(scores[i])
        for _, host, declared, address, _ in own:
            prior = corpus
            if host is not None:
                parent = smooth([f for f in facts if f[1] is not None and domain(f[1]) == domain(host)], corpus)
                prior = smooth([f for f in facts if f[1] == host], parent)
            parts = (trust(2, declared), trust(3, address))
            total = [total[j] + (math.log(prior[j]) + parts[0][j] + parts[1][j]) / len(own) for j in size]
        want.append((d, max(softmax(total))))
    got = [(r.id, r.confidence) for r in language.identify(rows, model, pages).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert [r[0] for r in sorted(got, key=order)] == [r[0] for r in sorted(want, key=order)]
    assert [r[1] for r in sorted(got, key=order)] == pytest.approx([r[1] for r in sorted(want, key=order)], abs=1e-9)
    assert len(language.identify(rows, model, pages.limit(0)).collect()) == len(docs)


def test_language_tables_of_documents_and_pages(spark):
    docs = spark.createDataFrame([(1, "x", "src", "p", "n"), (None, None, None, None, None)],
                                 "doc_id long, text string, source string, p string, host string")
    rows = language.document_rows(docs).collect()
    assert [tuple(r) for r in rows if r.id] == [(1, "x", "src", None, None)] and len(rows) == 2
    pages = spark.createDataFrame([(1, "https://a.b.de/fr/x/17.html", "<html lang='EN-gb'>", 3), (2, "https://c.org/about", None, 3),
                                   (3, None, "<html>", 3), (4, "http://h.org/99999999999999999999", "", 3)],
                                  "page_id long, url string, html string, id long")
    assert [tuple(r) for r in language.page_evidence(pages).collect()] == [(17, "a.b.de", "en", "fr")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_language_is_right_on_documents_that_were_not_fitted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    part = F.crc32(F.col("doc_id").cast("string")) % 2
    model = language.fit(docs.filter(part == 0))
    rest = docs.filter(part == 1)
    found = language.identify(language.document_rows(rest), model,
                              language.page_evidence(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")))
    right = found.withColumnRenamed("lang", "found").join(rest, F.col("id") == F.col("doc_id")).agg(
        F.avg((F.col("found") == F.col("lang")).cast("double"))).first()[0]
    print("accuracy on rows not fitted", right, rest.count())
    assert right > 0.97


def test_queries_are_registered():
    from itemlake.llm.queries import QUERIES
    assert {int(re.match(r"op(\d+)_", q).group(1)) for q in QUERIES} == set(range(1, 14))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = near_dedup.cut_lineage(stage(spark, docs, "/root/testdata/sf0.001"))
        assert docs.columns == columns, name
        n, before = docs.count(), n
        assert 0 < n <= before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert pieces.agg(F.count_distinct("doc_id")).first()[0] == n
