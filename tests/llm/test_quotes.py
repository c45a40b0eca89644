import re
from collections import defaultdict

import pytest

from itemlake.llm import quotes


def brute(rows):
    """The same rules, message by message."""
    norm = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()
    by = defaultdict(lambda: defaultdict(list))
    for c, t, _, text in rows:
        by[c][t].append(text)
    out = {}
    for c, turns in by.items():
        order = sorted(turns)
        lines, runs = {}, {}
        for t in order:
            lines[t], runs[t] = set(), set()
            for text in set(turns[t]) - {None}:
                last = None
                for raw in text.split("\n"):
                    mark = re.match(quotes.MARKS, raw).group(1)
                    w = norm(re.sub(quotes.MARKS + "[ \t]?", "", raw, count=1))
                    if not w:
                        continue
                    level = mark.count(">")
                    lines[t].add((level, w))
                    if last and last[0] == level:
                        last[1].append(w)
                    else:
                        last and runs[t].add((last[0], " ".join(last[1])))
                        last = (level, [w])
                last and runs[t].add((last[0], " ".join(last[1])))
        said = {t: {w for l, w in lines[t] | runs[t] if l == 0} for t in order}
        for i, t in enumerate(order):
            score, linked = defaultdict(int), 0
            for level, w in {x for x in lines[t] | runs[t] if x[0] > 0}:
                source = [s for s in order[:i] if w in said[s]]
                if source:
                    linked += len(w)
                    if level == 1:
                        score[source[-1]] += len(w)
            reply = max(score, key=lambda s: (score[s], s)) if score else (order[i - 1] if i else None)
            up = out.get((c, reply))
            out[c, t] = (reply, up[1] if up else t, up[2] + 1 if up else 0, linked)
    return out


CASES = [
    (1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "> Hello there.\nHi!\nFine."),
    (1, 2, "user", "> Hi!\n>> Hello there.\nGood."), (1, 3, "user", "> how   ARE you\nAgain."),
    (1, 4, "assistant", "Nothing quoted."), (1, 5, "user", "> Hello there.\n> How are you?\nTo both."),
    (1, 5, "user", "> Hello there.\n> How are you?\nTo both."), (2, 0, "user", None), (2, 1, "user", ""),
    (2, 4, "user", "> unknown"), (2, 9, "user", "x" * 50_000 + "\n" + "y\n" * 500), (2, 11, "user", "> y\n> y\nz"),
    (3, 7, "user", ">>> deep\n> a"), (3, 8, "user", "a"), (3, 9, "user", "> a\nb"), (3, 10, "user", "> a\n> b\nc"),
]


@pytest.fixture
def conversations(spark):
    return spark.createDataFrame([(*c, i) for i, c in enumerate(CASES)], "conv_id long, turn long, role string, text string, conv int")


def test_against_brute_force(conversations):
    want = brute(CASES)
    got = quotes.reply_ordered(conversations).collect()
    assert len(got) == len(CASES)
    for r in got:
        assert (r.reply_to, r.thread, r.depth, r.n_linked) == want[r.conv_id, r.turn], (r.conv_id, r.turn)
        assert r.text is None or ">" not in r.text


def test_missing_keys_and_no_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, None, None, "a"), (None, 1, "user", "> a\nb"), (5, None, "user", None), (5, 2, None, "> q")]
    got = {(r.conv_id, r.turn): r for r in quotes.reply_ordered(spark.createDataFrame(rows, schema)).collect()}
    assert got[None, 1].depth == 1 and got[None, 1].n_linked == 1 and got[5, 2].depth == 1
    assert quotes.reply_ordered(spark.createDataFrame([], schema)).count() == 0
