"""Properties of paper edits."""

import random

import pytest
from pyspark.sql import functions as F

from itemlake.operators import bank as B
from itemlake.operators import export as E
from itemlake.operators import papers as P
from itemlake.operators import syllabus as Y


@pytest.fixture(scope="module")
def world(spark):
    papers = spark.createDataFrame([(1, "p", "draft", None), (2, "p", "draft", None), (3, "p", "approved", None)],
                                   "id long, prompt string, status string, notes string")
    rows = [(p, 100 * p + i, i, "Section A" if i <= 6 else "Section B", i, i % 4 == 0) for p in (1, 2, 3) for i in range(1, 11)]
    rows = spark.createDataFrame(rows, "paper_id long, question_id long, position int, paper_section string, display_number int, locked boolean")
    bank = spark.createDataFrame([(100 * p + i, "mcq" if i <= 6 else "integer", "easy", "c", "s", "active", f"stem {i}", "A",
                                   {"B": "two", "A": "one"} if i <= 6 else {}, [("f.jpg", "stem")] if i == 1 else []) for p in (1, 2, 3, 4) for i in range(1, 11)],
                                 "id long, section_type string, difficulty string, chapter string, subject string, status string, stem_md string, "
                                 "answer string, options map<string,string>, images array<struct<filename:string,position:string>>")
    return papers, rows, bank


def positions(rows, paper):
    return {r.question_id: r.position for r in rows.filter(F.col("paper_id") == paper).collect()}


def dense(rows):
    got = rows.groupBy("paper_id").agg(F.sort_array(F.collect_list("position")).alias("p")).collect()
    return all(r.p == list(range(1, len(r.p) + 1)) for r in got)


def test_shuffle_keeps_locked_rows_and_sections(world):
    papers, rows, _ = world
    out, rejects = P.shuffle(papers, rows, F.lit(7))
    assert dense(out) and out.filter("position <> display_number").count() == 0
    assert out.join(rows.filter("locked").select("paper_id", "question_id", F.col("position").alias("was")),
                    ["paper_id", "question_id"]).filter("position <> was").count() == 0
    assert out.filter("(position <= 6) <> (paper_section = 'Section A')").count() == 0
    assert positions(out, 1) != positions(rows, 1) and positions(out, 3) == positions(rows, 3)
    assert [r.paper_id for r in rejects.collect()] == [3]
    again, _ = P.shuffle(papers, rows.repartition(7), F.lit(7))
    assert positions(again, 1) == positions(out, 1)


def test_remove_and_add(spark, world):
    papers, rows, bank = world
    kept, rejects = P.remove(papers, rows, spark.createDataFrame([(1, 102), (1, 105), (3, 301), (2, 999)], "paper_id long, question_id long"))
    assert dense(kept) and positions(kept, 1)[106] == 4 and kept.filter("paper_id = 3").count() == 10
    assert {r.reason for r in rejects.collect()} == {"Cannot edit an approved paper.", "PaperQuestion not found."}
    edits = [(1, 401, 3, None, 1), (1, 402, None, None, 2), (2, 407, 99, None, 1), (2, 201, 1, None, 0), (3, 401, 1, None, 1)]
    edits = spark.createDataFrame(edits, "paper_id long, question_id long, position int, paper_section string, edit_seq int")
    grown, bad, later = P.add(papers, rows, edits, bank)
    assert dense(grown) and positions(grown, 1)[401] == 3 and positions(grown, 2)[407] == 11
    assert grown.filter("question_id = 407").first().paper_section == "Section B"
    assert later.first().question_id == 402 and bad.count() == 2


def test_swap_lock_approve(spark, world):
    papers, rows, bank = world
    swaps = spark.createDataFrame([(1, 104, 401), (1, 105, 101), (2, 201, 9999)], "paper_id long, question_id long, new_question_id long")
    out, bad = P.swap(papers, rows, swaps, bank)
    new = out.filter("question_id = 401").first()
    assert (new.position, new.locked) == (4, True) and bad.count() == 2
    locks, _ = P.toggle_locks(papers, rows, spark.createDataFrame([(1, 101), (1, 102), (1, 102)], "paper_id long, question_id long"))
    assert {r.question_id: r.locked for r in locks.filter("question_id IN (101, 102)").collect()} == {101: True, 102: False}
    done, refused = P.approve(papers, spark.createDataFrame([(1, "ok"), (3, "x")], "paper_id long, notes string"))
    assert done.filter("id = 1").first().status == "approved" and refused.first().paper_id == 3


def test_alternatives_are_free_and_distinct(world):
    _, rows, bank = world
    out = P.alternatives(rows, bank, F.lit(1))
    used = out.join(rows.select("paper_id", F.col("question_id").alias("alternative_id")), ["paper_id", "alternative_id"])
    assert used.count() == 0
    per = out.groupBy("paper_id", "question_id").agg(F.count("*").alias("n"), F.countDistinct("alternative_id").alias("d"))
    assert per.filter("n <> 3 OR d <> 3").count() == 0 and per.count() == 30


def test_export(world):
    papers, rows, bank = world
    parts = E.in_parts(E.markdown_lines(papers, rows, bank), part=4)
    text = "\n".join(r.markdown for r in parts.orderBy("part").collect())
    assert parts.count() == 3 and text == E.in_parts(E.markdown_lines(papers, rows, bank)).first().markdown
    assert text.startswith("\n## Section A\n\n**Q1.** stem 1\n\n(A) one  \n(B) two  \n\n![diagram](images/f.jpg)\n")
    assert text.count("## Section") == 2
    key = {r.number: r.answer for r in E.answer_key(rows.filter("paper_id = 1"), bank).collect()}
    assert key[1] == "A" and key[10] == "A"


def test_conflicting_edits_of_a_batch_keep_papers_whole(spark, world):
    papers, rows, bank = world
    # Row 104 to two questions, rows 105 and 106 to one question, one swap stated twice.
    swaps = [(1, 104, 401, 2), (1, 104, 402, 1), (1, 105, 403, 1), (1, 106, 403, 2), (2, 201, 404, 1), (2, 201, 404, 1)]
    out, bad = P.swap(papers, rows, spark.createDataFrame(swaps, "paper_id long, question_id long, new_question_id long, edit_seq int"), bank)
    assert out.count() == rows.count() and dense(out) and out.select("paper_id", "question_id").distinct().count() == out.count()
    assert {q: p for q, p in positions(out, 1).items() if q > 400} == {402: 4, 403: 5} and positions(out, 2)[404] == 1
    assert {(r.question_id, r.new_question_id) for r in bad.collect()} == {(104, 401), (106, 403)}
    adds = [(1, 401, 3, None, 1), (1, 402, 3, None, 1), (1, 401, 3, None, 1), (2, 403, 1, None, None)]
    adds = spark.createDataFrame(adds, "paper_id long, question_id long, position int, paper_section string, edit_seq int")
    grown, _, later = P.add(papers, rows, adds, bank)
    assert grown.count() == rows.count() + 2 and dense(grown) and [r.question_id for r in later.collect()] == [402]
    done, _ = P.approve(papers, spark.createDataFrame([(1, "b"), (1, "a"), (1, ""), (1, None)], "paper_id long, notes string"))
    assert done.count() == 3 and done.filter("id = 1").first().notes == "a"


@pytest.mark.parametrize("at_once", [64, 3])
def test_batches_of_additions_equal_one_by_one(spark, at_once, monkeypatch):
    """Many additions to one paper, gaps in positions, an empty paper, repeated questions and edits."""
    monkeypatch.setattr(P, "ADDED_AT_ONCE", at_once)
    rng = random.Random(at_once)
    papers = spark.createDataFrame([(i, "draft") for i in (1, 2, 3)] + [(4, "approved")], "id long, status string")
    own = {1: {p: 100 + p for p in range(1, 8)}, 2: {2: 201, 5: 202, 6: 203}, 3: {}, 4: {1: 301}}
    rows = [(p, q, at, "Section A", at, False) for p, x in own.items() for at, q in x.items()]
    rows = spark.createDataFrame(rows, "paper_id long, question_id long, position int, paper_section string, display_number int, locked boolean")
    bank = spark.createDataFrame([(q, "mcq") for q in range(100, 600)], "id long, section_type string")
    edits = [(rng.choice([1, 1, 1, 2, 3, 4]), rng.randint(400, 460), rng.choice([None, 0, 1, 2, 3, 5, 99]), None, rng.choice([None, n])) for n in range(90)]
    edits += edits[:5] + [(1, 103, 1, None, 7), (1, 999, 1, None, 8)]
    want, refused = {p: dict(x) for p, x in own.items()}, 0
    for p, q, at, _, _ in sorted(set(edits), key=lambda e: (e[4] is None, e[4] or 0, e[1], e[2] is not None, e[2] or 0)):
        mine = want[p]
        if p == 4 or q == 999 or q in mine.values():
            refused += 1
            continue
        end = max(mine, default=0) + 1
        at = min(at or end, end)
        want[p] = {**{x + (x >= at): y for x, y in mine.items()}, at: q}
    got, bad = P.add_batch(papers, rows, spark.createDataFrame(edits, "paper_id long, question_id long, position int, paper_section string, edit_seq int"), bank)
    found = {p: {} for p in own}
    for r in got.collect():
        assert r.position not in found[r.paper_id] and r.display_number == r.position
        found[r.paper_id][r.position] = r.question_id
    assert found == want and bad.count() == refused and len(want[1]) > 25


def test_repeated_bank_and_syllabus_edits_give_one_row_each(spark):
    questions = spark.createDataFrame([(1, "c", "easy", "active"), (2, "d", "easy", "active")], "id long, chapter string, difficulty string, status string")
    patches = [(1, ["chapter"], "x", None, 1), (1, ["chapter", "difficulty"], None, "hard", 2), (2, ["difficulty"], "y", "medium", 1)]
    patched = B.patch_metadata(questions, spark.createDataFrame(patches, "id long, set_fields array<string>, chapter string, difficulty string, edit_seq int"))
    assert {tuple(r) for r in patched.collect()} == {(1, None, "hard", "active"), (2, "d", "medium", "active")}
    changes = spark.createDataFrame([(1, "flagged", 2), (1, "archived", 3), (1, "gone", 4)], "id long, new_status string, edit_seq int")
    assert {(r.id, r.status) for r in B.change_status(questions, changes).collect()} == {(1, "archived"), (2, "active")}
    kind = "exam_name string, subject string, chapter_order int, chapter_name string, chapter_aliases array<string>"
    syllabus = spark.createDataFrame([("e", "s", 1, "A", ["a"])], kind)
    merged = Y.upsert(syllabus, spark.createDataFrame([("e", "s", 1, "B", None), ("e", "s", 1, "C", ["c"]), ("e", "s", 2, "D", None)], kind))
    assert {(r.chapter_order, r.chapter_name, r.action) for r in merged.collect()} == {(1, "C", "updated"), (2, "D", "created")}


def test_pages_are_bounded(spark):
    with pytest.raises(ValueError, match="at most 500"):
        B.newest_page(spark.createDataFrame([(1, 1)], "id long, created_at long"), 0, 501)


def test_alternatives_of_short_papers_need_no_scan(world, monkeypatch):
    _, rows, bank = world
    key = lambda out: sorted(map(tuple, out.select("paper_id", "question_id", "rank", "alternative_id").collect()))
    monkeypatch.setattr(P, "SHORT_PAPER", 0)
    scanned = key(P.alternatives(rows, bank, F.lit(1)))
    monkeypatch.undo()
    monkeypatch.setattr(P, "ordered_scan", None)
    assert key(P.alternatives(rows, bank, F.lit(1))) == scanned and scanned


def test_short_papers_get_positions_without_a_scan(spark, tmp_path, monkeypatch):
    from itemlake.operators import ordered
    from itemlake.plans.views import Views
    lines = [(o, (o * 7 + n * 3) % 11, n % 4, "ANR"[n % 3], "FO"[o % 2]) for o in range(30) for n in range(o % 9)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    read = lambda v: sorted(map(tuple, v.paper_rows.collect()))
    monkeypatch.setattr(Views, "SHORT", 3)
    split = read(Views(spark, str(tmp_path)))
    monkeypatch.undo()
    monkeypatch.setattr(ordered, "ordered_scan", None)
    assert read(Views(spark, str(tmp_path))) == split and split
