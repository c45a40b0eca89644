"""Cleaning and builders on small documents."""

import pytest

from itemlake.operators import clean as K
from itemlake.operators import layouts as L

OPT = "(1) a  (2) b  (3) c  (4) d"


def t(*texts):
    return [("text", x) for x in texts]


def opts(row):
    return {o.label: o.value for o in row.options}


def full(make_blocks, *blocks, files=None):
    rows = L.build_full_paper(make_blocks(list(blocks)), files).collect()
    return sorted(rows, key=lambda r: r.question_number)


# --- Cleaning ---------------------------------------------------------------------------

def kept(df):
    return [r.text for r in df.orderBy("doc_id", "block_idx").collect()]


def test_ad_page_goes_whole(make_blocks):
    b = make_blocks([("text", "51. stem", 0), ("text", "join leader course", 1), ("text", "half price", 1), ("text", "52. next", 2),
                     ("image", "x.jpg", 1)])
    assert kept(K.drop_ad_pages(b)) == ["51. stem", "52. next"]


def test_ad_without_page_keeps_others(make_blocks):
    assert len(kept(K.drop_ad_pages(make_blocks([("text", "SHOP NOW", None, None), ("text", "q", None, None)])))) == 2


def test_garbled_and_empty(make_blocks):
    b = make_blocks([("text", "身广无身广无身广Z"), ("text", "plain"), ("text", " \n"), ("text", "$$\\frac{a}{b}$$")])
    assert kept(K.drop_garbled(b)) == ["plain", "$$\\frac{a}{b}$$"]


def test_banner_only_on_headers(make_blocks):
    b = make_blocks([("text", "TEST PAPER WITH ANSWER KEY", 0, 1), ("text", "TEST PAPER WITH ANSWER KEY", 0, None)])
    assert len(kept(K.drop_banners(b))) == 1


def test_clean_all(make_blocks):
    b = make_blocks([("text", "51. block", 0), ("text", OPT, 0), ("text", "Ans. (2)", 0), ("text", "JOIN LEADER COURSE", 1),
                     ("text", "52. next", 2), ("text", OPT, 2), ("text", "Ans. (3)", 2), ("text", "Ans. (4)", 2)],
                    t("Ans. (1)", "  ", "Ans. (2)"))
    texts = kept(K.clean_blocks(b))
    assert [x for x in texts if x.startswith("Ans")] == ["Ans. (2)", "Ans. (4)", "Ans. (2)"]


# --- Inline -------------------------------------------------------------------------------

def test_inline(make_blocks):
    b = make_blocks(t("53. late", OPT, "Ans. (1)", "51. early", OPT, "Ans. (2)", "52. no answer", OPT))
    rows = {r.question_number: r for r in L.build_inline(b).collect()}
    assert {n: r.answer for n, r in rows.items()} == {51: "B", 53: "A"}
    assert opts(rows[51]) == {"A": "a", "B": "b", "C": "c", "D": "d"} and rows[51].stem_md == "51. early"


def test_inline_parts(make_blocks):
    b = make_blocks([("text", "PHYSICS SECTION-A", 0, 1), ("text", "1. stem"), ("equation", "x=1"), ("image", "i/p.jpg"),
                     ("text", "choose " + OPT), ("text", "(1) z (2) y"), ("text", "Ans. (3)"), ("equation", "y=2"),
                     ("text", "Chemistry", 0, 1), ("text", "2. other"), ("text", "Ans. (1)")])
    files = b.sparkSession.createDataFrame([("d0", "p.jpg")], "doc_id string, filename string")
    one, two = sorted(L.build_inline(b, files).collect(), key=lambda r: r.question_number)
    assert one.stem_md == "1. stem\n\nchoose\n\n(1) z (2) y\n\n$$x=1$$\n\n$$y=2$$"
    assert (one.subject, one.section_label) == ("chemistry", "SECTION-A")
    assert [i.filename for i in one.images] == ["p.jpg"]
    assert (two.section_type, two.subject, two.answer) == ("integer", "chemistry", "A")


def test_inline_detection(make_blocks):
    b = make_blocks(t("51. q", OPT, "Ans. (2)", "52. q", OPT, "Ans. (2)"), t("51. q", OPT, "52. q", OPT))
    assert {r.doc_id: r.is_inline for r in L.detect_inline(b).collect()} == {"d0": True, "d1": False}


# --- Separate key ---------------------------------------------------------------------------

def test_separate_key(make_blocks):
    b = make_blocks(t("51. What is asked here?", OPT, "52. Find the number of things", "53. unlisted question text", "Answer Key",
                      "51.(2) 52.(2035)", "51.(3)"))
    rows = {r.question_number: r for r in L.build_separate_key(b).collect()}
    assert {n: r.answer for n, r in rows.items()} == {51: "C", 52: "2035", 53: None}
    assert rows[51].section_type == "mcq" and rows[52].section_type == "integer"
    found = L.detect_by_key(b).collect()[0]
    assert found.is_separate_key and not found.is_full_paper


# --- Full paper -------------------------------------------------------------------------------

@pytest.mark.parametrize("blocks, answer, kind, labels", [
    (t("Q1. What is 2+2?", OPT, "ANSWER KEYS", "1.(2)"), "B", "mcq", "ABCD"),
    (t("Q1. Find x.", "ANSWER KEYS", "1.(4)"), "4", "integer", ""),
    (t("Q1. Which?", "(1) a", "(2) b", "(3) c", "(4) d", "ANSWER KEYS", "1.(3)"), "C", "mcq", "ABCD"),
    (t("Q1. Select.", "(13) $a$ $c$", "(24) $b$ $d$", "ANSWER KEYS", "1.(2)"), "B", "mcq", "ABCD"),
    (t("Q1. Find.", "ANSWER KEYS", "1.(2)"), "2", "integer", ""),
    (t("Q1. Odd.", OPT, "ANSWER KEYS", "1.(unread)"), "UNREAD", "mcq", "ABCD"),
])
def test_full_paper_questions(make_blocks, blocks, answer, kind, labels):
    q, = full(make_blocks, *blocks)
    assert (q.answer, q.section_type, "".join(sorted(opts(q)))) == (answer, kind, labels)


def test_full_paper_noise_and_number_only_start(make_blocks):
    q1, q57 = full(make_blocks, *t("Q1. Stem.", OPT, "MathonGo", "2025 (22 Jan Shift 1) JEE Main 2025 January", "Q57.",
                                   "choose from these", OPT, "ANSWER KEYS", "1.(1) 57.(3)"))
    assert (q1.answer, q57.answer, q57.question_number) == ("A", "C", 57)
    assert q57.stem_md == "choose from these"


def test_full_paper_duplicates(make_blocks):
    blocks = t("Q1. First reading.", "Q1. Second reading.", OPT, "ANSWER KEYS", "1.(1)")
    q, = full(make_blocks, *blocks)
    assert q.stem_md == "First reading."
    counts = L.settle_duplicates(L.full_paper_groups(make_blocks(blocks))).collect()[0]
    assert (counts.runs, counts.built) == (2, 2)


def test_full_paper_warnings(make_blocks):
    q, = full(make_blocks, *t("Q1. Stem.", "(1) only", "(1) other"), ("image", "f/pic.jpg"), *t("tail text one", "tail text two",
              "tail text three", "tail text four", "tail text five"))
    text = " / ".join(q.warnings)
    assert q.answer == "" and opts(q) == {"A": "only"}
    for part in ("conflicting option A from text block", "options_missing — recovered 1/4", "'pic.jpg' could not be linked",
                 "answer not found"):
        assert part in text


def test_image_only_key_page_is_reported(make_blocks):
    b = make_blocks([*t("Q1. Stem.", OPT), ("image", "key.jpg", 14)])
    boundary = L.key_boundary(L.filter_noise(b)).collect()[0]
    assert (boundary.boundary_idx, boundary.key_img_path) == (2, "key.jpg")
    questions = L.build_full_paper(b)
    warnings = L.document_warnings(b, questions)
    assert "emitted as an image block" in warnings.collect()[0].warning
    assert "emitted as an image block" in L.attach_document_warnings(questions, warnings).collect()[0].warnings[-1]


def test_orphan_key_entry(make_blocks):
    b = make_blocks(t("Q1. Stem.", OPT, "ANSWER KEYS", "1.(1) 2.(3)"))
    assert [w.warning for w in L.document_warnings(b, L.build_full_paper(b)).collect()] == [
        "answer key contains Q2 with no built question"]


@pytest.mark.parametrize("blocks, idx", [
    (t("Q1. What?", OPT, "ANSWER KEYS", "1.(2) 2.(3)"), 2), (t("Q1. stem", OPT, "ANSWER KEY  2025", "1.(1)"), 2),
    ([*t("Q1. stem") * 10, ("text", "1.(2) 2.(3) 3.(4) 4.(1)")], 10), (t("Q1. stem", OPT), None)])
def test_key_boundary(make_blocks, blocks, idx):
    assert L.key_boundary(make_blocks(blocks)).collect()[0].boundary_idx == idx


def test_html_key_table(spark, make_blocks):
    b = make_blocks(t("Q1. Stem.", OPT, "ANSWER KEYS"))
    row = spark.createDataFrame([("d0", 9, "table", None, None, 1, None, "<td>1.(</td><td>3)</td> 1.(4)")], b.schema)
    assert full_answer(b.unionByName(row)) == "C"


def full_answer(blocks):
    return L.build_full_paper(blocks).collect()[0].answer


def test_missing_numbers_and_report(make_blocks):
    b = make_blocks(t("Q1. One.", OPT, "Q4. Four.", "ANSWER KEYS", "1.(1)"))
    r = L.quality_report(L.build_full_paper(b)).collect()[0]
    assert (r.total_extracted, r.mcq_count, r.integer_count, r.no_answer, r.missing) == (2, 1, 1, 1, [2, 3])


def test_dispatch_and_errors(spark, make_blocks):
    b = make_blocks(t("1. q", OPT, "Ans. (1)"), t("Q1. Stem.", OPT, "ANSWER KEYS", "1.(2)"), t("1. x"))
    docs = spark.createDataFrame([("d0", "inline_answer"), ("d1", "full_paper"), ("d2", "poster")], "doc_id string, layout_type string")
    assert {(r.doc_id, r.answer) for r in L.build_questions(L.with_layout(b, docs)).collect()} == {("d0", "A"), ("d1", "B")}
    assert L.layout_errors(docs).collect()[0].error == "Unknown layout_type: 'poster'"


def test_buckets_do_not_change_results(make_blocks, monkeypatch):
    from itemlake.operators import ordered
    docs = [t("Q1. One.", OPT, "SECTION-B", "Q2. Two.", "more", OPT, "Q2. again", "ANSWER KEYS", "1.(1) 2.(2)")] * 3
    whole = L.build_full_paper(make_blocks(*docs)).drop("images")
    before = sorted(map(str, whole.collect()))
    monkeypatch.setattr(ordered.by_range, "__defaults__", (2,))
    assert sorted(map(str, L.build_full_paper(make_blocks(*docs)).drop("images").collect())) == before


def test_steps_before_repeated_answers_are_written_once(make_blocks):
    cleaned = K.clean_blocks(make_blocks(t("51. block", OPT, "Ans. (2)", "Ans. (3)")))
    assert kept(cleaned) == ["51. block", OPT, "Ans. (3)"]
    assert "join leader course" not in cleaned._jdf.queryExecution().optimizedPlan().toString()  # both scans read the written table


def test_full_paper_is_read_once(make_blocks, spark, monkeypatch):
    """Builder and document warnings share the filtered blocks, the boundary and the key."""
    from itemlake.plans import ingest
    calls = {}
    for name in ("filter_noise", "key_boundary", "full_paper_key"):
        def counted(*args, name=name, real=getattr(L, name)):
            calls[name] = calls.get(name, 0) + 1
            return real(*args)
        monkeypatch.setattr(L, name, counted)
    blocks = make_blocks(t("Q1. What is the value of x", OPT, "MathonGo", "ANSWER KEYS", "1.(2) 7.(3)"))
    documents = spark.createDataFrame([("d0", "full_paper")], "doc_id string, layout_type string")
    row = ingest.documents_to_questions(blocks, documents).collect()[0]
    assert (row.question_number, row.answer, opts(row)["A"]) == (1, "B", "a")
    assert row.warnings[-1] == "answer key contains Q7 with no built question"
    assert calls == {"filter_noise": 1, "key_boundary": 1, "full_paper_key": 1}
