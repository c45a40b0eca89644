"""Text functions, one value at a time."""

import pytest
from pyspark.sql import functions as F

from itemlake.functions import metadata as M
from itemlake.functions import text as X
from itemlake.functions.fuzzy import weighted_ratio
from itemlake.functions.names import normalize_exam_name, normalize_subject, subjects_for_exam


@pytest.fixture(scope="module")
def one(spark):
    def run(fn, *values):
        row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
        return row.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first().r
    return run


def options(rows):
    return None if rows is None else {r.label: r.value for r in rows}


ABCD = {"A": "a", "B": "b", "C": "c", "D": "d"}


@pytest.mark.parametrize("text, want", [
    ("(1) a (2) b (3) c (4) d", ABCD), ("(A) a (b) b (C) c (d) d", ABCD), ("nothing here", {}), ("(1) alone", {}),
    ("(1) a (2) b (1) z", {"A": "z", "B": "b"}), ("(1) a (2)", {"A": "a", "B": ""}), ("( 1 ) a (2) b", {"A": ") a", "B": "b"}),
])
def test_split_options(one, text, want):
    assert options(one(X.split_options, text)) == want


@pytest.mark.parametrize("text, want", [
    ("(1) alone", {"A": "alone"}), ("(1) $3\\pi + 8$  (3) $3\\pi - 8$", {"A": "$3\\pi + 8$", "C": "$3\\pi - 8$"}),
    ("(1) (2) b", {"B": "b"}), ("stem only", {}),
])
def test_inline_options(one, text, want):
    assert options(one(X.inline_options, text)) == want


@pytest.mark.parametrize("text, want", [
    ("Just a stem.", "Just a stem."), ("The answer is (1) true  (2) false", "The answer is"), ("(1) a (2) b", ""),
])
def test_stem_fragment(one, text, want):
    assert one(X.stem_fragment, text) == want


@pytest.mark.parametrize("text, want", [
    ("(13) $x^2 + 1$  $x^2 - 1$", {"A": "$x^2 + 1$", "C": "$x^2 - 1$"}), ("(24) $a$ $b$", {"B": "$a$", "D": "$b$"}),
    ("(24) left part  right part", {"B": "left part", "D": "right part"}), ("(13) no boundary", {}), ("(1) first", None),
])
def test_merged_marker(one, text, want):
    assert options(one(X.merged_marker_options, text)) == want


@pytest.mark.parametrize("text, want", [
    ("$$\n\\begin{array} { c } { { 1 ) 3 \\pi + 8 } } \\\\ { { 3 ) 3 \\pi - 8 } } \\end{array}\n$$", {"A": "3 \\pi + 8", "C": "3 \\pi - 8"}),
    ("$$\\begin{array} { l } { { \\left( 2 \\right) 3 + e } } \\\\ { { \\left( 4 \\right) x } } \\end{array}$$", {"B": "3 + e", "D": "x"}),
    ("$$x^2 + y^2 = r^2$$", {}), ("$$\\begin{array}{c}{{ 1) only one }}\\end{array}$$", {}),
])
def test_equation_options(one, text, want):
    assert options(one(X.equation_options, text)) == want


def test_embedded_array(one):
    text = "( $\\begin{array} { c } { { 2 ) 2 2 \\pi } } \\\\ { { 4 ) 1 8 } } \\end{array}$ "
    assert options(one(X.embedded_array_options, text)) == {"B": "2 2 \\pi", "D": "1 8"}
    assert options(one(X.embedded_array_options, "(1) some option")) == {}


def test_latex_array_without_opening_parenthesis(one):
    assert options(one(X.latex_array_options, "\\begin{array}{c} 1) red \\\\ 2) blue \\end{array}")) == {"A": "red", "B": "blue"}
    assert options(one(X.latex_array_options, "1) red 2) blue")) == {}


@pytest.mark.parametrize("text, want", [
    ("Ans. (4)", "D"), ("ans (b)", "B"), ("Q51. Ans. (2) confirmed", "B"), ("none", None)])
def test_extract_answer(one, text, want):
    assert one(X.extract_answer, text) == want


@pytest.mark.parametrize("text, want", [
    ("Q1. stem", 1), ("Q 12. stem", 12), ("Q.1. stem", 1), ("26. Some text", 26), ("Q57.", 57), ("57.", None),
    ("(1) option", None), ("SECTION-A", None)])
def test_question_number(one, text, want):
    assert one(X.question_number, text) == want


@pytest.mark.parametrize("text, want", [
    ("Q1. stem text", "stem text"), ("26. stem text", "stem text"), ("stem text", "stem text"), ("Q57.", "")])
def test_strip_number(one, text, want):
    assert one(X.strip_number, text) == want


@pytest.mark.parametrize("text, noise", [
    ("", True), ("hi", True), ("12", True), ("1234", True), ("mathongo", True), ("m a t h o n", True),
    ("2025 (22 Jan Shift 1) JEE Main 2025 January", True), ("JEE Main Previous Year Paper", True), ("Q7.", True),
    ("Q1. Let a_1 be a G.P.", False), ("(1) 3 + e (2) 3 - e", False), ("Q1. NEET 2024 question", False)])
def test_noise(one, text, noise):
    assert one(X.is_noise, text) is noise


def test_search_text(one):
    assert one(X.strip_latex_for_search, "The value $$E = mc^2$$ and $v$ of \\mathrm{x} \\alpha {y}_2") == "The value and of y 2"


def test_no_break_space_counts_as_space(one):
    assert one(X.question_number, "26.\u00a0Some text") == 26


@pytest.mark.parametrize("text, want", [
    ("1.(2) 2.(3)", [(1, "2"), (2, "3")]), ("1. (4)   22. ( 2035 )", [(1, "4"), (22, "2035")])])
def test_key_entries(one, text, want):
    assert [(e.number, e.answer) for e in one(X.key_entries, text)] == want


@pytest.mark.parametrize("text, want", [
    ("3.75 \\text{ m/s}^2", "3.75 $\\text{ m/s}^2$"), ("3 \\text{m}^2", "3 $\\text{m}^2$"), ("$\\frac{a}{b}$", "$\\frac{a}{b}$"),
    ("plain", "plain"), ("odd $ \\alpha", "odd $ \\alpha")])
def test_wrap_bare_latex(one, text, want):
    assert one(X.wrap_bare_latex, text) == want


def test_preview(one):
    assert one(X.stem_preview, None, "a  $x$ b") == "a [formula] b"
    long = one(X.stem_preview, "word " * 60, "")
    assert long.endswith("…") and len(long) <= 121


@pytest.mark.parametrize("raw, want", [
    (" JEE mains ", "JEE Main"), ("JEE Main 2024 April", "JEE Main"), ("neet ug 2023", "NEET"), ("jee adv 2022", "JEE Advanced"),
    ("Olympiad", "Olympiad"), ("  ", None), (None, None)])
def test_exam_names(one, raw, want):
    assert one(normalize_exam_name, raw) == want


@pytest.mark.parametrize("raw, want", [(" Maths ", "mathematics"), ("PHY", "physics"), ("Zoology", "zoology"), ("", None), (None, None)])
def test_subjects(one, raw, want):
    assert one(normalize_subject, raw) == want


def test_subjects_for_exam(one):
    assert one(subjects_for_exam, "NEET") == ["physics", "chemistry", "biology"]
    assert len(one(subjects_for_exam, "Other")) == 6


@pytest.mark.parametrize("raw, topic", [
    ('{"topic": "\\theta and \\frac{a}{b}"}', "\\theta and \\frac{a}{b}"),
    ('```json\n{"topic": "x"}\n```', "x"), ('noise {"topic": "a\\nb"} tail', "a\\nb"),
    ('{"topic": "tab\\t1"}', "tab\t1"), ('{"topic": "quote \\" and \\u0041"}', 'quote " and A'), ("{broken", None)])
def test_json_recovery(one, raw, topic):
    assert one(lambda c: F.try_variant_get(M.recover_json(c), "$.topic", "string"), raw) == topic


def test_metadata_fields(one):
    raw = ('{"chapter": "SHM", "topic": " null ", "subject": "Maths (pure)", "concepts": ["a", "", "b"], '
           '"has_formula": "Yes", "has_diagram": false}')
    fields = lambda c: F.struct(*[v.alias(k) for k, v in M.metadata_columns(M.recover_json(c), F.lit(1)).items()])
    r = one(fields, raw)
    assert (r.chapter, r.topic, r.meta_subject, r.concepts) == ("Oscillations", None, "mathematics", ["a", "b"])
    assert r.has_formula and r.has_diagram and r.difficulty is None


def test_weighted_ratio_on_published_examples():
    assert round(weighted_ratio("this is a test", "this is a test!"), 2) == 96.55
    assert weighted_ratio("fuzzy was a bear", "wuzzy fuzzy was a bear") == 95.0
    assert weighted_ratio("", "x") == 0.0
    assert weighted_ratio("Kinematic", "Kinematics") > 85 > weighted_ratio("Optics", "Gravitation")


def test_numbers_in_other_scripts(spark):
    texts = ["١٢. Text", "１２. Text", "Q٣. Text", "99999999999. Text", "12. Text"]
    df = spark.createDataFrame([(i, "text", t) for i, t in enumerate(texts)], "i int, type string, text string")
    got = df.select("i", X.question_number(F.col("text")).alias("n"), X.start_number(F.col("type"), F.col("text")).alias("s"),
                    X.key_entries(F.col("text")).alias("k")).orderBy("i").collect()
    assert [r.n for r in got] == [12, 12, 3, None, 12] and got[3].s is None


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_strip_by_characters_equals_the_unicode_pattern(spark):
    some = [chr(c) for c in (*range(0x21), 0x41, 0x7F, *range(0x80, 0xA2), 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), 0x205F,
                             0x2060, 0x3000, 0x4E2D, 0xFEFF, 0x1F600)]
    rows = [(a + b + "x" + b + "y" + a + b,) for a in some for b in some] + [(a + b,) for a in some for b in some] + [("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    by_pattern = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert df.filter(~X.py_strip(F.col("t")).eqNullSafe(by_pattern)).count() == 0
    assert "regexp_replace" not in plan_of(df.select(X.py_strip(F.col("t")).alias("r")))


def test_noise_and_adverts_are_searched_once(spark):
    df = spark.createDataFrame([("MathonGo",), ("xx m a t h o",), ("matho x",), ("JEE Main 2025 x",), ("Q1. JEE Main 2025 x",), ("12",), ("plain text",),
                                ("join leader COURSE now",), ("don't prepare harder",), (None,)], "t string")
    flags = df.select(X.is_noise(F.col("t")).alias("noise"), X.has_ad(F.col("t")).alias("ad")).collect()
    assert [r.noise for r in flags] == [True, False, True, True, False, True, False, False, False, True]
    assert [r.ad for r in flags] == [False] * 7 + [True, True, None]
    assert plan_of(df.select(X.has_ad(F.col("t")).alias("ad"))).count("lower(") == 1


def test_garbled_share_of_mixed_text(spark):
    df = spark.createDataFrame([("plain",), ("",), ("\u8eab\u5e7fab",), ("\u8eababcd",), ("\U0001F600\U0001F600a",), (None,)], "t string")
    assert [r[0] for r in df.select(X.is_garbled(F.col("t"))).collect()] == [False, False, True, False, True, None]
