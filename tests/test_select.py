"""Selection against a list-based statement of the rules."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from itemlake.operators import requests as R
from itemlake.operators import select as S
from itemlake.operators import syllabus as Y


def take(pool, split, count):
    """How many of each tier a list-based selection takes (``pool`` tier -> size)."""
    targets = {t: round(f * count) for t, f in split}
    rest = count - sum(targets.values())
    if rest:
        targets["medium"] = targets.get("medium", 0) + rest
    chosen, spare = [], []
    for tier, n in targets.items():
        rows = [tier] * (pool.get(tier, 0) if tier in ("easy", "medium", "hard") else 0)
        chosen += rows[:n]
        spare += rows[n:]
    chosen = (chosen + spare[:max(0, count - len(chosen))])[:count]
    return {t: chosen.count(t) for t in set(chosen)}


def test_picks_equal_list_selection(spark):
    rng, rows = random.Random(3), []
    for i in range(400):
        pool = {t: rng.choice([0, 1, 2, 3, 5, 20]) for t in ("easy", "medium", "hard", "extreme")}
        split = [(t, rng.choice([0.0, 0.1, 0.25, 0.5, 0.5, 1.0])) for t in rng.sample(["easy", "medium", "hard", "extreme"], rng.randint(1, 4))]
        rows.append((i, [(9, t, n) for t, n in pool.items()], split, rng.randint(0, 12)))
    df = spark.createDataFrame(rows, "id int, tiers array<struct<o:int,tier:string,n:long>>, split array<struct<tier:string,frac:double>>, count long")
    out = df.select("id", S.tier_picks(S.tier_targets(F.col("split"), F.col("count")), F.col("tiers"), F.col("count")).alias("p"))
    got = {r.id: {p.tier: p.k for p in r.p if p.k} for r in out.collect()}
    for i, tiers, split, count in rows:
        assert got[i] == take({t: n for _, t, n in tiers}, split, count), (tiers, split, count)


def permuted(sizes, seeds, taken):
    keyed = sizes.crossJoin(seeds).withColumn("keys", S.shuffle_keys(F.col("seed"), F.lit("A easy")))
    places = keyed.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), taken - 1)))
    return places.withColumn("at", S.shuffled(F.col("keys"), F.col("place"), F.col("n")))


def test_shuffle_visits_every_place_once(spark):
    out = permuted(spark.range(1, 501).toDF("n"), spark.range(2).toDF("seed"), F.col("n"))
    seen = out.groupBy("n", "seed").agg(F.countDistinct("at").alias("k"), F.min("at").alias("low"), F.max("at").alias("high"))
    assert seen.count() == 1000 and seen.filter("k <> n OR low <> 0 OR high <> n - 1").count() == 0


def test_shuffle_draws_chapters_in_proportion(spark):
    # 198 places in ten chapters, 20 wanted: the sizes at which a walk in equal steps takes runs of one chapter.
    for n in (198, 66, 126):
        out = permuted(spark.range(n, n + 1).toDF("n"), spark.range(200).toDF("seed"), F.lit(20)).withColumn(
            "chapter", F.floor(F.col("at") * 10 / F.col("n")))
        per_seed = out.groupBy("seed").agg(F.countDistinct("chapter").alias("k"))
        assert per_seed.agg(F.min("k")).first()[0] >= 5
        share = [r["count"] for r in out.groupBy("chapter").count().collect()]
        assert len(share) == 10 and all(300 < x < 500 for x in share), (n, share)


def test_shuffle_of_a_pool_beyond_32_bits(spark):
    out = permuted(spark.range(1).select(F.lit(3 * 2**31 + 5).cast("long").alias("n")), spark.range(1).toDF("seed"), F.lit(5000))
    assert out.select("at").distinct().count() == 5000 and out.filter("at < 0 OR at >= n").count() == 0


def test_shuffle_in_columns_is_the_same_permutation(spark):
    # Joined on a value made from the place: a filter on it must not be written out through every step.
    out = S.with_shuffled(permuted(spark.range(1, 301, 7).toDF("n"), spark.range(2).toDF("seed"), F.col("n")), "fast", F.col("place"), "n")
    assert out.filter("fast <> at OR fast IS NULL").count() == 0
    met = out.withColumn("next", F.col("fast") + 1).join(spark.range(400).toDF("next"), "next")
    assert len(met._jdf.queryExecution().optimizedPlan().toString()) < 20000


@pytest.fixture(scope="module")
def bank(spark):
    rows = [(i, "E", "physics", f"c{i % 4}", ["easy", "medium", "hard", None][i % 4 if i % 7 else 3], "conceptual",
             "mcq" if i % 3 else "integer", False, i % 2 == 0, ["x", f"k{i % 5}"], i % 10, "active" if i % 9 else "archived", f"s {i}", None)
            for i in range(400)]
    return spark.createDataFrame(rows, "id long, exam_name string, subject string, chapter string, difficulty string, question_type string, "
                                 "section_type string, has_formula boolean, has_diagram boolean, concepts array<string>, question_number int, "
                                 "status string, stem_md string, raw_text string")


def request(**kw):
    base = dict(request_id=1, exam_name="E", subject="physics", resolved_chapters=["c2", "c0", "c1"], excluded_chapters=["c1"],
                difficulty=None, question_type=None, section_type=None, has_formula=None, has_diagram=None, concepts=[],
                concept_match_mode="any", question_count=20, difficulty_distribution=None, seed=5)
    return tuple({**base, **kw}.values())


REQUEST = ("request_id long, exam_name string, subject string, resolved_chapters array<string>, excluded_chapters array<string>, "
           "difficulty string, question_type string, section_type string, has_formula boolean, has_diagram boolean, concepts array<string>, "
           "concept_match_mode string, question_count int, difficulty_distribution array<struct<tier:string,n:int>>, seed long")


def ids(spark, bank, *requests, parts=3):
    chosen = S.select_for_requests(spark.createDataFrame(list(requests), REQUEST), bank.repartition(parts)).collect()
    return {r: [x.id for x in sorted((c for c in chosen if c.request_id == r), key=lambda c: c.position)]
            for r in {c.request_id for c in chosen}}


def test_selection_is_seeded_and_independent_of_partitioning(spark, bank):
    a = ids(spark, bank, request(), request(request_id=2, seed=6))
    b = ids(spark, bank, request(), request(request_id=2, seed=6), parts=11)
    assert a == b and a[1] != a[2] and len(set(a[1])) == 20
    c = ids(spark, bank, request(request_id=3))
    assert c[3] == a[1]


def test_selection_follows_filters_and_distribution(spark, bank):
    dist = [("hard", 4), ("easy", 6)]
    rows = ids(spark, bank, request(question_count=10, difficulty_distribution=dist, section_type="mcq"))[1]
    info = {r.id: r for r in bank.collect()}
    assert sorted(info[i].difficulty for i in rows) == ["easy"] * 6 + ["hard"] * 4
    assert all(info[i].section_type == "mcq" and info[i].status == "active" and info[i].chapter in ("c2", "c0") for i in rows)
    places = [["c2", "c0"].index(info[i].chapter) for i in rows]
    assert places == sorted(places)


def test_short_pool_gives_no_selection_and_shortage(spark, bank):
    requests = spark.createDataFrame([request(question_count=199), request(request_id=2, exam_name="none")], REQUEST)
    assert S.select_for_requests(requests, bank).count() == 0
    pools = S.prepare(S.with_spec(requests), bank)
    got = {r.request_id: (r.total_available, r.can_generate, r.shortage) for r in S.availability(pools.requests, pools.cells).collect()}
    total = bank.filter("status = 'active' AND chapter IN ('c2', 'c0')").count()
    assert got == {1: (total, False, 199 - total), 2: (0, False, 20)}


def test_batch_equals_single_filter(spark, bank):
    cases = [dict(), dict(concepts=["k1", "k2"]), dict(concepts=["x", "k3"], concept_match_mode="all"), dict(difficulty="hard"),
             dict(has_diagram=False, section_type="integer"), dict(resolved_chapters=[])]
    frame = spark.createDataFrame([request(request_id=i, **c) for i, c in enumerate(cases)], REQUEST)
    pools = S.prepare(S.with_spec(frame), bank)
    totals = {r.request_id: r.total_available for r in S.availability(pools.requests, pools.cells).collect()}
    for i, c in enumerate(cases):
        args = dict(exam_name="E", subject="physics", resolved_chapters=["c2", "c0", "c1"], excluded_chapters=["c1"], **{})
        args.update(c)
        assert totals[i] == bank.filter(S.blueprint_predicate(**args)).count(), c


@pytest.mark.parametrize("leaf", [64, 1])
def test_places_among_classes_of_concepts(spark, bank, leaf):
    """A place in the union of classes is the place by digest; no table has a row per (spec, question)."""
    cases = [dict(concepts=["x"]), dict(concepts=["x"], difficulty="hard"), dict(concepts=["k1", "k2"]), dict(concepts=["x", "k3"], concept_match_mode="all"),
             dict(concepts=["x", "k1", "k4", "none"])]
    frame = spark.createDataFrame([request(request_id=i, resolved_chapters=[], excluded_chapters=[], **c) for i, c in enumerate(cases)], REQUEST)
    pools = S.prepare(S.with_spec(frame), bank)
    assert pools.signed.count() == bank.filter("status = 'active'").count()
    sizes = {r.pool: r.n for r in pools.cells.select("pool", "n").collect()}
    assert pools.classes.count() < sum(sizes.values()) / 2
    places = pools.cells.select("pool", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("pool_pos"))
    got = {}
    for r in S.nth_of_classes(places, pools.classes, pools.signed, leaf).collect():
        got.setdefault(r.pool, {})[r.pool_pos] = r.id
    spec = {r.spec: cases[r.request_id] for r in pools.requests.collect()}
    want = {}
    for r in bank.filter("status = 'active'").select("id", "concepts", *S.CELL, S._json_key(S.CELL).alias("cell")).collect():
        for key, c in spec.items():
            test = all if c.get("concept_match_mode") == "all" else any
            if test(x in r.concepts for x in c["concepts"]) and c.get("difficulty") in (None, r.difficulty):
                want.setdefault(f"{key} {r.cell}", []).append((hashlib.md5(str(r.id).encode()).hexdigest(), r.id))
    assert got == {p: dict(enumerate(i for _, i in sorted(v))) for p, v in want.items()} and {p: len(v) for p, v in want.items()} == sizes


def test_concept_selection_does_not_depend_on_the_batch(spark, bank):
    one = request(concepts=["x", "k2"], resolved_chapters=[], question_count=9)
    alone = ids(spark, bank, one)[1]
    assert len(alone) == 9 and ids(spark, bank, one, request(request_id=2, concepts=["k1", "k2", "k3"], question_count=3))[1] == alone


def test_exclusion_drops_questions_without_chapter(spark, bank):
    loose = bank.withColumn("chapter", F.when(F.col("id") % 2 == 0, F.col("chapter")))
    args = dict(exam_name="E", subject="physics", excluded_chapters=["c1"])
    assert loose.filter(S.blueprint_predicate(**args)).filter("chapter IS NULL").count() == 0


# --- Requests -----------------------------------------------------------------------------

RAW = ("request_id long, exam_name string, subject string, chapter_filter_mode string, chapter string, chapter_upto string, "
       "chapter_from string, chapter_to string, chapter_after string, exclude_chapters array<string>, question_count int, "
       "difficulty string, difficulty_distribution array<struct<tier:string,n:int>>, section_type string")


def raw(spark, *rows):
    names = [c.split()[0] for c in RAW.replace("struct<tier:string,n:int>", "x").split(", ")]
    base = dict(request_id=1, exam_name="jee mains", subject="Phy", chapter_filter_mode="all", exclude_chapters=[], question_count=30)
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], RAW)


def test_mode_without_chapter_becomes_all(spark):
    r = R.normalize_requests(raw(spark, dict(chapter_filter_mode="upto", chapter_upto=" None "))).first()
    assert (r.exam_name, r.subject, r.chapter_filter_mode) == ("JEE Main", "physics", "all")


@pytest.mark.parametrize("row, n", [
    (dict(), 0), (dict(question_count=0), 1), (dict(question_count=201), 1), (dict(difficulty="brutal"), 1), (dict(section_type="essay"), 1),
    (dict(difficulty_distribution=[("easy", 10)]), 1), (dict(difficulty_distribution=[("easy", 10), ("x", 20)]), 1),
    (dict(difficulty="easy", difficulty_distribution=[("easy", 30)]), 1), (dict(chapter_filter_mode="between", chapter_from="a"), 1)])
def test_validation(spark, row, n):
    assert len(R.validate_requests(raw(spark, row)).first().errors) == n


@pytest.fixture(scope="module")
def syllabus(spark):
    names = [("Kinematics", ["Motion in a Plane"]), ("Laws of Motion", ["NLM", "Newton's Laws"]), ("Gravitation", []), ("Thermodynamics", ["Heat"])]
    seed = spark.createDataFrame([("JEE Main", "physics", names)],
                                 "exam_name string, subject string, chapters array<struct<chapter_name:string,chapter_aliases:array<string>>>")
    return Y.flatten_seed(seed)


@pytest.mark.parametrize("row, want", [
    (dict(chapter_filter_mode="exact", chapter=" nlm "), ["Laws of Motion"]),
    (dict(chapter_filter_mode="upto", chapter_upto="Gravitation"), ["Kinematics", "Laws of Motion", "Gravitation"]),
    (dict(chapter_filter_mode="from", chapter_from="gravitation"), ["Gravitation", "Thermodynamics"]),
    (dict(chapter_filter_mode="after", chapter_after="Laws of Motion"), ["Gravitation", "Thermodynamics"]),
    (dict(chapter_filter_mode="between", chapter_from="Heat", chapter_to="NLM"), ["Laws of Motion", "Gravitation", "Thermodynamics"]),
    (dict(chapter_filter_mode="exact", chapter="Thermodynamic"), ["Thermodynamics"]),
    (dict(exclude_chapters=["NLM", "Heat"]), ["Kinematics", "Gravitation"]),
    (dict(exclude_chapters=["NLM", "Heat", "Kinematics", "Gravitation"]), [])])
def test_chapter_ranges(spark, syllabus, row, want):
    r = Y.resolve_requests(R.normalize_requests(raw(spark, row)), syllabus).first()
    assert (r.resolved_chapters, r.resolver_error) == (want, None)


@pytest.mark.parametrize("row, kind", [
    (dict(exam_name="CUET"), "SyllabusNotFound"), (dict(chapter_filter_mode="exact", chapter="Zebra crossing"), "ChapterNotFound"),
    (dict(chapter_filter_mode="after", chapter_after="Heat"), "EmptyRange: 'after' mode on the last chapter 'Thermodynamics' (#4)"),
    (dict(chapter_filter_mode="after", chapter_after="Heat", exclude_chapters=["Zebra crossing"]), "EmptyRange"),
    (dict(exclude_chapters=["Zebra crossing"]), "ChapterNotFound"),
    (dict(chapter_filter_mode="exact", chapter="Heat", exclude_chapters=["Heat"]), "EmptyRange")])
def test_resolution_errors(spark, syllabus, row, kind):
    r = Y.resolve_requests(R.normalize_requests(raw(spark, row)), syllabus).first()
    assert r.resolver_error.startswith(kind)
    if kind == "ChapterNotFound":
        assert "'Kinematics', 'Laws of Motion'" in r.resolver_error


def test_requests_of_one_file_are_judged_by_all_tasks(spark):
    """One file is one task; the judged requests are written by as many as a shuffle has."""
    from itemlake.plans import drafting
    from itemlake.plans.views import VIEWS, Views
    one = spark.createDataFrame([(i,) for i in range(40)], "c_custkey long").coalesce(1)
    views = Views(spark, "")
    views._made["reqs"] = spark.sql(VIEWS["reqs"], customer=one)
    syllabus = spark.createDataFrame([("E0", "economy", 1, "Brand#1", ["Brand 1"])],
                                     "exam_name string, subject string, chapter_order int, chapter_name string, chapter_aliases array<string>")
    valid, rejected = drafting.judge_requests(views.requests, syllabus, fuzzy=False)
    assert valid.count() + rejected.count() == 40
    assert len(rejected.inputFiles()) > 1
