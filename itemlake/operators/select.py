"""Candidate counts and seeded selection for many requests at once.

A request never meets single questions of the bank. Questions are counted into *cells* (equal
exam, subject, chapter, difficulty, question type, section and flags) and get a fixed shuffled
position inside their cell. Requests with equal filters share one *spec*; specs meet cells.
How many questions each difficulty tier gives follows from counts alone, and the chosen ones
are addressed as (cell, position), so the join with the bank carries as many rows as are
selected, whatever the size of the pools. Concepts are counted too: a question's concepts are
reduced to those that some request asks for, and cells with equal sets are one class.

Seeded order: the questions of a tier are laid out cell after cell, and a keyed permutation of
their places, computed place by place, says which of them a request takes. The same seed gives
the same questions on any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemlake import constants as C
from itemlake.functions import text as X
from itemlake.operators.bank import active
from itemlake.operators.ordered import ranked_by_digest
from itemlake.session import cut_lineage, dealt

FACETS = ["chapter", "difficulty", "question_type", "section_type", "has_formula", "has_diagram"]
CELL = ["exam_name", "subject", *FACETS]
SPEC = ["exam_name", "subject", "resolved_chapters", "excluded_chapters", "difficulty",
        "question_type", "section_type", "has_formula", "has_diagram", "concepts", "concept_match_mode"]
# Prime modulus and multipliers of a shuffle's draws; a product with a value of 32 bits fits into 64 bits.
COIN = 2147483647
MIX = (1540483477, 1103515245)
# Questions of a pool that are ranked together when a place is looked up among several classes.
LEAF = 64
# Steps along a cycle at most; that one has more steps outside the places has a probability of 2 ** -255.
LONGEST_WALK = 256
# Steps that a place inside passes over at once, and steps that are compiled.
WALK_ROW = 16
PLAIN_STEPS = 2
KEYS = 4


# --- One request ---------------------------------------------------------------------

def concept_predicate(concepts: list[str], mode: str = "any") -> Column:
    wanted = F.array(*[F.lit(c) for c in concepts])
    if mode == "all":
        return F.size(F.array_except(wanted, "concepts")) == 0
    return F.arrays_overlap("concepts", wanted)


def blueprint_predicate(
    *, exam_name: str, subject: str, resolved_chapters: list[str] = (), excluded_chapters: list[str] = (),
    difficulty: str | None = None, question_type: str | None = None, section_type: str | None = None,
    has_formula: bool | None = None, has_diagram: bool | None = None, concepts: list[str] = (),
    concept_match_mode: str = "any",
) -> Column:
    """Filter of one resolved request. Equality on exam and subject lets the scan prune.

    An exclusion also drops questions without a chapter, as SQL ``NOT IN`` does.
    """
    terms = [F.col("status") == "active", F.col("exam_name") == exam_name, F.col("subject") == subject]
    if resolved_chapters:
        terms.append(F.col("chapter").isin(list(resolved_chapters)))
    if excluded_chapters:
        terms.append(~F.col("chapter").isin(list(excluded_chapters)))
    for name, value in (("difficulty", difficulty), ("question_type", question_type),
                        ("section_type", section_type)):
        if value:
            terms.append(F.col(name) == value)
    for name, flag in (("has_formula", has_formula), ("has_diagram", has_diagram)):
        if flag is not None:
            terms.append(F.col(name) == flag)
    if concepts:
        terms.append(concept_predicate(list(concepts), concept_match_mode))
    return reduce(and_, terms)


# --- Cells and specs --------------------------------------------------------------------

def _json_key(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def bank_index(questions: DataFrame) -> DataFrame:
    """Active questions with their ``pool`` (cell key) and shuffled position in it.

    Independent of requests: write it once per state of the bank and pass it to the selectors.
    """
    rows = (active(questions).filter(F.col("exam_name").isNotNull() & F.col("subject").isNotNull())
            .select("id", "question_number", *CELL).withColumn("pool", _json_key(CELL)))
    return ranked_by_digest(rows, ["pool"], F.md5(F.col("id").cast("string")), "id", "pool_pos")


def bank_cells(questions: DataFrame) -> DataFrame:
    """Number of active questions per cell; counted on the map side before any shuffle."""
    return (active(questions).filter(F.col("exam_name").isNotNull() & F.col("subject").isNotNull())
            .groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).withColumn("pool", _json_key(CELL)))


def with_spec(requests: DataFrame) -> DataFrame:
    """Give every request the key of its filters."""
    return requests.withColumn("spec", F.md5(_json_key(SPEC)))


def _matches(spec: str = "s_") -> Column:
    """Cell columns against the filters of a spec other than exam, subject and chapter list."""
    def s(name: str) -> Column:
        return F.col(spec + name)

    terms = [(F.coalesce(F.size(s("excluded_chapters")), F.lit(0)) == 0)
             | (F.col("chapter").isNotNull() & ~F.array_contains(s("excluded_chapters"), F.col("chapter")))]
    for name in ("difficulty", "question_type", "section_type"):
        terms.append((F.coalesce(s(name), F.lit("")) == "") | (F.col(name) == s(name)))
    for name in ("has_formula", "has_diagram"):
        terms.append(s(name).isNull() | (F.col(name) == s(name)))
    return reduce(and_, terms)


def _meet(specs: DataFrame, rows: DataFrame) -> DataFrame:
    """Equi-join of specs and rows on exam, subject and chapter, each of which may be open.

    ``*`` stands for "any"; a row answers under its own value and under ``*``. An absent exam
    or an empty chapter list is "any".
    """
    def named(c: Column) -> Column:
        return F.concat(F.lit("="), c)

    exam = F.coalesce("exam_name", F.lit(""))
    chapters = F.coalesce("resolved_chapters", F.array().cast("array<string>"))
    asked = specs.select(
        "spec",
        F.when(exam == "", F.lit("*")).otherwise(named(exam)).alias("__exam"),
        F.col("subject").alias("__subject"),
        F.explode(F.when(F.size(chapters) == 0, F.array(F.lit("*")))
                  .otherwise(F.transform(F.array_distinct(chapters), named))).alias("__chapter"),
        *[F.col(c).alias(f"s_{c}") for c in SPEC if c not in ("exam_name", "subject", "resolved_chapters")])
    answering = (rows.withColumn("__exam", F.explode(F.array(named(F.col("exam_name")), F.lit("*"))))
                 .withColumn("__chapter", F.explode(F.array_compact(F.array(
                     named(F.col("chapter")), F.lit("*")))))
                 .withColumn("__subject", F.col("subject")))
    met = asked.join(answering, ["__exam", "__subject", "__chapter"]).filter(_matches())
    return met.select("spec", "s_concepts", "s_concept_match_mode", *rows.columns)


def _has_concepts(name: str) -> Column:
    return F.coalesce(F.size(name), F.lit(0)) > 0


def concept_signatures(specs: DataFrame, questions: DataFrame) -> DataFrame:
    """Active questions that hold a concept which some spec of their subject asks for, each once, with all of these
    concepts as ``asked``; ``cell`` is the key of the filter columns and ``klass`` that of cell and set."""
    wanted = specs.filter(_has_concepts("concepts")).select("subject", F.explode("concepts").alias("__concept")).distinct()
    held = (active(questions).filter(F.col("exam_name").isNotNull() & F.col("subject").isNotNull())
            .select("id", "question_number", *CELL, F.explode(F.array_distinct("concepts")).alias("__concept")))
    signed = held.join(wanted, ["subject", "__concept"]).groupBy("id", "question_number", *CELL).agg(
        F.array_sort(F.collect_set("__concept")).alias("asked"))
    return signed.withColumn("cell", _json_key(CELL)).withColumn("klass", F.md5(_json_key(["cell", "asked"])))


def concept_classes(specs: DataFrame, signed: DataFrame) -> DataFrame:
    """``(spec, klass, cell, pool, n, cell columns)`` for specs that name concepts: the classes of questions with equal
    filter columns and equal sets of asked concepts that answer the spec.

    Specs meet classes through an equi-join on the concept; questions are only counted.
    """
    classes = signed.groupBy(*CELL, "cell", "klass", "asked").agg(F.count(F.lit(1)).alias("n"))
    wanted = specs.filter(_has_concepts("concepts")).select("spec", *SPEC, F.explode(F.array_distinct("concepts")).alias("__concept"))
    s = wanted.select(
        "spec", F.col("exam_name").alias("__exam"), F.col("subject").alias("__subject"), "__concept",
        *[F.col(c).alias(f"s_{c}") for c in SPEC if c not in ("exam_name", "subject")])
    rows = classes.withColumns({"__subject": F.col("subject"), "__concept": F.explode("asked")}).drop("asked")
    met = s.join(rows, ["__subject", "__concept"]).filter(
        ((F.coalesce("__exam", F.lit("")) == "") | (F.col("__exam") == F.col("exam_name")))
        & ((F.coalesce(F.size("s_resolved_chapters"), F.lit(0)) == 0)
           | F.array_contains("s_resolved_chapters", F.col("chapter")))
        & _matches())
    hits = met.groupBy("spec", "klass", "cell", "n", *CELL).agg(
        F.count(F.lit(1)).alias("__hits"),
        F.first(F.size(F.array_distinct("s_concepts"))).alias("__asked"),
        F.first("s_concept_match_mode").alias("__mode"))
    enough = F.when(F.col("__mode") == "all", F.col("__hits") == F.col("__asked")).otherwise(True)
    return (hits.filter(enough).withColumn("pool", F.concat_ws(" ", "spec", "cell"))
            .select("spec", "klass", "cell", "pool", "n", *CELL))


def nth_of_classes(places: DataFrame, classes: DataFrame, signed: DataFrame, leaf: int = LEAF) -> DataFrame:
    """``(pool, pool_pos, id, chapter, question_number, section_type)`` for the distinct ``places (pool, pool_pos)``.

    A pool is the union of some of ``classes (pool, klass, n)``, ordered by the digest of the id. Its ``pool_pos``-th
    question is found without bringing a pool together: questions are counted by class and leading digits of
    the digest, 256 parts to a level, each place goes down to the part it falls into, and only the ``leaf`` or so questions
    of the last part are ranked. So rows grow with the places, times the levels, and not with specs times questions.
    """
    parts = classes.select("pool", "klass")
    rows = signed.select("klass", F.md5(F.col("id").cast("string")).alias("digest"), "id", "chapter", "question_number", "section_type")
    largest = classes.groupBy("pool").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    state, digits = places.select("pool", "pool_pos", F.lit("").alias("node"), F.col("pool_pos").alias("rest")), 0
    while largest > leaf * 16 ** digits:
        inner, digits = digits, digits + 2
        counts = rows.groupBy("klass", F.substring("digest", 1, digits).alias("kid")).agg(F.count(F.lit(1)).alias("n"))
        spans = (state.select("pool", "node").distinct().join(parts, "pool")
                 .join(counts.withColumn("node", F.substring("kid", 1, inner)), ["klass", "node"])
                 .groupBy("pool", "node", "kid").agg(F.sum("n").alias("n")))
        upto = Window.partitionBy("pool", "node").orderBy("kid").rowsBetween(Window.unboundedPreceding, -1)
        kids = (spans.withColumn("lo", F.coalesce(F.sum("n").over(upto), F.lit(0)).cast("long")).groupBy("pool", "node")
                .agg(F.array_sort(F.collect_list(F.struct("lo", "kid"))).alias("kids")))  # at most 256
        at = F.get("kids", strip_of(F.transform("kids", lambda k: k["lo"]), F.col("rest")) - 1)
        state = cut_lineage(state.join(kids, ["pool", "node"]).withColumn("__at", at).select(
            "pool", "pool_pos", F.col("__at.kid").alias("node"), (F.col("rest") - F.col("__at.lo")).alias("rest")))
    leaves = (state.select("pool", "node").distinct().join(parts, "pool")
              .join(rows.withColumn("node", F.substring("digest", 1, digits)), ["klass", "node"])
              .withColumn("rest", F.row_number().over(Window.partitionBy("pool", "node").orderBy("digest", "id")) - 1))
    return state.join(leaves.drop("klass", "digest"), ["pool", "node", "rest"]).drop("node", "rest")


def distinct_specs(requests: DataFrame) -> DataFrame:
    """One row per spec. ``requests`` already carries ``spec``."""
    return requests.groupBy("spec").agg(*[F.first(c).alias(c) for c in SPEC])


class Pools(NamedTuple):
    """What a batch of requests can draw from.

    ``requests`` with ``spec``; ``cells (spec, cell columns, pool, n)``; for the specs that name concepts ``classes``
    and ``signed``, the questions of the classes.
    """

    requests: DataFrame
    cells: DataFrame
    classes: DataFrame
    signed: DataFrame


def prepare(requests: DataFrame, questions: DataFrame) -> Pools:
    """Match the specs of ``requests`` (which carry ``spec``) with the bank, once.

    Cells and classes feed counts, facets, samples and picks and are therefore written to the shared
    folder, as are the questions that hold an asked concept, once each.
    """
    specs = cut_lineage(distinct_specs(requests))
    signed = cut_lineage(concept_signatures(specs, questions))
    classes = cut_lineage(concept_classes(specs, signed))
    plain = _meet(specs.filter(~_has_concepts("concepts")), bank_cells(questions)).select(
        "spec", *CELL, "pool", "n")
    counted = classes.groupBy("spec", *CELL, "pool").agg(F.sum("n").alias("n"))
    return Pools(requests, cut_lineage(plain.unionByName(counted)), classes, signed)


# --- Preview -------------------------------------------------------------------------------

def facet_counts(cells: DataFrame) -> DataFrame:
    """``(spec, facet, value, n)`` in one pass of grouping sets over the cells.

    Missing values are left out, except for section type.
    """
    names = ["chapter", "difficulty", "section_type", "question_type"]
    grouped = cells.groupingSets([["spec"], *[["spec", f] for f in names]], "spec", *names).agg(
        F.sum("n").alias("n"), *[F.grouping(f).alias(f"__g_{f}") for f in names])
    facet, value = F.lit("total"), F.lit(None).cast("string")
    for f in names:
        mine = F.col(f"__g_{f}") == 0
        facet, value = F.when(mine, F.lit(f)).otherwise(facet), F.when(mine, F.col(f)).otherwise(value)
    flat = grouped.select("spec", facet.alias("facet"), value.alias("value"), "n")
    return flat.filter(F.col("facet").isin("total", "section_type") | F.col("value").isNotNull())


def availability(requests: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds ``total_available``, ``can_generate`` and ``shortage``; requests without candidates stay."""
    totals = cells.groupBy("spec").agg(F.sum("n").alias("total_available"))
    total = F.coalesce("total_available", F.lit(0))
    return requests.join(totals, "spec", "left").withColumns({
        "total_available": total,
        "can_generate": total >= F.col("question_count"),
        "shortage": F.greatest(F.lit(0).cast("long"), F.col("question_count") - total),
    })


def spec_samples(pools: Pools, questions: DataFrame) -> DataFrame:
    """Per spec the first five candidates by question number, NULL last.

    Every cell hands on its own first five, so whole pools are never sorted together.
    """
    order = [F.asc_nulls_last("question_number"), F.asc("id")]

    def first(rows: DataFrame, *by: str) -> DataFrame:
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        return ranked.filter(F.col("rank") <= C.PREVIEW_SAMPLE)

    base = (active(questions).filter(F.col("exam_name").isNotNull() & F.col("subject").isNotNull())
            .withColumn("pool", _json_key(CELL)).select("pool", "id", "question_number"))
    of_cells = pools.cells.select("spec", "pool").join(first(base, "pool").drop("rank"), "pool")
    signed = pools.signed.select("klass", "id", "question_number")
    of_classes = pools.classes.select("spec", "klass").join(first(signed, "klass").drop("rank"), "klass")
    both = of_cells.drop("pool").unionByName(of_classes.drop("klass"))
    return first(both, "spec").select("spec", "rank", "id")


def preview_samples(pools: Pools, questions: DataFrame) -> DataFrame:
    """``(request_id, rank, id, question_number, chapter, difficulty, question_type, stem_preview)``."""
    shown = questions.select(
        "id", "question_number", "chapter", "difficulty", "question_type",
        X.stem_preview(F.col("raw_text"), F.col("stem_md")).alias("stem_preview"))
    picked = spec_samples(pools, questions).join(shown, "id")
    return pools.requests.select("request_id", "spec").join(picked, "spec").drop("spec")


# --- Targets and picks ------------------------------------------------------------------------

def tier_counts(cells: DataFrame) -> DataFrame:
    """``(spec, tiers)``: pool size per difficulty tier; a missing difficulty counts as medium.

    Ordered easy, medium, hard, then others by name.
    """
    tier = F.coalesce(F.nullif("difficulty", F.lit("")), F.lit("medium"))
    place = F.coalesce(F.array_position(F.array(*[F.lit(d) for d in C.DIFFICULTIES]), F.col("tier")), F.lit(0))
    counts = cells.groupBy("spec", tier.alias("tier")).agg(F.sum("n").alias("n"))
    entry = F.struct(F.when(place == 0, F.lit(9)).otherwise(place).alias("o"), "tier", "n")
    return counts.groupBy("spec").agg(F.array_sort(F.collect_list(entry)).alias("tiers"))


def _total(values: Column, field: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, t: acc + field(t))


def proportional_split(tiers: Column) -> Column:
    """Share of every tier of the pool, tiers that can never be selected included."""
    return X.let(_total(tiers, lambda t: t["n"]), lambda total: F.transform(tiers, lambda t: F.struct(
        t["tier"].alias("tier"), (t["n"] / total).alias("frac"))))


def tier_targets(split: Column, count: Column) -> Column:
    """Target per tier, rounded half to even; medium takes what rounding leaves, even below 0."""
    def settle(rounded: Column) -> Column:
        return X.let(count - _total(rounded, lambda t: t["target"]), lambda rest: F.when(
            rest == 0, rounded).when(
            F.exists(rounded, lambda t: t["tier"] == "medium"),
            F.transform(rounded, lambda t: F.struct(
                t["tier"].alias("tier"),
                F.when(t["tier"] == "medium", t["target"] + rest).otherwise(t["target"]).alias("target")))
        ).otherwise(F.concat(rounded, F.array(F.struct(F.lit("medium").alias("tier"), rest.alias("target"))))))

    return X.let(F.transform(split, lambda t: F.struct(
        t["tier"].alias("tier"), F.rint(t["frac"] * count).cast("long").alias("target"))), settle)


def tier_picks(targets: Column, tiers: Column, count: Column) -> Column:
    """How many questions each tier gives: its share first, then leftovers in target order.

    A negative target leaves out that many questions of the tier until leftovers are needed.
    """
    zero = F.lit(0).cast("long")
    known = F.filter(tiers, lambda x: x["tier"].isin(C.DIFFICULTIES))

    def sized(t: Column) -> Column:
        return X.let(
            F.coalesce(F.get(F.filter(known, lambda x: x["tier"] == t["tier"]), F.lit(0))["n"], zero).cast("long"),
            lambda n: F.struct(t["tier"].alias("tier"), n.alias("n"), F.when(
                t["target"] >= 0, F.least(t["target"], n)).otherwise(F.greatest(zero, n + t["target"])).alias("s")))

    def pick(values: Column) -> Column:
        short = F.greatest(zero, count - _total(values, lambda t: t["s"]))
        return F.transform(values, lambda t, i: X.let(F.slice(values, F.lit(1), i), lambda earlier: F.struct(
            t["tier"].alias("tier"), t["n"].alias("n"),
            (F.greatest(zero, F.least(t["s"], count - _total(earlier, lambda x: x["s"])))
             + F.greatest(zero, F.least(t["n"] - t["s"], short - _total(earlier, lambda x: x["n"] - x["s"]))))
            .alias("k"))))

    return X.let(F.transform(targets, sized), pick)


def shuffle_keys(seed: Column, label: Column) -> Column:
    """Keys of the four rounds of a shuffle, all cut from one digest."""
    return X.let(F.md5(F.concat_ws(":", seed.cast("string"), label.cast("string"))), lambda digest: F.array(*[
        F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9, 17, 25)]))


def _halves(size: Column) -> tuple[Column, Column]:
    """Sizes of the two halves that the binary digits of the places ``0 … size-1`` are cut into."""
    digits = F.length(F.bin(size - 1))
    power = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))
    return power(F.floor(digits / 2)), power(digits - F.floor(digits / 2))


def _again(once: Column) -> Column:
    return once.bitwiseXOR(F.shiftright(once, 15)) * MIX[1] % COIN


def _stepped(keys: Column, x: Column, high: Column, low: Column) -> Column:
    """Where the rounds take the place ``x``, inside or not."""
    def turn(half: Column, key: Column) -> Column:
        drawn = X.let(half["b"].bitwiseXOR(key) * MIX[0] % COIN, _again)
        return F.struct(half["b"].alias("a"), half["a"].bitwiseXOR(drawn % half["a_size"]).alias("b"),
                        half["b_size"].alias("a_size"), half["a_size"].alias("b_size"))

    start = F.struct(F.floor(x / low).cast("long").alias("a"), (x % low).alias("b"), high.alias("a_size"), low.alias("b_size"))
    return F.aggregate(keys, start, turn, lambda half: half["a"] * low + half["b"])


def _walked(keys: Column, first: Column, size: Column, high: Column, low: Column) -> Column:
    """``first``, or where it leads to inside ``0 … size-1``. Steps come in rows, which a place inside passes over."""
    def walk(start: Column, times: int, go: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.array(*[F.lit(i) for i in range(times)]), start, lambda x, _: F.when(x < size, x).otherwise(go(x)))

    rows = walk(first, LONGEST_WALK // WALK_ROW, lambda x: walk(
        x, WALK_ROW, lambda y: _stepped(keys, y, high, low)))
    return F.when(first < size, first).otherwise(rows)


def shuffled(keys: Column, place: Column, size: Column) -> Column:
    """Where ``place`` goes in a seeded permutation of ``0 … size-1``.

    The places' binary digits are cut into two halves, and in four rounds either half is changed by a number drawn from
    the other and the round's key; so the next power of two is permuted. A place that leaves ``0 … size-1`` goes on
    along its cycle until it comes back, as each cycle must; at least half of all places come back at once.
    """
    return X.let(F.struct(*[c.alias(n) for c, n in zip(_halves(size), ("high", "low"))]), lambda half: X.let(
        _stepped(keys, place, half["high"], half["low"]), lambda first: _walked(keys, first, size, half["high"], half["low"])))


def with_shuffled(rows: DataFrame, name: str, place: Column, size: str, keys: str = "keys") -> DataFrame:
    """``rows`` with ``shuffled`` of their ``place`` as column ``name``, for many rows.

    The first steps along the cycle are plain columns, which Spark compiles; places still outside after them go on in
    the expression's loop.
    """
    columns, at = rows.columns, place
    stepped = rows.withColumns(dict(zip(("__high", "__low"), _halves(F.col(size)))))
    for _ in range(PLAIN_STEPS):
        stepped = stepped.withColumn("__from", at).withColumns({
            "__a": F.floor(F.col("__from") / F.col("__low")).cast("long"), "__b": F.col("__from") % F.col("__low")})
        for i in range(KEYS):
            half, other, width = (("__a", "__b", "__high"), ("__b", "__a", "__low"))[i % 2]
            stepped = stepped.withColumn("__once", F.col(other).bitwiseXOR(F.get(keys, F.lit(i))) * MIX[0] % COIN).withColumn(
                half, F.col(half).bitwiseXOR(_again(F.col("__once")) % F.col(width)))
        went = F.col("__a") * F.col("__low") + F.col("__b")
        # Before the first step every place counts as outside.
        stepped = stepped.withColumn("__at", went if at is place else F.when(F.col("__from") < F.col(size), F.col("__from")).otherwise(went))
        at = F.col("__at")
    walked = _walked(F.col(keys), at, F.col(size), F.col("__high"), F.col("__low"))
    # Behind a generator, since a filter on the result that is pushed through the steps would write out each in the next.
    return stepped.select(*[c for c in columns if c != name], F.explode(F.array(walked)).alias(name))


def select_ids(wanted: DataFrame, pools: Pools, index: DataFrame) -> DataFrame:
    """Choose questions for ``wanted (request_id, label, spec, seed, count, split)``.

    ``split`` holds tier fractions, or NULL to follow the pool. Returns
    ``(request_id, label, id, chapter, question_number, section_type)``.
    """
    cells = pools.cells
    joined = wanted.join(tier_counts(cells), "spec")
    count = F.col("count").cast("long")
    split = F.coalesce("split", proportional_split(F.col("tiers")))
    targeted = joined.withColumn("__targets", tier_targets(split, count))
    picked = targeted.select(
        "request_id", "label", "spec", "seed",
        F.explode(tier_picks(F.col("__targets"), F.col("tiers"), count)).alias("t"),
    ).filter(F.col("t.k") > 0)
    keyed = picked.select("request_id", "label", "spec", "t.*", shuffle_keys(
        F.col("seed"), F.concat_ws(" ", "label", "t.tier")).alias("keys"))
    # Requests are small files, their places are many: they are dealt to all tasks before they are written out.
    keyed = dealt(keyed, "request_id", "label", "tier")
    places = keyed.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    addressed = with_shuffled(places, "at", F.col("place"), "n").drop("keys", "place")
    # Cells of one spec and tier, at most as many as there are facet combinations.
    tier = F.coalesce(F.nullif("difficulty", F.lit("")), F.lit("medium"))
    order = Window.partitionBy("spec", "tier").orderBy("pool")
    layout = cells.select("spec", tier.alias("tier"), "pool", "n").withColumns({
        "strip": F.row_number().over(order),
        "lo": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")})
    starts = layout.groupBy("spec", "tier").agg(F.sort_array(F.collect_list("lo")).alias("starts"))
    located = addressed.join(starts, ["spec", "tier"]).select(
        "request_id", "label", "spec", "tier", "at", strip_of(F.col("starts"), F.col("at")).alias("strip"))
    wanted_rows = located.join(layout, ["spec", "tier", "strip"]).select(
        "request_id", "label", "pool", (F.col("at") - F.col("lo")).alias("pool_pos"))
    columns = ["pool", "pool_pos", "id", "chapter", "question_number", "section_type"]
    if not pools.classes.isEmpty():
        wanted_rows = cut_lineage(wanted_rows)
        by_concept = wanted_rows.select("pool", "pool_pos").distinct().join(pools.classes, "pool", "left_semi")
        found = nth_of_classes(cut_lineage(by_concept), pools.classes, pools.signed)
        index = index.select(columns).unionByName(found.select(columns))
    return wanted_rows.join(index.select(columns), ["pool", "pool_pos"]).drop("pool", "pool_pos")


def strip_of(starts: Column, at: Column) -> Column:
    """1-based index of the last of the ascending ``starts`` not beyond ``at``, by halving steps."""
    steps = F.transform(
        F.sequence(F.floor(F.log2(F.size(starts))).cast("int"), F.lit(0), F.lit(-1)),
        lambda e: F.pow(F.lit(2), e).cast("int"))
    return F.aggregate(steps, F.lit(0), lambda pos, step: F.when(
        F.get(starts, pos + step - 1) <= at, pos + step).otherwise(pos))


def in_syllabus_order(selected: DataFrame, requests: DataFrame, by_number: bool = True) -> DataFrame:
    """Adds the 1-based ``position`` per request: section label, chapter place, question number.

    Absent chapters and numbers that are NULL or 0 go last; ``id`` breaks ties. A request has at
    most as many rows as it asked for.
    """
    place = F.array_position("resolved_chapters", F.col("chapter"))
    ordered = selected.join(requests.select("request_id", "resolved_chapters"), "request_id").withColumns({
        "__chapter": F.when(place > 0, place - 1).otherwise(F.lit(C.MISSING_ORDER)),
        "__number": F.coalesce(F.nullif("question_number", F.lit(0)), F.lit(C.MISSING_ORDER)) if by_number
        else F.lit(0),
    })
    ordered = ordered.withColumn("__chapter", F.coalesce("__chapter", F.lit(C.MISSING_ORDER).cast("long")))
    placed = ordered.withColumn("position", F.row_number().over(
        Window.partitionBy("request_id").orderBy("label", "__chapter", "__number", "id")))
    return placed.drop("__chapter", "__number", "resolved_chapters")


def explicit_split(distribution: Column, count: Column) -> Column:
    """Tier counts of a request as fractions of its question count."""
    fractions = F.transform(distribution, lambda d: F.struct(
        d["tier"].alias("tier"), (d["n"] / count).alias("frac")))
    return F.when(F.size(distribution) > 0, fractions)


def select_for_requests(requests: DataFrame, questions: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Selection of resolved requests; those with too few candidates get none."""
    pools = prepare(with_spec(requests), questions)
    enough = availability(pools.requests, pools.cells).filter("can_generate")
    wanted = enough.select(
        "request_id", F.lit("A").alias("label"), "spec", "seed", F.col("question_count").alias("count"),
        explicit_split(F.col("difficulty_distribution"), F.col("question_count")).alias("split"))
    chosen = select_ids(wanted, pools, bank_index(questions) if index is None else index)
    return in_syllabus_order(chosen, requests).drop("label")


def select_for_blueprints(blueprints: DataFrame, questions: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Two-section selection: Section A from multiple choice, Section B from integer questions.

    ``blueprints``: ``request_id, exam_name, subject, chapters, section_a_count,
    section_b_count, split, seed``. A type distribution is accepted nowhere; it never had effect.
    """
    sections = F.explode(F.array(
        F.struct(F.lit("A").alias("label"), F.lit("mcq").alias("section_type"), F.col("section_a_count").alias("count")),
        F.struct(F.lit("B").alias("label"), F.lit("integer").alias("section_type"), F.col("section_b_count").alias("count")),
    )).alias("s")
    none, no_list = F.lit(None).cast("string"), F.array().cast("array<string>")
    asked = with_spec(dealt(blueprints).select("request_id", "exam_name", "subject", "chapters", "split", "seed", sections)
                      .select("request_id", "exam_name", "subject", F.col("chapters").alias("resolved_chapters"),
                              no_list.alias("excluded_chapters"), none.alias("difficulty"),
                              none.alias("question_type"), "s.section_type",
                              F.lit(None).cast("boolean").alias("has_formula"),
                              F.lit(None).cast("boolean").alias("has_diagram"),
                              no_list.alias("concepts"), F.lit("any").alias("concept_match_mode"),
                              "s.label", "s.count", "split", "seed"))
    pools = prepare(asked, questions)
    wanted = asked.select("request_id", "label", "spec", "seed", "count", "split")
    chosen = select_ids(wanted, pools, bank_index(questions) if index is None else index)
    order = blueprints.select("request_id", F.col("chapters").alias("resolved_chapters"))
    return in_syllabus_order(chosen, order, by_number=False)
