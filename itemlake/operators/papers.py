"""Papers and their ordered questions, edited as batches.

``papers``: ``id, prompt, status, blueprint, notes, created_at``.
``paper_questions``: ``paper_id, question_id, position, paper_section, display_number, locked``;
positions are 1-based and unique within a paper. Every edit comes back as the new state plus
the rejected edits with a reason; approved papers refuse all edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlake import constants as C
from itemlake.operators.bank import active
from itemlake.operators.ordered import by_range, ordered_scan, ranked_by_digest
from itemlake.operators.select import shuffle_keys, with_shuffled
from itemlake.session import cut_lineage

ROW = ["paper_id", "question_id", "position", "paper_section", "display_number", "locked"]


def section_name(section_type: Column) -> Column:
    return F.when(section_type == "mcq", "Section A").otherwise("Section B")


# --- Drafts --------------------------------------------------------------------------

def draft_rows(selected: DataFrame) -> DataFrame:
    """Paper rows of a selection ``(paper_id, id, section_type, position)``.

    Multiple choice first, then integer questions, each in selection order; any other section
    type is left out.
    """
    kept = selected.filter(F.col("section_type").isin(C.SECTION_TYPES)).withColumn(
        "__s", F.when(F.col("section_type") == "mcq", 0).otherwise(1))
    placed = ordered_scan(kept, ["paper_id"], ["__s", "position"],
                          buckets=[F.col("__s"), by_range("position")], position="__p")
    number = (F.col("__p") + 1).cast("int")
    return placed.select(
        "paper_id", F.col("id").alias("question_id"), number.alias("position"),
        section_name(F.col("section_type")).alias("paper_section"),
        number.alias("display_number"), F.lit(False).alias("locked"))


def draft_papers(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """Paper records of the requests that got at least one question."""
    made = rows.select(F.col("paper_id").alias("request_id")).distinct()
    blueprint = F.struct(
        "exam_name", "subject", F.col("question_count").alias("total_questions"),
        F.col("question_count").alias("section_a_count"), F.lit(0).alias("section_b_count"),
        F.col("resolved_chapters").alias("chapters"),
        default_split(F.col("difficulty_distribution"), F.col("question_count")).alias("difficulty_distribution"),
        "seed", F.col("range_description").alias("special_instructions"))
    return requests.join(made, "request_id", "left_semi").select(
        F.col("request_id").alias("id"), F.lit("draft").alias("status"), blueprint.alias("blueprint"))


def default_split(distribution: Column, count: Column) -> Column:
    """Fractions stored with a paper made from a request: its own tiers or the usual split."""
    usual = F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(f).alias("frac")) for t, f in C.DEFAULT_SPLIT])
    own = F.transform(distribution, lambda d: F.struct(d["tier"].alias("tier"), (d["n"] / count).alias("frac")))
    return F.when(F.size(distribution) > 0, own).otherwise(usual)


def regenerate(papers: DataFrame, rows: DataFrame, asked: DataFrame, selected: DataFrame,
               ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replace the rows of draft papers by a new selection.

    ``asked (paper_id, seed)`` names the papers; ``selected`` is the two-section selection made
    from their blueprints with the new seeds. A paper stored by a request has all its count in
    section A, so it gets multiple-choice questions only. Returns papers (seed replaced), rows
    and rejects.
    """
    wanted = asked.join(papers.select(F.col("id").alias("paper_id"), "status"), "paper_id", "left")
    got = selected.select("paper_id").distinct().withColumn("__got", F.lit(True))
    judged = wanted.join(got, "paper_id", "left").withColumn("reason", (
        F.when(F.col("status").isNull(), "Paper not found.")
        .when(F.col("status") == "approved", "Cannot regenerate an approved paper.")
        .when(F.col("__got").isNull(), "No questions found. Cannot regenerate.")))
    done = judged.filter(F.col("reason").isNull()).select("paper_id", "seed")
    fresh = draft_rows(selected.join(done.select("paper_id"), "paper_id", "left_semi"))
    new_rows = rows.join(done, "paper_id", "left_anti").select(ROW).unionByName(fresh.select(ROW))
    new_papers = papers.join(done.select(F.col("paper_id").alias("id"), F.col("seed").alias("__seed")), "id", "left")
    blueprint = F.when(F.col("__seed").isNotNull(), F.col("blueprint").withField("seed", F.col("__seed"))).otherwise(
        F.col("blueprint"))
    return (new_papers.withColumn("blueprint", blueprint).drop("__seed"), new_rows,
            judged.filter(F.col("reason").isNotNull()).select("paper_id", "reason"))


# --- Reading -----------------------------------------------------------------------------

def paper_detail(papers: DataFrame, rows: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per paper and question; papers without questions stay as one row."""
    shown = questions.select(
        F.col("id").alias("question_id"), "chapter", "difficulty", "question_type", "section_type")
    return (papers.select(F.col("id").alias("paper_id"), "status", "created_at")
            .join(rows.select(ROW), "paper_id", "left").join(shown, "question_id", "left")
            .select("paper_id", "status", "created_at", "position", "paper_section", "display_number",
                    "locked", "question_id", "chapter", "difficulty", "question_type", "section_type"))


def progress(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("locked").alias("locked"))
    return counts.withColumns({"pending": F.col("total") - F.col("locked"),
                               "all_done": F.col("total") == F.col("locked")})


def section_changes(rows: DataFrame) -> DataFrame:
    """Adds ``section_starts``: the section differs from that of the question before."""
    marked = rows.withColumn("__mark", F.struct(F.col("paper_section").alias("s")))
    scanned = ordered_scan(marked, ["paper_id"], ["position"], prior={"__before": F.col("__mark")})
    differs = ~F.col("paper_section").eqNullSafe(F.col("__before.s"))
    first_named = F.col("__before").isNull() & F.col("paper_section").isNotNull()
    return scanned.withColumn(
        "section_starts", F.when(F.col("__before").isNull(), first_named).otherwise(differs)
    ).drop("__mark", "__before")


def renumber(rows: DataFrame) -> DataFrame:
    """``display_number`` as the dense order of positions."""
    placed = ordered_scan(rows, ["paper_id"], ["position"], position="__p")
    return placed.withColumn("display_number", (F.col("__p") + 1).cast("int")).select(rows.columns)


# --- Shuffle -----------------------------------------------------------------------------------

def shuffle(papers: DataFrame, rows: DataFrame, seed: Column) -> tuple[DataFrame, DataFrame]:
    """Permute the unlocked rows of each section over the free positions of that section.

    ``seed`` is evaluated on the paper rows. Approved papers are returned as rejects; rows of
    other section names keep their place.
    """
    open_ids = papers.filter(F.col("status") != "approved").select(F.col("id").alias("paper_id"))
    rejects = papers.filter(F.col("status") == "approved").select(
        F.col("id").alias("paper_id"), F.lit("Cannot shuffle an approved paper.").alias("reason"))
    movable = ~F.col("locked") & F.col("paper_section").isin("Section A", "Section B")
    loose = rows.filter(movable).join(open_ids, "paper_id", "left_semi")
    keys = ["paper_id", "paper_section"]
    free = ordered_scan(loose.select(*keys, "position"), keys, ["position"], position="__slot")
    digest = F.md5(F.concat_ws(":", seed.cast("string"), F.col("question_id").cast("string")))
    mixed = ranked_by_digest(loose.select(*keys, "question_id"), keys, digest, "question_id", "__slot")
    moved = mixed.join(free, [*keys, "__slot"]).select(
        "paper_id", "question_id", F.col("position").alias("__to"))
    placed = (rows.join(moved, ["paper_id", "question_id"], "left")
              .withColumn("position", F.coalesce("__to", "position")).drop("__to").select(ROW))
    placed = cut_lineage(placed)
    touched = placed.join(open_ids, "paper_id", "left_semi")
    return renumber(touched).unionByName(placed.join(open_ids, "paper_id", "left_anti")), rejects


# --- Edits ----------------------------------------------------------------------------------------

def _judge(edits: DataFrame, papers: DataFrame, extra: Column, verb: str = "edit") -> DataFrame:
    """Edits with the ``reason`` they are refused for, NULL when accepted."""
    state = papers.select(F.col("id").alias("paper_id"), F.col("status").alias("__status"))
    return edits.join(state, "paper_id", "left").withColumn("reason", (
        F.when(F.col("__status").isNull(), "Paper not found.")
        .when(F.col("__status") == "approved", f"Cannot {verb} an approved paper.")
        .otherwise(extra))).drop("__status")


def _mark(edits: DataFrame, rows: DataFrame, question: str, flag: str) -> DataFrame:
    """Flag the edits whose ``question`` is in the paper."""
    here = rows.select("paper_id", F.col("question_id").alias(question), F.lit(True).alias(flag))
    return edits.join(here, ["paper_id", question], "left")


def membership_rejects(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """Edits ``(paper_id, question_id)`` whose question the paper already holds."""
    return edits.join(rows.select("paper_id", "question_id"), ["paper_id", "question_id"], "left_semi").withColumn(
        "reason", F.lit("This question is already in the paper."))


def swap(papers: DataFrame, rows: DataFrame, edits: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edits (paper_id, question_id, new_question_id)``: the row keeps position, section and lock.

    Valid swaps of a batch that meet in one row, or in one new question, are settled by ``edit_seq`` (or by
    the least id without that column): the first is made, the others are refused. A repeated swap is one.
    """
    marked = _mark(_mark(edits, rows, "question_id", "__old"), rows, "new_question_id", "__dup")
    known = questions.select(F.col("id").alias("new_question_id"), F.lit(True).alias("__known"))
    judged = _judge(marked.join(known, "new_question_id", "left"), papers, (
        F.when(F.col("__old").isNull(), "PaperQuestion not found.")
        .when(F.col("__known").isNull(), "Question not found.")
        .when(F.col("__dup"), "This question is already in the paper.")))
    judged = cut_lineage(judged.select(*edits.columns, "reason"))
    valid = judged.filter(F.col("reason").isNull())
    seq = F.col("edit_seq") if "edit_seq" in edits.columns else F.lit(0)
    per_row = (valid.groupBy("paper_id", "question_id").agg(F.min(F.struct(seq.alias("s"), "new_question_id")).alias("c"))
               .select("paper_id", "question_id", F.col("c.s").alias("s"), F.col("c.new_question_id").alias("new_question_id")))
    good = (per_row.groupBy("paper_id", "new_question_id").agg(F.min(F.struct("s", "question_id"))["question_id"].alias("question_id"))
            .select("paper_id", "question_id", "new_question_id"))
    new_rows = rows.join(good, ["paper_id", "question_id"], "left").withColumn(
        "question_id", F.coalesce("new_question_id", "question_id")).select(ROW)
    late = valid.join(good, ["paper_id", "question_id", "new_question_id"], "left_anti").withColumn(
        "reason", F.lit("Another swap of this batch takes the row or the question."))
    return new_rows, judged.filter(F.col("reason").isNotNull()).unionByName(late).select(*edits.columns, "reason")


def remove(papers: DataFrame, rows: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edits (paper_id, question_id)``: later positions move up by the removals before them."""
    wanted = edits.select("paper_id", "question_id").distinct()
    judged = _judge(_mark(wanted, rows, "question_id", "__old"), papers,
                    F.when(F.col("__old").isNull(), "PaperQuestion not found."))
    good = judged.filter(F.col("reason").isNull()).select(
        "paper_id", "question_id", F.lit(1).alias("__gone"))
    flagged = rows.select(ROW).join(good, ["paper_id", "question_id"], "left")
    scanned = ordered_scan(flagged, ["paper_id"], ["position"], running={"__before": F.col("__gone")})
    moved = F.col("__before") > 0
    position = (F.col("position") - F.col("__before")).cast("int")
    kept = scanned.filter(F.col("__gone").isNull()).withColumns({
        "display_number": F.when(moved, position).otherwise(F.col("display_number")), "position": position})
    return kept.select(ROW), judged.filter(F.col("reason").isNotNull()).select("paper_id", "question_id", "reason")


def add(papers: DataFrame, rows: DataFrame, edits: DataFrame, questions: DataFrame,
        ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``edits (paper_id, question_id, position, paper_section, edit_seq)``: insert and shift.

    A position past the end, 0 or NULL appends. Adds to one paper depend on each other, so a batch applies
    the first valid one per paper (by ``edit_seq``, then by its values) and returns the others as deferred
    for the next batch; a repeated edit is one. Returns rows, rejects, deferred.
    """
    known = questions.select(F.col("id").alias("question_id"), F.col("section_type").alias("__type"))
    marked = _mark(edits, rows, "question_id", "__dup").join(known, "question_id", "left")
    judged = _judge(marked, papers, (
        F.when(F.col("__type").isNull(), "Question not found.")
        .when(F.col("__dup"), "This question is already in the paper.")))
    valid = judged.filter(F.col("reason").isNull())
    edit = F.struct("edit_seq", "question_id", "position", "paper_section", "__type")
    first = valid.groupBy("paper_id").agg(F.min(edit).alias("__first"))
    now = first.select("paper_id", "__first.*")
    deferred = valid.join(first, "paper_id").filter(~edit.eqNullSafe(F.col("__first"))).select(edits.columns)
    ends = rows.groupBy("paper_id").agg(F.max("position").alias("__end"))
    end = F.coalesce("__end", F.lit(0)) + 1
    placed = now.join(ends, "paper_id", "left").withColumn(
        "__at", F.least(F.coalesce(F.nullif("position", F.lit(0)), end), end).cast("int"))
    new = placed.select(
        "paper_id", "question_id", F.col("__at").alias("position"),
        F.coalesce(F.nullif("paper_section", F.lit("")), section_name(F.col("__type"))).alias("paper_section"),
        F.col("__at").alias("display_number"), F.lit(False).alias("locked"))
    shifted = rows.select(ROW).join(placed.select("paper_id", "__at"), "paper_id", "left")
    later = F.coalesce(F.col("position") >= F.col("__at"), F.lit(False))
    position = F.when(later, F.col("position") + 1).otherwise(F.col("position"))
    shifted = shifted.withColumns({
        "display_number": F.when(later, position).otherwise(F.col("display_number")),
        "position": position}).select(ROW)
    return (shifted.unionByName(new), judged.filter(F.col("reason").isNotNull()).select(*edits.columns, "reason"),
            deferred)


#: Additions of one paper that are placed among each other in one expression.
ADDED_AT_ONCE = 64


def _pushed(values: DataFrame, slots: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, at, moved)`` for ``values (keys, at)``: the at-th place that ``slots (keys, slot)`` leave free.

    The slots before it are counted by a running sum over the gaps between slots, so neither side meets the other.
    """
    ranked = ordered_scan(slots, keys, ["slot"], position="__t")
    gaps = ranked.groupBy(*keys, (F.col("slot") - F.col("__t")).alias("at")).agg(F.count(F.lit(1)).alias("__n"))
    asked = values.select(*keys, "at").distinct().withColumns({"__n": F.lit(0).cast("long"), "__kind": F.lit(1)})
    counted = ordered_scan(asked.unionByName(gaps.withColumn("__kind", F.lit(0))), keys, ["at", "__kind"], running={"__shift": F.col("__n")})
    return counted.filter("__kind = 1").select(*keys, "at", (F.col("at") + F.col("__shift")).alias("moved"))


def _slots(placed: DataFrame) -> DataFrame:
    """``(paper_id, rank, slot)``: where the additions ``(paper_id, rank, at)`` of each paper end, made in the order of rank.

    Seen from the end, an addition takes the at-th place that all later ones leave free. Runs of additions are resolved
    that way at once; then neighbouring runs are put together, the earlier pushed by the later, twice as long ones each
    time. So a paper with very many additions is spread over tasks.
    """
    block = F.floor(F.col("rank") / ADDED_AT_ONCE).cast("long")
    runs = placed.groupBy("paper_id", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", "at"))).alias("run"))

    def take(taken: Column, edit: Column) -> Column:
        before = F.size(F.filter(taken, lambda t, i: t["slot"] - i <= edit["at"]))
        return F.array_sort(F.concat(taken, F.array(F.struct((edit["at"] + before).alias("slot"), edit["rank"].alias("rank")))))

    empty = F.array().cast("array<struct<slot:bigint,rank:bigint>>")
    state = cut_lineage(runs.select("paper_id", "block", F.explode(F.aggregate(F.reverse("run"), empty, take)).alias("s"))
                        .select("paper_id", "block", "s.rank", "s.slot"))
    last, width = state.agg(F.max("block")).first()[0] or 0, 1
    while width <= last:
        pair = state.withColumns({"pair": F.floor(F.col("block") / (2 * width)).cast("long"), "later": F.floor(F.col("block") / width) % 2 == 1})
        early, late = pair.filter(~F.col("later")), pair.filter("later")
        keys = ["paper_id", "pair"]
        moved = _pushed(early.withColumnRenamed("slot", "at"), late.select(*keys, "slot"), keys)
        pushed = early.join(moved.withColumnRenamed("at", "slot"), [*keys, "slot"]).withColumn("slot", F.col("moved"))
        state = cut_lineage(pushed.select("paper_id", "block", "rank", "slot").unionByName(late.select("paper_id", "block", "rank", "slot")))
        width *= 2
    return state.select("paper_id", "rank", "slot")


def add_batch(papers: DataFrame, rows: DataFrame, edits: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All additions ``edits (paper_id, question_id, position, paper_section, edit_seq)`` of a batch, as if made one by one
    in the order of ``edit_seq`` (NULL last, then by question). Returns rows and rejects.

    A position past the end at that time, 0 or NULL appends. Of several additions of one question to a paper the first
    counts and the others are refused; a repeated edit is one.
    """
    known = questions.select(F.col("id").alias("question_id"), F.col("section_type").alias("__type"))
    marked = _mark(edits.distinct(), rows, "question_id", "__dup").join(known, "question_id", "left")
    judged = cut_lineage(_judge(marked, papers, (
        F.when(F.col("__type").isNull(), "Question not found.")
        .when(F.col("__dup"), "This question is already in the paper."))))
    valid = judged.filter(F.col("reason").isNull()).withColumn("__seq", F.coalesce(F.col("edit_seq").cast("long"), F.lit(2**40)))
    edit = F.struct("__seq", "position", "paper_section")
    first = valid.groupBy("paper_id", "question_id").agg(F.min(edit).alias("__first"), F.first("__type").alias("__type"))
    again = (valid.join(first.select("paper_id", "question_id", "__first"), ["paper_id", "question_id"]).filter(~edit.eqNullSafe(F.col("__first")))
             .withColumn("reason", F.lit("This question is already in the paper.")))
    ranked = cut_lineage(ordered_scan(first.select("paper_id", "question_id", "__first.*", "__type"), ["paper_id"], ["__seq", "question_id"], position="rank"))
    ends = rows.groupBy("paper_id").agg(F.max("position").alias("__end"))
    end = F.coalesce("__end", F.lit(0)) + 1 + F.col("rank")
    wanted = F.when(F.col("position") > 0, F.least(F.col("position"), end)).otherwise(end)
    slots = cut_lineage(_slots(ranked.join(ends, "paper_id", "left").select("paper_id", "rank", wanted.cast("long").alias("at"))))
    new = ranked.join(slots, ["paper_id", "rank"]).select(
        "paper_id", "question_id", F.col("slot").cast("int").alias("position"),
        F.coalesce(F.nullif("paper_section", F.lit("")), section_name(F.col("__type"))).alias("paper_section"),
        F.col("slot").cast("int").alias("display_number"), F.lit(False).alias("locked"))
    grown = slots.select("paper_id").distinct()
    places = rows.join(grown, "paper_id", "left_semi").select("paper_id", F.col("position").cast("long").alias("at"))
    moved = _pushed(places, slots.select("paper_id", "slot"), ["paper_id"]).select("paper_id", F.col("at").alias("position"), F.col("moved").cast("int").alias("moved"))
    kept = rows.select(ROW).join(moved, ["paper_id", "position"], "left").withColumns({
        "display_number": F.when(F.col("moved") > F.col("position"), F.col("moved")).otherwise(F.col("display_number")),
        "position": F.coalesce("moved", "position")})
    return (kept.select(ROW).unionByName(new.select(ROW)),
            judged.filter(F.col("reason").isNotNull()).select(*edits.columns, "reason").unionByName(again.select(*edits.columns, "reason")))


def toggle_locks(papers: DataFrame, rows: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edits (paper_id, question_id)``; each edit toggles once."""
    counted = edits.groupBy("paper_id", "question_id").agg(F.count(F.lit(1)).alias("__times"))
    judged = _judge(_mark(counted, rows, "question_id", "__old"), papers,
                    F.when(F.col("__old").isNull(), "PaperQuestion not found."))
    good = judged.filter(F.col("reason").isNull()).select("paper_id", "question_id", "__times")
    odd = F.coalesce(F.col("__times") % 2 == 1, F.lit(False))
    new_rows = rows.join(good, ["paper_id", "question_id"], "left").withColumn(
        "locked", F.when(odd, ~F.col("locked")).otherwise(F.col("locked"))).select(ROW)
    return new_rows, judged.filter(F.col("reason").isNotNull()).select("paper_id", "question_id", "reason")


def approve(papers: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edits (paper_id, notes)``; only drafts can be approved, empty notes keep the old ones.

    Several approvals of a paper in a batch are one, with the least of their notes that are not empty.
    """
    state = papers.select(F.col("id").alias("paper_id"), F.col("status").alias("__status"))
    judged = edits.join(state, "paper_id", "left").withColumn("reason", (
        F.when(F.col("__status").isNull(), "Paper not found.")
        .when(F.col("__status") == "approved", "Paper is already approved.")
        .when(F.col("__status") != "draft", F.concat(
            F.lit("Cannot approve a paper with status: "), F.col("__status")))))
    good = judged.filter(F.col("reason").isNull()).groupBy(F.col("paper_id").alias("id")).agg(
        F.min(F.nullif("notes", F.lit(""))).alias("__notes"), F.lit(True).alias("__ok"))
    joined = papers.join(good, "id", "left").withColumns({
        "status": F.when(F.col("__ok"), "approved").otherwise(F.col("status")),
        "notes": F.coalesce("__notes", "notes")})
    return joined.select(papers.columns), judged.filter(F.col("reason").isNotNull()).select("paper_id", "reason")


def delete_papers(papers: DataFrame, rows: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers go together with their rows."""
    ids = requested.select("id").distinct()
    return (papers.join(ids, "id", "left_anti"),
            rows.join(ids.withColumnRenamed("id", "paper_id"), "paper_id", "left_anti"))


# --- Alternatives --------------------------------------------------------------------------------------

#: Rows of a paper up to which its used places are gathered beside each row.
SHORT_PAPER = 128


def alternatives(rows: DataFrame, questions: DataFrame, seed: Column, count: int = C.ALTERNATIVES) -> DataFrame:
    """Up to ``count`` replacements per paper row ``(paper_id, question_id, rank, alternative_id)``.

    Same subject, chapter (NULL equals NULL), section type and, if set, difficulty; active and
    not in the paper. Rows never meet whole pools: every question has a shuffled place in its
    pool, the places a paper already uses are known, and the j-th free place follows from the used ones before it.
    Short papers bring their used places together and find it row by row; in long ones it is found by a running count.
    Pools go by number, and each stage that feeds several branches is written once, in narrow columns.
    """
    base = ["subject", "chapter", "section_type"]
    graded = F.nullif("difficulty", F.lit(""))
    key = F.to_json(F.struct(*base, graded.alias("difficulty")), {"ignoreNullFields": "false"})
    open_key = F.to_json(F.struct(*base, F.lit("*").alias("any_difficulty")), {"ignoreNullFields": "false"})
    named = questions.select(
        F.col("id").alias("question_id"), F.when(graded.isNotNull(), key).otherwise(open_key).alias("name"))
    pools = active(questions).select("id", F.explode(F.array_compact(F.array(
        F.when(graded.isNotNull(), key), open_key))).alias("name"))
    numbered = cut_lineage(named.join(rows.select("question_id").distinct(), "question_id", "left_semi")
                           .select("name").distinct().withColumn("pool", F.monotonically_increasing_id()))
    placed = cut_lineage(ranked_by_digest(
        pools.join(numbered, "name").drop("name"), ["pool"], F.md5(F.col("id").cast("string")), "id", "place"))
    sizes = placed.groupBy("pool").agg(F.count(F.lit(1)).alias("size"))
    own = named.join(numbered, "name").join(sizes, "pool").select("question_id", "pool", "size")

    long_ones = cut_lineage(rows.groupBy("paper_id").agg(F.count(F.lit(1)).alias("__n")).filter(
        F.col("__n") > SHORT_PAPER).select("paper_id"))
    stops = _free_places(rows.filter(F.col("paper_id").isNotNull()).join(long_ones, "paper_id", "left_anti"), own, placed, seed, count)
    if not long_ones.isEmpty():
        stops = stops.unionByName(_free_places_of_long(
            rows.join(long_ones, "paper_id", "left_semi"), own, placed, seed, count))
    found = stops.join(placed.withColumnRenamed("id", "alternative_id"), ["pool", "place"])
    return found.select("paper_id", "question_id", F.col("rank").cast("int").alias("rank"), "alternative_id")


def _drawn_places(sized: DataFrame, seed: Column, count: int) -> DataFrame:
    """``sized`` rows with ``free > 0`` once per ``rank``, ``at`` being the free place that is drawn."""
    keyed = sized.filter(F.col("free") > 0).withColumn("keys", shuffle_keys(seed, F.col("question_id")))
    ranks = keyed.withColumn("rank", F.explode(F.sequence(
        F.lit(1).cast("long"), F.least(F.col("free"), F.lit(count).cast("long")))))
    return with_shuffled(ranks, "at", F.col("rank") - 1, "free").drop("keys")


def _free_places(rows: DataFrame, own: DataFrame, placed: DataFrame, seed: Column, count: int) -> DataFrame:
    """``(paper_id, question_id, rank, pool, place)`` drawn for the rows of short papers."""
    spots = placed.groupBy(F.col("id").alias("question_id")).agg(F.collect_list(F.struct("pool", "place")).alias("spots"))
    asked = rows.select("paper_id", "question_id").join(own.join(spots, "question_id", "left"), "question_id")
    papers = asked.groupBy("paper_id").agg(
        F.collect_list(F.struct("question_id", "pool", "size")).alias("asked"),
        F.flatten(F.collect_list("spots")).alias("spots"))
    each = papers.select("paper_id", "spots", F.explode("asked").alias("a")).select("paper_id", "a.*", "spots")
    used = F.array_sort(F.array_distinct(F.transform(F.filter("spots", lambda s: s["pool"] == F.col("pool")), lambda s: s["place"])))
    sized = each.withColumn("used", used).drop("spots").withColumn("free", F.col("size") - F.size("used"))
    place = F.aggregate("used", F.col("at"), lambda at, u: F.when(u <= at, at + 1).otherwise(at))
    return _drawn_places(sized, seed, count).select("paper_id", "question_id", "rank", "pool", place.alias("place"))


def _free_places_of_long(rows: DataFrame, own: DataFrame, placed: DataFrame, seed: Column, count: int) -> DataFrame:
    """The same for rows of papers of any length: used places are ranked, and free ones counted by their gaps."""
    asked = cut_lineage(rows.select("paper_id", "question_id").join(own, "question_id"))
    in_paper = rows.select("paper_id", F.col("question_id").alias("id"))
    groups = ["paper_id", "pool"]
    used = (placed.join(in_paper, "id").select(*groups, "place")
            .join(asked.select(*groups).distinct(), groups, "left_semi"))
    ranked = cut_lineage(ordered_scan(used, groups, ["place"], position="__j"))
    gaps = ranked.groupBy(*groups, (F.col("place") - F.col("__j")).alias("at")).agg(
        F.count(F.lit(1)).alias("taken"))
    taken = ranked.groupBy(*groups).agg(F.count(F.lit(1)).alias("taken_all"))
    sized = asked.join(taken, groups, "left").withColumn("free", F.col("size") - F.coalesce("taken_all", F.lit(0)))
    stops = cut_lineage(_drawn_places(sized, seed, count).select("paper_id", "question_id", "rank", "pool", "at"))
    lookups = stops.select(*groups, "at").distinct().withColumns({"taken": F.lit(0).cast("long"), "kind": F.lit(1)})
    merged = lookups.unionByName(gaps.withColumn("kind", F.lit(0)))
    counted = ordered_scan(merged, groups, ["at", "kind"], running={"__shift": F.col("taken")})
    spots = counted.filter("kind = 1").select(*groups, "at", (F.col("at") + F.col("__shift")).alias("place"))
    return stops.join(spots, [*groups, "at"]).select("paper_id", "question_id", "rank", "pool", "place")
