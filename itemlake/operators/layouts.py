"""From cleaned blocks to questions.

A question is the run of blocks from one question start to the next. Which start a block
belongs to is found with ``ordered_scan``, so a document of any size is split over tasks; the
blocks of one question are then brought together once, because its stem is a single value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlake import constants as C
from itemlake.functions import text as X
from itemlake.operators.ordered import by_range, ordered_scan
from itemlake.session import cut_lineage

NO_OPTIONS = "array<struct<label:string,value:string>>"


def _col(name: str) -> Column:
    return F.col(name)


def _has_image(kind: Column, path: Column) -> Column:
    return F.coalesce(kind.isin("image", "table") & (path != ""), F.lit(False))


def _file_name(path: Column) -> Column:
    return X.base_name(F.coalesce(path, F.lit("")))


# --- Detection -----------------------------------------------------------------------

def detect_inline(blocks: DataFrame) -> DataFrame:
    """``(doc_id, starts, answered, is_inline)``: enough starts have an answer close behind."""
    start = X.start_number(_col("type"), _col("text")).isNotNull()
    flagged = blocks.select(
        "doc_id", "block_idx", start.alias("is_start"),
        X.is_answer(_col("type"), _col("text")).alias("is_ans"))
    placed = cut_lineage(ordered_scan(flagged, ["doc_id"], ["block_idx"], position="pos"))
    scanned = ordered_scan(placed, ["doc_id"], ["block_idx"],
                           following={"next_ans": F.when(_col("is_ans"), _col("pos"))})
    near = _col("is_start") & (_col("next_ans") - _col("pos") <= C.INLINE_WINDOW)
    counts = scanned.groupBy("doc_id").agg(
        F.count_if("is_start").alias("starts"), F.count_if(near).alias("answered"))
    share = _col("answered") / F.when(_col("starts") > 0, _col("starts"))
    return counts.withColumn("is_inline", F.coalesce(share > C.INLINE_SHARE, F.lit(False)))


def detect_by_key(blocks: DataFrame) -> DataFrame:
    """``(doc_id, is_separate_key, is_full_paper)`` from where the key header stands."""
    texts = blocks.filter(X.is_text(_col("type"))).select(
        "doc_id", "block_idx",
        X.is_key_header(_col("text")).alias("is_header"),
        F.coalesce(_col("text").rlike(C.INLINE_ANSWER_HINT), F.lit(False)).alias("is_hint"),
        F.coalesce(_col("text").rlike(C.Q_PREFIX), F.lit(False)).alias("is_prefix"))
    placed = cut_lineage(ordered_scan(texts, ["doc_id"], ["block_idx"], position="pos"))
    totals = placed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(_col("is_header"), _col("pos"))).alias("last_header"),
        F.min(F.when(_col("is_prefix"), _col("pos"))).alias("first_prefix"))
    head = F.floor(_col("n") * F.lit(C.SEPARATE_KEY_HEAD))
    hints = (placed.filter("is_hint").select("doc_id", "pos").join(totals.select("doc_id", "n"), "doc_id")
             .filter(_col("pos") < head).groupBy("doc_id").agg(F.count(F.lit(1)).alias("hints")))
    separate = (_col("last_header") >= head) & (
        F.coalesce("hints", F.lit(0)) < C.SEPARATE_KEY_MAX_INLINE)
    full = (_col("first_prefix") < C.FULL_PAPER_HEAD_BLOCKS) & (
        _col("last_header") >= F.floor(_col("n") * F.lit(C.FULL_PAPER_TAIL)))
    return totals.join(hints, "doc_id", "left").select(
        "doc_id", F.coalesce(separate, F.lit(False)).alias("is_separate_key"),
        F.coalesce(full, F.lit(False)).alias("is_full_paper"))


def detect_layout(blocks: DataFrame) -> DataFrame:
    """One layout per document: full paper, separate key, inline answer, else NULL."""
    both = detect_inline(blocks).join(detect_by_key(blocks), "doc_id", "left")
    layout = (F.when(_col("is_full_paper"), "full_paper")
              .when(_col("is_separate_key"), "separate_answer_key")
              .when(_col("is_inline"), "inline_answer"))
    return both.select("doc_id", "is_inline", "is_separate_key", "is_full_paper",
                       layout.alias("layout_type"))


# --- Question runs ----------------------------------------------------------------------

def question_runs(blocks: DataFrame, number: Column) -> DataFrame:
    """Blocks with the ``start_idx`` and ``question_number`` of their run; preamble dropped."""
    tagged = blocks.withColumn("__n", number)
    start = F.when(_col("__n").isNotNull(), F.struct(_col("block_idx").alias("i"), _col("__n").alias("n")))
    runs = ordered_scan(tagged, ["doc_id"], ["block_idx"], last={"__start": start})
    return (runs.filter(_col("__start").isNotNull())
            .withColumns({"start_idx": _col("__start.i"), "question_number": _col("__start.n")})
            .drop("__n", "__start"))


def inline_runs(blocks: DataFrame) -> DataFrame:
    """Question runs of inline papers with the header values that hold when the run ends.

    A header between two questions labels the first of them too, and so does one that is
    itself the next start.
    """
    is_header = X.is_text(_col("type")) & (F.coalesce("text_level", F.lit(0)) != 0)
    number = X.start_number(_col("type"), _col("text"))
    tagged = blocks.withColumn("__n", number)
    start = F.when(_col("__n").isNotNull(), F.struct(_col("block_idx").alias("i"), _col("__n").alias("n")))
    ahead = ordered_scan(tagged, ["doc_id"], ["block_idx"], last={
        "__start": start,
        "__subject": F.when(is_header, X.header_subject(_col("text"))),
        "__section": F.when(is_header, X.section_label(_col("text"), C.INLINE_SECTION)),
    })
    at_start = F.when(_col("__n").isNotNull(), F.struct(
        _col("__subject").alias("subject"), _col("__section").alias("section")))
    closed = ordered_scan(ahead, ["doc_id"], ["block_idx"], following={"__close": at_start})
    final = F.coalesce(_col("__close"), F.struct(
        _col("__subject").alias("subject"), _col("__section").alias("section")))
    return (closed.filter(_col("__start").isNotNull())
            .withColumns({"start_idx": _col("__start.i"), "question_number": _col("__start.n"),
                          "__label": final})
            .drop("__n", "__start", "__subject", "__section", "__close"))


def _inline_questions(runs: DataFrame, need_answer: bool) -> DataFrame:
    """One row per run: stem, options, answer, images."""
    plain, kind, raw = X.is_text(_col("type")), _col("type"), _col("__raw")
    empty = F.array().cast(NO_OPTIONS)
    marker = F.coalesce(F.nullif(F.instr(raw, "(1)"), F.lit(0)), F.instr(raw, "(A)"))
    read = runs.withColumn("__raw", F.coalesce("text", F.lit(""))).withColumns({
        "__direct": F.when(plain & raw.rlike(C.OPTION_MARKER), X.split_options(raw)),
        "__array": F.when(plain & F.contains(raw, F.lit("\\begin")), X.latex_array_options(X.group1(raw, C.LATEX_ARRAY, 0))),
        "__ans": F.when(plain, X.extract_answer(raw)),
        "__lead": F.when(plain & (marker > 1), X.py_strip(F.left(raw, marker - 1))),
    })
    part = F.struct(
        _col("block_idx").alias("i"), plain.alias("plain"), raw.alias("raw"), _col("__ans").alias("ans"),
        F.when(F.size("__direct") > 0, _col("__direct")).otherwise(F.coalesce("__array", empty)).alias("opts"),
        F.coalesce("__lead", F.lit("")).alias("lead"),
        F.when((kind == "equation") & ~X.is_blank(raw), X.py_strip(raw)).alias("eq"),
        F.when(_has_image(kind, _col("img_path")), _file_name(_col("img_path"))).alias("img"),
    )
    grouped = read.groupBy("doc_id", "start_idx", "question_number").agg(
        F.sort_array(F.collect_list(part)).alias("parts"),
        F.max(F.when(_col("block_idx") == _col("start_idx"), _col("page_idx"))).alias("source_page"),
        F.max_by("__label", "block_idx").alias("label"),
    )
    answers = F.filter("parts", lambda p: p["ans"].isNotNull())
    answer_idx = F.get(F.transform(answers, lambda p: p["i"]), F.lit(0))
    stepped = grouped.withColumns({
        "answer": F.get(F.transform(answers, lambda p: p["ans"]), F.lit(0)),
        "__before": F.filter("parts", lambda p: p["plain"] & (X.py_strip(p["raw"]) != "") & (
            answer_idx.isNull() | (p["i"] < answer_idx))),
    })
    with_options = F.filter("__before", lambda p: F.size(p["opts"]) > 0)
    stepped = stepped.withColumns({
        "__opt_i": F.get(F.transform(with_options, lambda p: p["i"]), F.lit(0)),
        "options": F.coalesce(F.get(F.transform(with_options, lambda p: p["opts"]), F.lit(0)),
                              F.array().cast(NO_OPTIONS)),
    })
    pieces = F.transform("__before", lambda p: F.when(
        F.coalesce(p["i"] == _col("__opt_i"), F.lit(False)), p["lead"]).otherwise(p["raw"]))
    stem = F.array_join(F.filter(pieces, lambda s: s != ""), "\n\n")
    equations = F.array_join(
        F.transform(F.filter("parts", lambda p: p["eq"].isNotNull()),
                    lambda p: F.concat(F.lit("$$"), p["eq"], F.lit("$$"))), "\n\n")
    names = F.transform(F.filter("parts", lambda p: p["img"].isNotNull()), lambda p: p["img"])
    built = stepped.select(
        "doc_id", "start_idx", "question_number",
        F.when(equations != "", X.py_strip(F.concat_ws("\n\n", stem, equations)))
        .otherwise(stem).alias("stem_md"),
        "options", "answer",
        F.when(F.size("options") > 0, F.lit("mcq")).otherwise(F.lit("integer")).alias("section_type"),
        _col("label.section").alias("section_label"), names.alias("image_names"),
        "source_page", _col("label.subject").alias("subject"),
        F.array().cast("array<string>").alias("warnings"),
    )
    keep = _col("stem_md") != ""
    return built.filter(keep & _col("answer").isNotNull()) if need_answer else built.filter(keep)


def build_inline(blocks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Inline-answer papers: the first answer of a run closes it, runs without one are dropped."""
    questions = _inline_questions(inline_runs(blocks), need_answer=True)
    return link_images(questions, files).drop("unlinked")


# --- Separate answer key --------------------------------------------------------------------

def separate_key_entries(blocks: DataFrame) -> DataFrame:
    """``(doc_id, question_number, raw_answer)`` read from the end of the document.

    Reading backwards, entries count until the first question-like block in front of the
    last header. The later block wins, inside a block the earlier entry.
    """
    texts = blocks.filter(X.is_text(_col("type")))
    header = X.is_key_header(_col("text"))
    last_header = texts.filter(header).groupBy("doc_id").agg(F.max("block_idx").alias("header_idx"))
    stop = (texts.filter(X.looks_like_question(_col("text")) & ~header)
            .select("doc_id", "block_idx").join(last_header, "doc_id")
            .filter(_col("block_idx") < _col("header_idx"))
            .groupBy("doc_id").agg(F.max("block_idx").alias("stop_idx")))
    candidates = texts.filter(~header & _col("text").rlike(C.LOOSE_KEY_ENTRY))
    kept = (candidates.join(stop, "doc_id", "left")
            .filter(_col("stop_idx").isNull() | (_col("block_idx") > _col("stop_idx"))))
    entries = kept.select(
        "doc_id", "block_idx",
        F.posexplode(X.key_entries(X.py_strip(_col("text")), C.LOOSE_KEY_ENTRY)).alias("at", "e"),
    ).filter(F.length("e.answer") <= C.KEY_VALUE_LENGTH)
    return entries.groupBy("doc_id", _col("e.number").alias("question_number")).agg(
        F.max_by("e.answer", F.struct("block_idx", -_col("at"))).alias("raw_answer"))


def build_separate_key(blocks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Papers with the key at the end.

    Runs end at the last key header, so key lines are never read as questions. A question the
    key does not name keeps a NULL answer.
    """
    header = X.is_text(_col("type")) & X.is_key_header(_col("text"))
    last_header = blocks.filter(header).groupBy("doc_id").agg(F.max("block_idx").alias("header_idx"))
    body = (blocks.join(last_header, "doc_id", "left")
            .filter(_col("header_idx").isNull() | (_col("block_idx") < _col("header_idx")))
            .select(blocks.columns))
    questions = _inline_questions(inline_runs(body), need_answer=False).drop("answer")
    joined = questions.join(separate_key_entries(blocks), ["doc_id", "question_number"], "left")
    letters = F.coalesce(X.lookup(C.NUMBER_TO_LETTER, _col("raw_answer")), _col("raw_answer"))
    answer = F.when(_col("section_type") == "mcq", letters).otherwise(_col("raw_answer"))
    return link_images(joined.withColumn("answer", answer).drop("raw_answer"), files).drop("unlinked")


# --- Full papers ---------------------------------------------------------------------------------

def filter_noise(blocks: DataFrame) -> DataFrame:
    return blocks.filter(~(X.is_text(_col("type")) & X.is_noise(_col("text"))))


def key_boundary(blocks: DataFrame) -> DataFrame:
    """``(doc_id, boundary_idx, key_img_path)`` per document, NULL when there is no key.

    The last header block; else the first dense block of the tail; else a text-less table or
    image among the last few blocks, whose path is returned.
    """
    kind, body = _col("type"), X.block_body(_col("text"), _col("html"))
    readable = kind.isin("text", "table")
    blank = X.is_blank(F.coalesce(F.when(_col("text") != "", _col("text")), _col("html")))
    features = blocks.select(
        "doc_id", "block_idx",
        F.coalesce(readable & X.is_key_header(body), F.lit(False)).alias("is_header"),
        F.coalesce(readable & (F.regexp_count(body, F.lit(C.KEY_ENTRY)) >= C.DENSE_KEY_ENTRIES),
                   F.lit(False)).alias("is_dense"),
        F.when(_has_image(kind, _col("img_path")) & blank, _col("img_path")).alias("bare_image"),
    )
    # Texts are read once; what follows works on these few flags.
    placed = cut_lineage(ordered_scan(features, ["doc_id"], ["block_idx"], position="pos"))
    totals = placed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(_col("is_header"), _col("block_idx"))).alias("header_idx"))
    tail = (placed.filter(_col("is_dense") | _col("bare_image").isNotNull())
            .join(totals, "doc_id")
            .groupBy("doc_id").agg(
                F.min(F.when(_col("is_dense") & (_col("pos") >= F.floor(_col("n") * F.lit(C.DENSE_KEY_TAIL))),
                             _col("block_idx"))).alias("dense_idx"),
                F.max(F.when(_col("bare_image").isNotNull() & (_col("pos") >= _col("n") - C.IMAGE_KEY_TAIL),
                             F.struct("block_idx", "bare_image"))).alias("image")))
    text_idx = F.coalesce("header_idx", "dense_idx")
    return totals.join(tail, "doc_id", "left").select(
        "doc_id", F.coalesce(text_idx, _col("image.block_idx")).alias("boundary_idx"),
        F.when(text_idx.isNull(), _col("image.bare_image")).alias("key_img_path"))


def full_paper_key(blocks: DataFrame, boundary: DataFrame) -> DataFrame:
    """``(doc_id, question_number, raw_answer)``; the first entry of a number wins."""
    body = X.block_body(_col("text"), _col("html"))
    entries = (blocks.filter(_col("type").isin("text", "table"))
               .withColumn("__body", body).filter(_col("__body").rlike(C.KEY_ENTRY))
               .join(boundary.filter(_col("boundary_idx").isNotNull()), "doc_id")
               .filter(_col("block_idx") >= _col("boundary_idx"))
               .select("doc_id", "block_idx", F.posexplode(X.key_entries(_col("__body"))).alias("at", "e"))
               .filter(_col("e.answer") != ""))
    return entries.groupBy("doc_id", _col("e.number").alias("question_number")).agg(
        F.min_by("e.answer", F.struct("block_idx", "at")).alias("raw_answer"))


def full_paper_runs(body: DataFrame) -> DataFrame:
    """Question runs of the paper body with the section label that held at their start."""
    kind, text = _col("type"), X.py_strip(F.coalesce("text", F.lit("")))
    plain = X.is_text(kind)
    usable = body.filter(plain | kind.isin("image", "equation") | _has_image(kind, _col("img_path")))
    short = plain & (F.length(text) < C.SECTION_LABEL_LENGTH)
    tagged = usable.withColumn("__n", F.when(plain, X.question_number(text)))
    labelled = ordered_scan(tagged, ["doc_id"], ["block_idx"], last={
        "__section": F.when(short, X.section_label(text, C.FULL_PAPER_SECTION)),
        "__start": F.when(_col("__n").isNotNull(), F.struct(
            _col("block_idx").alias("i"), _col("__n").alias("n"))),
    })
    return (labelled.filter(_col("__start").isNotNull())
            .withColumns({"start_idx": _col("__start.i"), "question_number": _col("__start.n")})
            .drop("__start", "__n"))


def _candidates(found: Column, source: str) -> Column:
    return F.transform(found, lambda o: F.struct(
        o["label"].alias("label"), o["value"].alias("value"), F.lit(source).alias("source")))


def _full_paper_groups(runs: DataFrame) -> DataFrame:
    """One row per run with its stem, options, option conflicts and image names."""
    plain, equation = X.is_text(_col("type")), _col("type") == "equation"
    raw, t, none = _col("__raw"), _col("__t"), F.array().cast(NO_OPTIONS)
    is_embedded, is_merged = F.size("__embedded") > 0, _col("__merged").isNotNull()
    read = runs.withColumn("__raw", F.coalesce("text", F.lit(""))).withColumns({
        "__t": F.when(plain, X.normalize_text(raw)), "__eq": F.when(equation, X.py_strip(raw)),
    }).withColumns({
        "__embedded": F.when(F.contains(t, F.lit("\\begin")), X.embedded_array_options(t)).otherwise(none),
        "__merged": X.merged_marker_options(t),
        "__inline": F.when(t.rlike(C.OPTION_MARKER), X.inline_options(t)).otherwise(none),
        "__formula": F.when(F.contains("__eq", F.lit("\\begin")), X.equation_options(_col("__eq"))).otherwise(none),
    })
    cands = (F.when(plain & is_embedded, _candidates(_col("__embedded"), "embedded array"))
             .when(plain & is_merged, _candidates(_col("__merged"), "merged marker"))
             .when(plain, _candidates(_col("__inline"), "text block"))
             .when(equation, _candidates(_col("__formula"), "equation")))
    stem = (F.when(plain & ~is_embedded & ~is_merged, X.stem_fragment(t))
            .when(equation & (F.size("__formula") == 0), _col("__eq")))
    read = read.withColumns({"__cands": cands, "__stem": stem})
    part = F.struct(
        _col("block_idx").alias("i"), _col("__cands").alias("cands"),
        F.nullif("__stem", F.lit("")).alias("stem"),
        F.when(_has_image(_col("type"), _col("img_path")), _file_name(_col("img_path"))).alias("img"),
    )
    at_start = _col("block_idx") == _col("start_idx")
    grouped = read.groupBy("doc_id", "start_idx", "question_number").agg(
        F.sort_array(F.collect_list(part)).alias("parts"),
        F.max(F.when(at_start, _col("__section"))).alias("section_label"),
        F.max(F.when(at_start, _col("page_idx"))).alias("source_page"),
    )
    cands = F.flatten(F.transform(
        F.filter("parts", lambda p: p["cands"].isNotNull()), lambda p: p["cands"]))

    def chosen(label: str) -> Column:
        return F.get(F.filter("cands", lambda c: c["label"] == label), F.lit(0))

    first = F.array_compact(F.array(*[chosen(x) for x in C.OPTION_LABELS]))
    stems = F.transform(F.filter("parts", lambda p: p["stem"].isNotNull()), lambda p: p["stem"])
    stepped = grouped.withColumns({"cands": cands, "stems": stems}).withColumn("first", first)
    number = _col("question_number").cast("string")

    def differs(c: Column) -> Column:
        return F.exists("first", lambda f: (f["label"] == c["label"]) & (f["value"] != c["value"]))

    conflicts = F.transform(F.filter("cands", differs), lambda c: F.concat(
        F.lit("Q"), number, F.lit(": conflicting option "), c["label"], F.lit(" from "), c["source"],
        F.lit("; kept first reading-order value")))
    head = X.strip_number(F.get("stems", F.lit(0)))
    joined = F.array_join(F.concat(F.array(head), F.filter("stems", lambda _, i: i > 0)), "\n")
    return stepped.select(
        "doc_id", "start_idx", "question_number", "section_label", "source_page",
        F.when(F.size("stems") > 0, F.nullif(X.py_strip(joined), F.lit(""))).alias("stem_md"),
        F.transform("first", lambda f: F.struct(f["label"].alias("label"), f["value"].alias("value")))
        .alias("options"),
        conflicts.alias("conflicts"),
        F.transform(F.filter("parts", lambda p: F.coalesce(p["img"] != "", F.lit(False))),
                    lambda p: p["img"]).alias("image_names"),
    )


def full_paper_groups(blocks: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """Question runs of the body as rows, before duplicates are settled."""
    kept = filter_noise(blocks)
    return _body_groups(kept, key_boundary(kept) if boundary is None else boundary)


def _body_groups(kept: DataFrame, boundary: DataFrame) -> DataFrame:
    """``full_paper_groups`` of blocks whose noise is filtered."""
    body = (kept.join(boundary.select("doc_id", "boundary_idx"), "doc_id", "left")
            .filter(_col("boundary_idx").isNull() | (_col("block_idx") < _col("boundary_idx")))
            .select(kept.columns))
    return _full_paper_groups(full_paper_runs(body))


def settle_duplicates(groups: DataFrame) -> DataFrame:
    """Per document and number the first buildable run, with the counts behind the choice.

    ``runs`` counts all starts of the number, ``built`` the buildable ones.
    """
    row = F.struct(*[c for c in groups.columns if c not in ("doc_id", "question_number")])
    picked = groups.groupBy("doc_id", "question_number").agg(
        F.min_by(row, F.when(_col("stem_md").isNotNull(), _col("start_idx"))).alias("q"),
        F.min("start_idx").alias("first_start"),
        F.count(F.lit(1)).alias("runs"),
        F.count("stem_md").alias("built"),
    ).filter(_col("built") > 0)
    return picked.select("doc_id", "question_number", "q.*", "first_start", "runs", "built")


class FullPaper(NamedTuple):
    """Blocks without noise, their ``key_boundary`` and ``full_paper_key``, each written once."""

    kept: DataFrame
    boundary: DataFrame
    key: DataFrame


def read_full_paper(blocks: DataFrame) -> FullPaper:
    """What the builder and the document's warnings both read, so that texts are filtered and searched once."""
    kept = cut_lineage(filter_noise(blocks))
    boundary = cut_lineage(key_boundary(kept))
    return FullPaper(kept, boundary, cut_lineage(full_paper_key(kept, boundary)))


def build_full_paper(blocks: DataFrame, files: DataFrame | None = None, paper: FullPaper | None = None) -> DataFrame:
    """Full papers. ``files (doc_id, filename)`` lists the images that exist; without it no
    image can be linked. ``paper`` is what was read of ``blocks`` already."""
    paper = paper or read_full_paper(blocks)
    questions = settle_duplicates(_body_groups(paper.kept, paper.boundary))
    return _with_key(questions, paper.key, files)


def _with_key(questions: DataFrame, key: DataFrame, files: DataFrame | None) -> DataFrame:
    """Settled questions with their answers, images and warnings."""
    joined = questions.join(key, ["doc_id", "question_number"], "left")
    joined = link_images(joined, files)
    number = F.concat(F.lit("Q"), _col("question_number").cast("string"))
    section = F.when(F.size("options") > 0, F.lit("mcq")).otherwise(F.lit("integer"))
    normal = X.normalize_key_answer(section, _col("raw_answer"))
    unknown = (section == "mcq") & ~normal.isin(C.OPTION_LABELS)
    partial = F.size("options").between(1, len(C.OPTION_LABELS) - 1)
    warnings = F.concat(
        F.array_compact(F.array(F.when(
            _col("start_idx") > _col("first_start"),
            F.concat(number, F.lit(": duplicate question start detected"))))),
        _col("conflicts"),
        F.array_compact(F.array(F.when(partial, F.concat(
            number, F.lit(": options_missing — recovered "), F.size("options").cast("string"),
            F.lit("/4 options (PDF OCR may have dropped the rest)"))))),
        F.transform("unlinked", lambda f: F.concat(
            number, F.lit(": MinerU image '"), f, F.lit("' could not be linked"))),
        F.array_compact(F.array(
            F.when(_col("raw_answer").isNull(), F.concat(number, F.lit(": answer not found in answer key"))),
            F.when(unknown, F.concat(number, F.lit(": unrecognised MCQ answer key value '"),
                                     _col("raw_answer"), F.lit("'"))))),
    )
    return joined.select(
        "doc_id", "start_idx", "question_number", "stem_md", "options",
        F.coalesce(normal, F.lit("")).alias("answer"), section.alias("section_type"),
        "section_label", "images", "source_page", F.lit(None).cast("string").alias("subject"),
        warnings.alias("warnings"))


def link_images(questions: DataFrame, files: DataFrame | None) -> DataFrame:
    """Turn ``image_names`` into ``images`` (present in ``files``) and ``unlinked``."""
    struct_type = "array<struct<filename:string,position:string>>"
    if files is None:
        return questions.withColumns({
            "images": F.array().cast(struct_type), "unlinked": _col("image_names")}).drop("image_names")
    questions = cut_lineage(questions)
    keys = ["doc_id", "start_idx"]
    listed = files.select("doc_id", "filename").distinct().withColumn("there", F.lit(True))
    names = questions.select(*keys, F.posexplode("image_names").alias("at", "filename"))
    found = names.join(listed, ["doc_id", "filename"], "left").groupBy(keys).agg(
        F.array_sort(F.collect_list(F.when(_col("there"), F.struct("at", "filename")))).alias("yes"),
        F.array_sort(F.collect_list(F.when(_col("there").isNull(), F.struct("at", "filename")))).alias("no"))
    linked = questions.join(found, keys, "left")
    images = F.transform("yes", lambda f: F.struct(
        f["filename"].alias("filename"), F.lit("stem").alias("position")))
    return linked.withColumns({
        "images": F.coalesce(images, F.array().cast(struct_type)),
        "unlinked": F.coalesce(F.transform("no", lambda f: f["filename"]), F.array().cast("array<string>")),
    }).drop("yes", "no", "image_names")


def document_warnings(blocks: DataFrame, questions: DataFrame, paper: FullPaper | None = None) -> DataFrame:
    """``(doc_id, warning)`` rows of full papers: no readable key, key entries without a question."""
    paper = paper or read_full_paper(blocks)
    return _document_warnings(paper.boundary, paper.key, questions)


def _document_warnings(boundary: DataFrame, key: DataFrame, questions: DataFrame) -> DataFrame:
    unreadable = boundary.filter(_col("boundary_idx").isNull() | _col("key_img_path").isNotNull()).select(
        "doc_id", F.lit("answer-key boundary not found in MinerU text; the answer-key page "
                        "may have been emitted as an image block").alias("warning"))
    orphans = orphan_key_entries(key, questions).select(
        "doc_id", F.concat(F.lit("answer key contains Q"), _col("question_number").cast("string"),
                           F.lit(" with no built question")).alias("warning"))
    return unreadable.unionByName(orphans)


def attach_document_warnings(questions: DataFrame, warnings: DataFrame) -> DataFrame:
    """Repeat document-level warnings on the first question of the document, in reading order.

    A missing key comes first, then the key's numbers without question in their order.
    """
    first = questions.groupBy("doc_id").agg(F.min("start_idx").alias("start_idx"))
    number = F.regexp_extract("warning", r"contains Q(\d+) with", 1).try_cast("long")
    entry = F.struct(number.alias("n"), "warning")
    extra = warnings.groupBy("doc_id").agg(F.transform(
        F.sort_array(F.collect_list(entry)), lambda w: w["warning"]).alias("__extra"))
    marked = first.join(extra, "doc_id")
    return (questions.join(marked, ["doc_id", "start_idx"], "left")
            .withColumn("warnings", F.concat("warnings", F.coalesce("__extra", F.array().cast("array<string>"))))
            .drop("__extra"))


def orphan_key_entries(key: DataFrame, questions: DataFrame) -> DataFrame:
    return key.join(questions.select("doc_id", "question_number"), ["doc_id", "question_number"], "left_anti")


# --- Reports ----------------------------------------------------------------------------------------

def missing_numbers(questions: DataFrame) -> DataFrame:
    """Numbers absent between the smallest and largest of a document; at most 999 exist."""
    spans = questions.groupBy("doc_id").agg(
        F.min("question_number").alias("lo"), F.max("question_number").alias("hi"),
        F.collect_set("question_number").alias("seen"))
    return spans.select("doc_id", F.array_sort(
        F.array_except(F.sequence("lo", "hi"), "seen")).alias("missing"))


def quality_report(questions: DataFrame) -> DataFrame:
    mcq = _col("section_type") == "mcq"
    counts = questions.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_extracted"),
        F.count_if(mcq).alias("mcq_count"),
        F.count_if(~mcq).alias("integer_count"),
        F.count_if(F.size("images") > 0).alias("with_diagram"),
        F.count_if(F.coalesce("answer", F.lit("")) == "").alias("no_answer"),
        F.count_if(F.size("options") == len(C.OPTION_LABELS)).alias("complete_options"))
    return counts.join(missing_numbers(questions), "doc_id")


def builder_report(blocks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The full-paper builder's report: a row per document of ``blocks``, also where no question was built.

    To the counts of ``quality_report`` come ``answer_key_size`` (numbers in the key), ``duplicate_question_numbers``
    (built more than once) and ``stage_warnings``: a missing key, then the key's numbers without question. The blocks
    are filtered once and every later step reads that table.
    """
    kept, boundary, key = read_full_paper(blocks)
    settled = cut_lineage(settle_duplicates(_body_groups(kept, boundary)))
    questions = cut_lineage(_with_key(settled, key, files))
    sizes = key.groupBy("doc_id").agg(F.count(F.lit(1)).alias("answer_key_size"))
    twice = settled.filter(_col("built") > 1).groupBy("doc_id").agg(
        F.array_sort(F.collect_set("question_number")).alias("duplicate_question_numbers"))
    number = F.regexp_extract("warning", r"contains Q(\d+) with", 1).try_cast("long")
    told = _document_warnings(boundary, key, questions).groupBy("doc_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct(number.alias("n"), "warning"))), lambda w: w["warning"]).alias("stage_warnings"))
    report = blocks.select("doc_id").distinct()
    for part in (quality_report(questions), sizes, twice, told):
        report = report.join(part, "doc_id", "left")
    counts = ["total_extracted", "mcq_count", "integer_count", "with_diagram", "no_answer", "complete_options", "answer_key_size"]
    lists = ["missing", "duplicate_question_numbers", "stage_warnings"]
    return report.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
                         *[F.coalesce(_col(c), F.array().cast(report.schema[c].dataType)).alias(c) for c in lists])


def processing_report(questions: DataFrame, stored: DataFrame, documents: DataFrame) -> DataFrame:
    """A row per document of ``documents (doc_id)``: what was detected, stored and linked.

    ``stored (doc_id, start_idx)`` names the questions that the bank took; the others count as skipped. As in the
    bank every stored question has its answer, ``answers_mapped`` equals ``questions_stored``. Rows per question are
    in ``question_report``, whose warnings are counted here.
    """
    keys = ["doc_id", "start_idx"]
    kept = stored.select(*keys).distinct().withColumn("__kept", F.lit(True))
    counts = document_report(questions)
    saved = questions.select(*keys).join(kept, keys, "left").groupBy("doc_id").agg(F.count("__kept").alias("questions_stored"))
    joined = (documents.select("doc_id").distinct().join(counts, "doc_id", "left").join(saved, "doc_id", "left")
              .na.fill(0, ["questions_detected", "questions_stored", "images_linked", "warning_count"]))
    return joined.select(
        "doc_id", "questions_detected", "questions_stored",
        (_col("questions_detected") - _col("questions_stored")).alias("questions_skipped"),
        _col("questions_stored").alias("answers_mapped"), "images_linked", "warning_count",
        F.coalesce("detected_subjects", F.array().cast("array<string>")).alias("detected_subjects"))


def number_order(questions: DataFrame, document: str = "doc_id", tie: str = "start_idx") -> DataFrame:
    """Adds ``ordinal``, the place of a question in its document by number; those without number come first.

    Equal numbers follow in the order of ``tie``, which must be unique in a document.
    """
    numbered = questions.withColumn("__number", F.coalesce(_col("question_number").cast("long"), F.lit(0)))
    return ordered_scan(numbered, [document], ["__number", tie], buckets=[_col("__number"), by_range(tie)],
                        position="ordinal").drop("__number")


def document_report(questions: DataFrame) -> DataFrame:
    """Scalars of a document's processing report; warnings stay rows, see ``question_report``."""
    return questions.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("questions_detected"),
        F.sum(F.size("images")).cast("long").alias("images_linked"),
        F.sum(F.size("warnings")).cast("long").alias("warning_count"),
        F.array_sort(F.collect_set(F.nullif("subject", F.lit("")))).alias("detected_subjects"))


def question_report(questions: DataFrame) -> DataFrame:
    return questions.select(
        "doc_id", _col("question_number").alias("number"), F.lit("ok").alias("status"), "warnings")


# --- Dispatch -------------------------------------------------------------------------------------------

Builder = Callable[[DataFrame, DataFrame | None], DataFrame]
BUILDERS: dict[str, Builder] = {
    "inline_answer": build_inline,
    "separate_answer_key": build_separate_key,
    "full_paper": build_full_paper,
}


def layout_errors(documents: DataFrame) -> DataFrame:
    """Documents ``(doc_id, layout_type)`` no builder takes, with the reason."""
    layout = _col("layout_type")
    reason = (F.when(layout.isNull() | (layout == ""), "ingestion.layout_type is not set")
              .when(layout == "with_solution", "layout 'with_solution' is not implemented")
              .when(~layout.isin(C.LAYOUTS), F.concat(
                  F.lit("Unknown layout_type: '"), layout, F.lit("'"))))
    return documents.withColumn("error", reason).filter(_col("error").isNotNull())


def with_layout(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Blocks of the documents ``(doc_id, layout_type)`` some builder takes, with their layout."""
    known = documents.filter(_col("layout_type").isin(list(BUILDERS))).select("doc_id", "layout_type")
    return blocks.join(known, "doc_id").select(*blocks.columns, "layout_type")


def build_questions(blocks: DataFrame, files: DataFrame | None = None,
                    builders: dict[str, Builder] | None = None) -> DataFrame:
    """Run every builder on the blocks of its ``layout_type`` and union the questions.

    A new layout is a function ``(blocks, files) -> questions`` added to ``builders``. Blocks
    stored by layout are read once per builder that uses them and skipped by the others.
    """
    columns = ["doc_id", "start_idx", "question_number", "stem_md", "options", "answer",
               "section_type", "section_label", "images", "source_page", "subject", "warnings"]
    parts = [
        build(blocks.filter(_col("layout_type") == name).drop("layout_type"), files)
        .select(*columns, F.lit(name).alias("layout_type"))
        for name, build in (builders or BUILDERS).items()]
    return reduce(DataFrame.unionByName, parts)
