"""The question bank: browsing, statistics, patches, lineage, deletes.

Questions carry at least ``id``, ``status`` and the columns an operator names.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlake import constants as C
from itemlake.functions import text as X


def active(questions: DataFrame) -> DataFrame:
    return questions.filter(F.col("status") == "active")


# --- Browsing ---------------------------------------------------------------------

def browse_predicate(
    *, subject: str | None = None, chapter: str | None = None, difficulty: str | None = None,
    exam_name: str | None = None, section_type: str | None = None, question_type: str | None = None,
    has_diagram: bool | None = None, has_formula: bool | None = None, status: str = "active",
    ingestion_id: object | None = None, search: str | None = None,
) -> Column:
    """All given filters together. An empty string counts as not given, ``False`` as given.

    ``%`` and ``_`` in ``search`` act as wildcards.
    """
    equal = {
        "subject": subject, "chapter": chapter, "difficulty": difficulty, "exam_name": exam_name,
        "section_type": section_type, "question_type": question_type, "ingestion_id": ingestion_id,
    }
    flags = {"has_diagram": has_diagram, "has_formula": has_formula}
    terms = [F.col("status") == status]
    terms += [F.col(k) == v for k, v in equal.items() if v not in (None, "")]
    terms += [F.col(k) == v for k, v in flags.items() if v is not None]
    if search:
        terms.append(F.col("raw_text").ilike(f"%{search}%"))
    return reduce(and_, terms)


def browse(questions: DataFrame, **filters: object) -> DataFrame:
    return questions.filter(browse_predicate(**filters))


def newest_page(rows: DataFrame, skip: int = 0, limit: int = 20, *, stamp: str = "created_at",
                key: str = "id") -> DataFrame:
    """Newest first with ``key`` as tie-break; a top-k, so no full sort. A page has at most 500 rows."""
    if limit > C.PAGE_LIMIT:
        raise ValueError(f"limit must be at most {C.PAGE_LIMIT}, got {limit}")
    return rows.orderBy(F.desc(stamp), F.asc(key)).offset(skip).limit(limit)


def by_status(rows: DataFrame, status: str | None) -> DataFrame:
    return rows.filter(F.col("status") == status) if status else rows


# --- Statistics ---------------------------------------------------------------------

def bank_statistics(questions: DataFrame) -> DataFrame:
    """``(facet, value, n)``: total and counts per subject, difficulty, chapter, section type.

    One scan; all facets are aggregated together before the shuffle. Missing and empty values
    are left out, except for section type.
    """
    facets = ["subject", "difficulty", "chapter", "section_type"]
    long = active(questions).select(F.explode(F.array(
        F.struct(F.lit("total").alias("facet"), F.lit(None).cast("string").alias("value")),
        *[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in facets],
    )).alias("f")).select("f.*")
    kept = F.col("facet").isin("total", "section_type") | (F.coalesce("value", F.lit("")) != "")
    return long.filter(kept).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def missing_fields() -> Column:
    """Labels of the metadata fields that are NULL or empty."""
    labels = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(label))
              for label, c in C.REVIEW_FIELDS]
    return F.array_compact(F.array(*labels))


def incomplete_metadata(questions: DataFrame) -> DataFrame:
    """Questions with missing metadata and the labels of what is missing."""
    return (questions.select("id", missing_fields().alias("missing"))
            .filter(F.size("missing") > 0))


def missing_by_subject(questions: DataFrame) -> DataFrame:
    counts = [F.count_if(F.coalesce(F.col(c), F.lit("")) == "").alias(f"missing_{c}")
              for _, c in C.REVIEW_FIELDS if c != "subject"]
    return questions.groupBy("subject").agg(*counts)


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def subject_totals(questions: DataFrame) -> DataFrame:
    subject = F.coalesce("subject", F.lit("unknown")).alias("subject")
    return questions.groupBy(subject).agg(F.count(F.lit(1)).alias("n"))


def ingestion_counts(ingestions: DataFrame, questions: DataFrame) -> DataFrame:
    """Question count per ingestion, 0 included. Questions are counted before the join."""
    counts = questions.groupBy("ingestion_id").agg(F.count(F.lit(1)).alias("n"))
    return (ingestions.join(counts, ingestions["id"] == counts["ingestion_id"], "left")
            .select(ingestions["id"], "status", F.coalesce("n", F.lit(0)).alias("n")))


# --- Edits ---------------------------------------------------------------------------------

def patch_metadata(questions: DataFrame, patches: DataFrame) -> DataFrame:
    """Overwrite the fields named in ``set_fields``; a named NULL overwrites too.

    ``patches``: ``id``, ``set_fields`` and the patchable columns it uses. Where several patches of a
    question name a field, the last by ``edit_seq`` counts, or the greatest value without that column.
    """
    fields = [f for f in C.PATCH_FIELDS if f in patches.columns and f in questions.columns]
    if not fields:
        return questions
    seq = ["edit_seq"] if "edit_seq" in patches.columns else []
    last = {f: F.max(F.when(F.array_contains("set_fields", f), F.struct(*seq, F.col(f).alias("v")))) for f in fields}
    settled = patches.groupBy("id").agg(*[c.alias(f"__p_{f}") for f, c in last.items()])
    joined = questions.join(settled, "id", "left")
    patched = {f: F.when(F.col(f"__p_{f}").isNotNull(), F.col(f"__p_{f}.v")).otherwise(F.col(f)) for f in fields}
    return joined.withColumns(patched).select(questions.columns)


def split_status_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid changes and rejects ``(id, new_status, reason)``."""
    valid = F.coalesce(F.col("new_status").isin(C.QUESTION_STATUSES), F.lit(False))
    reason = F.lit("Status must be: active, archived, or flagged.")
    return changes.filter(valid), changes.filter(~valid).withColumn("reason", reason)


def change_status(questions: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply the valid status changes; of several for one ``id`` the last by ``edit_seq``, or the greatest
    status without that column."""
    valid, _ = split_status_changes(changes)
    seq = ["edit_seq"] if "edit_seq" in changes.columns else []
    last = F.max(F.struct(*seq, "new_status"))["new_status"]
    joined = questions.join(valid.groupBy("id").agg(last.alias("new_status")), "id", "left")
    return joined.withColumn("status", F.coalesce("new_status", "status")).select(questions.columns)


# --- Lineage -----------------------------------------------------------------------------------

def variant_counts(questions: DataFrame) -> DataFrame:
    """Parents that exist with their number of variants; counted before the join."""
    counts = (questions.filter(F.col("parent_question_id").isNotNull())
              .groupBy(F.col("parent_question_id").alias("id")).agg(F.count(F.lit(1)).alias("variants")))
    return questions.select("id").join(counts, "id")


def save_variants(drafts: DataFrame, questions: DataFrame) -> DataFrame:
    """Accepted drafts ``(parent_id, stem_md, options, answer)`` as bank rows.

    Metadata is taken over from the parent; page, number, images and diagram are reset and the
    formula flag is computed anew. ``raw_text`` stays NULL, so text search does not find them.
    """
    own = {"stem_md", "options", "answer"}
    inherited = [c for c in questions.columns if c not in own | {"id"}]
    parents = questions.select(F.col("id").alias("parent_id"), *inherited)
    joined = drafts.join(parents, "parent_id")
    values = {
        "source_page": F.lit(None).cast("int"), "question_number": F.lit(None).cast("int"),
        "images": F.array().cast("array<struct<filename:string,position:string>>"),
        "has_diagram": F.lit(False), "has_formula": X.has_formula_marker(F.col("stem_md")),
        "generation_type": F.lit("ai_regenerated"), "parent_question_id": F.col("parent_id"),
        "status": F.lit("active"), "raw_text": F.lit(None).cast("string"),
        "llm_raw_response": F.lit(None).cast("string"),
    }
    return joined.withColumns(values).drop("parent_id", "created_at")


# --- Deletes --------------------------------------------------------------------------------------

def deletable(requested: DataFrame, paper_questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requested ids no paper uses, and the blocked rest. Only ids are shuffled."""
    used = paper_questions.select(F.col("question_id").alias("id")).distinct()
    wanted = requested.select("id").distinct()
    return wanted.join(used, "id", "left_anti"), wanted.join(used, "id", "left_semi")


def delete_questions(questions: DataFrame, requested: DataFrame, paper_questions: DataFrame) -> DataFrame:
    """Bank without the deletable ids; variants of deleted questions lose their parent link."""
    gone, _ = deletable(requested, paper_questions)
    kept = questions.join(gone, "id", "left_anti")
    if "parent_question_id" not in questions.columns:
        return kept
    lost = gone.select(F.col("id").alias("parent_question_id"), F.lit(True).alias("__lost"))
    return (kept.join(lost, "parent_question_id", "left")
            .withColumn("parent_question_id", F.when(F.col("__lost").isNull(), F.col("parent_question_id")))
            .select(questions.columns))


def delete_ingestions(ingestions: DataFrame, questions: DataFrame, paper_questions: DataFrame,
                      requested: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remaining ingestions and questions, and the blocked ingestions.

    Questions go with their ingestion; an ingestion is blocked whole while any of its
    questions is used in a paper.
    """
    wanted = requested.select("id").distinct()
    owned = questions.select("ingestion_id", F.col("id").alias("question_id")).join(
        wanted.withColumnRenamed("id", "ingestion_id"), "ingestion_id", "left_semi")
    used = paper_questions.select("question_id").distinct()
    blocked = (owned.join(used, "question_id", "left_semi")
               .select(F.col("ingestion_id").alias("id")).distinct())
    gone = wanted.join(blocked, "id", "left_anti")
    by_ingestion = gone.withColumnRenamed("id", "ingestion_id")
    doomed = questions.select("id", "ingestion_id").join(by_ingestion, "ingestion_id", "left_semi")
    kept = questions.join(by_ingestion, "ingestion_id", "left_anti").select(questions.columns)
    if "parent_question_id" in questions.columns:
        lost = doomed.select(F.col("id").alias("parent_question_id"), F.lit(True).alias("__lost"))
        kept = (kept.join(lost, "parent_question_id", "left")
                .withColumn("parent_question_id",
                            F.when(F.col("__lost").isNull(), F.col("parent_question_id")))
                .select(questions.columns))
    return ingestions.join(gone, "id", "left_anti"), kept, blocked


# --- Assembly ----------------------------------------------------------------------------------------

def with_metadata(questions: DataFrame, metadata: DataFrame) -> DataFrame:
    """Join by document and the block where a question starts; numbers may repeat in a document."""
    return questions.join(metadata.drop("question_number"), ["doc_id", "start_idx"], "left")


def question_id() -> Column:
    """Stable id of a built question: the same document gives the same ids whenever it is read."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ("doc_id", "start_idx")]))


def bank_rows(questions: DataFrame, metadata: DataFrame, ingestions: DataFrame,
              created_at: Column | None = None) -> DataFrame:
    """Bank rows from built questions, normalised metadata and their ingestion record.

    ``options`` of the input is an array of label and value; the bank stores a map. One row per
    question of a known ingestion; ``metadata`` has at most one row per question.
    """
    source = ingestions.select(
        F.col("id").alias("doc_id"), F.col("filename").alias("source_pdf"), "exam_name",
        F.col("subject").alias("__given"))
    meta = metadata.select(
        "doc_id", "start_idx", "chapter", "topic", "subtopic", "difficulty", "question_type", "concepts", "has_formula", "has_diagram", "meta_subject", "llm_raw_response")
    joined = with_metadata(questions.drop("subject"), meta).join(source, "doc_id")
    values = F.array_join(F.transform("options", lambda o: o["value"]), " ")
    return joined.select(
        question_id().alias("id"), (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
        F.col("doc_id").alias("ingestion_id"), "source_pdf", "source_page", "question_number",
        "stem_md", X.as_map(F.col("options")).alias("options"), "answer", "images", "section_type",
        "section_label", "exam_name", F.coalesce("meta_subject", "__given").alias("subject"),
        "chapter", "topic", "subtopic", "difficulty", "question_type",
        F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"),
        F.coalesce("has_diagram", F.lit(False)).alias("has_diagram"),
        F.coalesce("has_formula", F.lit(False)).alias("has_formula"),
        "llm_raw_response",
        X.strip_latex_for_search(F.concat(F.col("stem_md"), F.lit(" "), values)).alias("raw_text"),
        F.lit("active").alias("status"), F.lit("ingested").alias("generation_type"),
        F.lit(None).cast("string").alias("parent_question_id"), "warnings")
