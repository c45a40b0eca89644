"""Blueprint requests: normalisation and validation, all errors of a request as one array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlake import constants as C
from itemlake.functions import text as X
from itemlake.functions.names import normalize_exam_name, normalize_subject


def _given(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def normalize_requests(requests: DataFrame) -> DataFrame:
    """Canonical exam and subject; a mode whose chapter is missing becomes ``all``."""
    mode = F.coalesce("chapter_filter_mode", F.lit("all"))
    companion = F.lit("present")
    for name, field in C.MODE_FIELD.items():
        companion = F.when(mode == name, F.coalesce(F.lower(X.py_strip(F.col(field))), F.lit(""))).otherwise(companion)
    return requests.withColumns({
        "exam_name": F.coalesce(normalize_exam_name(F.col("exam_name")), "exam_name"),
        "subject": F.coalesce(normalize_subject(F.col("subject")), "subject"),
        "chapter_filter_mode": F.when(companion.isin(C.EMPTY_WORDS), F.lit("all")).otherwise(mode),
    })


def request_errors() -> Column:
    mode, count = F.col("chapter_filter_mode"), F.col("question_count")
    dist = F.col("difficulty_distribution")
    total = F.aggregate(dist, F.lit(0), lambda acc, d: acc + d["n"])
    bad_tiers = F.filter(dist, lambda d: ~d["tier"].isin(C.DIFFICULTIES))
    needs = {"exact": "chapter", "upto": "chapter_upto", "from": "chapter_from", "after": "chapter_after"}
    checks = [F.when(~mode.isin(C.CHAPTER_MODES), F.concat(F.lit("unknown chapter_filter_mode "), mode))]
    checks += [
        F.when((mode == m) & ~_given(f), F.lit(f"chapter_filter_mode='{m}' requires '{f}' field"))
        for m, f in needs.items()]
    checks += [
        F.when((mode == "between") & ~(_given("chapter_from") & _given("chapter_to")), F.lit(
            "chapter_filter_mode='between' requires both 'chapter_from' and 'chapter_to' fields")),
        F.when(~F.coalesce(count.between(C.MIN_QUESTIONS, C.MAX_QUESTIONS), F.lit(False)),
               F.lit("question_count must be between 1 and 200")),
        F.when(~F.col("difficulty").isin(C.DIFFICULTIES), F.concat(
            F.lit("difficulty must be 'easy', 'medium', or 'hard', got '"), F.col("difficulty"), F.lit("'"))),
        F.when(~F.col("section_type").isin(C.SECTION_TYPES), F.concat(
            F.lit("section_type must be 'mcq' or 'integer', got '"), F.col("section_type"), F.lit("'"))),
        F.when(dist.isNotNull() & (total != count), F.concat(
            F.lit("difficulty_distribution values sum to "), total.cast("string"),
            F.lit(" but question_count is "), count.cast("string"))),
        F.when(F.size(bad_tiers) > 0, F.concat(
            F.lit("difficulty_distribution key '"), F.get(bad_tiers, F.lit(0))["tier"],
            F.lit("' invalid — use 'easy', 'medium', 'hard'"))),
        F.when(_given("difficulty") & (F.size(dist) > 0), F.lit(
            "Provide either a single 'difficulty' filter OR a 'difficulty_distribution' breakdown, not both.")),
    ]
    return F.array_compact(F.array(*checks))


def validate_requests(requests: DataFrame) -> DataFrame:
    return requests.withColumn("errors", request_errors())


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid requests, and rejected ones with their ``errors``."""
    checked = validate_requests(requests)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)
