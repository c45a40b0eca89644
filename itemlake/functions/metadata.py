"""Model responses: JSON recovery and field normalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemlake import constants as C
from itemlake.functions.text import group1, lookup, py_strip


def response_body(text: Column) -> Column:
    """The outermost braces of a response, with a code fence removed first."""
    trimmed = py_strip(text)
    inner = F.coalesce(group1(trimmed, C.JSON_FENCE), trimmed)
    return F.coalesce(group1(inner, C.JSON_BRACES, 0), inner)


def repair_escapes(text: Column) -> Column:
    """Double the backslash of anything that is LaTeX rather than a JSON escape."""
    return F.regexp_replace(text, C.JSON_BAD_ESCAPE, r"$1\\\\$2")


def recover_json(text: Column) -> Column:
    """Response as a variant: repaired text first, then the text as it is, else NULL."""
    body = response_body(text)
    return F.coalesce(F.try_parse_json(repair_escapes(body)), F.try_parse_json(body))


def text_field(parsed: Column, name: str) -> Column:
    value = py_strip(F.try_variant_get(parsed, f"$.{name}", "string"))
    return F.when(~F.lower(value).isin(C.EMPTY_WORDS), value)


def flag_field(parsed: Column, name: str) -> Column:
    value = F.lower(F.try_variant_get(parsed, f"$.{name}", "string"))
    return F.coalesce(value.isin(C.TRUE_WORDS), F.lit(False))


def list_field(parsed: Column, name: str) -> Column:
    value = F.try_variant_get(parsed, f"$.{name}", "array<string>")
    return F.coalesce(
        F.filter(value, lambda x: F.coalesce(x != "", F.lit(False))),
        F.array().cast("array<string>"),
    )


def chapter_name(chapter: Column) -> Column:
    return F.coalesce(lookup(C.CHAPTER_ALIASES, chapter), chapter)


def subject_name(raw: Column) -> Column:
    key = F.lower(raw)
    first, *rest = C.SUBJECT_MARKERS
    chain = reduce(lambda acc, kv: acc.when(F.contains(key, F.lit(kv[0])), F.lit(kv[1])), rest,
                   F.when(F.contains(key, F.lit(first[0])), F.lit(first[1])))
    return chain.otherwise(key)


def metadata_columns(parsed: Column, image_count: Column) -> dict[str, Column]:
    """Normalised metadata of a recovered response, by column name."""
    return {
        "chapter": chapter_name(text_field(parsed, "chapter")),
        "topic": text_field(parsed, "topic"),
        "subtopic": text_field(parsed, "subtopic"),
        "difficulty": text_field(parsed, "difficulty"),
        "question_type": text_field(parsed, "question_type"),
        "concepts": list_field(parsed, "concepts"),
        "has_formula": flag_field(parsed, "has_formula"),
        "has_diagram": flag_field(parsed, "has_diagram") | (image_count > 0),
        "meta_subject": subject_name(text_field(parsed, "subject")),
    }
