"""Canonical exam and subject names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemlake import constants as C
from itemlake.functions.text import literal_map, lookup, py_strip


def normalize_exam_name(raw: Column) -> Column:
    """Alias, else the longest leading run of words that is an alias, else the trimmed name."""
    trimmed = py_strip(raw)
    words = F.split(F.lower(trimmed), r"(?U)\s+")
    aliases = literal_map(C.EXAM_ALIASES)
    prefixes = F.transform(
        F.sequence(F.size(words), F.lit(1), F.lit(-1)),
        lambda n: F.try_element_at(aliases, F.array_join(F.slice(words, F.lit(1), n), " ")),
    )
    by_prefix = F.get(F.array_compact(prefixes), F.lit(0))
    direct = lookup(C.EXAM_ALIASES, F.lower(trimmed))
    return F.when(trimmed != "", F.coalesce(direct, by_prefix, trimmed))


def normalize_subject(raw: Column) -> Column:
    """Alias, else the trimmed lower-case name; an empty string becomes NULL."""
    key = F.lower(py_strip(raw))
    return F.when(raw != "", F.coalesce(lookup(C.SUBJECT_ALIASES, key), key))


def subjects_for_exam(exam: Column) -> Column:
    table = F.create_map(*[
        x for name, subjects in C.EXAM_SUBJECTS.items()
        for x in (F.lit(name), F.array(*[F.lit(s) for s in subjects]))
    ])
    everything = F.array(*[F.lit(s) for s in C.ALL_SUBJECTS])
    return F.coalesce(F.try_element_at(table, exam), everything)


def subject_allowed(exam: Column, subject: Column) -> Column:
    return F.array_contains(subjects_for_exam(exam), subject)
