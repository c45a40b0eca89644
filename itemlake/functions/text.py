"""Block and question text as native column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemlake import constants as C


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of ``key`` in a literal map, NULL when absent or when the key is NULL."""
    return F.try_element_at(literal_map(mapping), key)


def group1(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, NULL when the pattern does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: All characters with the Unicode property White_Space.
WHITE_SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def py_strip(text: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def matches_any(text: Column, patterns: list[str]) -> Column:
    """Whether some pattern is found, with ``text`` computed and searched once."""
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def _clean(text: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)


# --- Search text -------------------------------------------------------------------

def strip_latex_for_search(text: Column) -> Column:
    return py_strip(_clean(
        text,
        (r"(?s)\$\$.*?\$\$", " "),
        (r"\$[^$]+\$", " "),
        (r"\\[a-zA-Z]+\{[^}]*\}", " "),
        (r"\\[a-zA-Z]+", " "),
        (r"[{}\\^_]", " "),
        (r"(?U)\s+", " "),
    ))


def options_text(options: Column) -> Column:
    """Option values in label order, joined by blanks. Map order is never relied on."""
    entries = F.array_sort(F.map_entries(options))
    return F.array_join(F.transform(entries, lambda e: e["value"]), " ")


def options_prompt_text(options: Column) -> Column:
    entries = F.array_sort(F.map_entries(options))
    lines = F.array_join(
        F.transform(entries, lambda e: F.concat(F.lit("("), e["key"], F.lit(") "), e["value"])),
        "\n",
    )
    return F.when(F.coalesce(F.size(options), F.lit(0)) > 0, lines).otherwise(
        F.lit("(No options — integer/numerical type)"))


def stem_preview(raw_text: Column, stem_md: Column, length: int = C.PREVIEW_LENGTH) -> Column:
    source = F.coalesce(F.when(raw_text != "", raw_text), stem_md, F.lit(""))
    plain = py_strip(_clean(source, (r"(?s)\$\$?.*?\$\$?", "[formula]"), (r"(?U)\s+", " ")))
    return F.concat(
        F.rtrim(F.substring(plain, 1, length)),
        F.when(F.length(plain) > length, F.lit("…")).otherwise(F.lit("")),
    )


def print_math(text: Column) -> Column:
    return _clean(text, (r"(?s)\$\$(.*?)\$\$", r"\\($1\\)"), (r"(?s)\$(.*?)\$", r"\\($1\\)"))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, C.HTML_TAG, " ")


def error_text(text: Column) -> Column:
    return F.left(text, F.lit(C.ERROR_LENGTH))


def has_formula_marker(text: Column) -> Column:
    return reduce(or_, [F.contains(text, F.lit(m)) for m in C.FORMULA_MARKERS])


def formula_count(text: Column) -> Column:
    display = F.regexp_count(text, F.lit(r"\$\$[\s\S]+?\$\$"))
    inline = F.regexp_count(text, F.lit(r"(?<!\$)\$(?!\$)[^$]+\$(?!\$)"))
    return display + inline


def table_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(\|[^\n]+\|[\r\n]+)+"))


def wrap_bare_latex(text: Column) -> Column:
    """Put ``$`` around bare commands outside math; text with an odd ``$`` count is kept."""
    pieces = F.transform(
        F.split(text, r"\$"),
        lambda part, i: F.when(i % 2 == 1, part).otherwise(
            F.regexp_replace(part, C.BARE_LATEX, r"\$$1\$")),
    )
    balanced = F.regexp_count(text, F.lit(r"\$")) % 2 == 0
    return F.when(balanced & F.contains(text, F.lit("\\")), F.array_join(pieces, "$")).otherwise(text)


# --- Option parsing ------------------------------------------------------------------

def letter(label: Column) -> Column:
    return F.coalesce(lookup(C.LABEL_TO_LETTER, label), F.upper(label))


def marked_options(text: Column) -> Column:
    """``(1) foo (2) bar`` as ``array<struct<label,value>>`` in text order, repeats included.

    A value starts three characters after the start of its marker, as in ``(1)``; a marker
    written with inner blanks therefore leaves its tail in the value.
    """
    def pairs(t: Column) -> Column:
        markers = F.regexp_extract_all(t, F.lit(C.OPTION_MARKER), F.lit(0))
        pieces = F.filter(F.split(t, C.OPTION_MARKER), lambda _, i: i > 0)
        return F.transform(
            F.arrays_zip(markers.alias("m"), pieces.alias("p")),
            lambda z: F.struct(
                letter(F.regexp_extract(z["m"], r"\w", 0)).alias("label"),
                py_strip(F.concat(F.substring(z["m"], F.lit(4), F.length(z["m"])), z["p"])).alias("value"),
            ),
        )

    return let(text, pairs)


def last_per_label(options: Column) -> Column:
    """At most one entry per label, the last in text order; labels outside A-D cannot occur."""
    def labelled(name: str):
        return lambda o: o["label"] == name

    return let(options, lambda found: F.array_compact(F.array(*[
        F.try_element_at(F.filter(found, labelled(name)), F.lit(-1)) for name in C.OPTION_LABELS
    ])))


def split_options(text: Column) -> Column:
    """Options of a text holding at least two markers; otherwise an empty array."""
    return let(marked_options(text), lambda found: F.when(
        F.size(found) >= 2, last_per_label(found)).otherwise(F.slice(found, 1, 0)))


def inline_options(text: Column) -> Column:
    """Options of a text holding any marker, empty values dropped."""
    return last_per_label(F.filter(marked_options(text), lambda o: o["value"] != ""))


def as_map(options: Column) -> Column:
    return F.map_from_entries(options)


def _unframe(text: Column) -> Column:
    return _clean(F.replace(text, F.lit("$$"), F.lit(" ")), (C.ARRAY_BEGIN, " "), (C.ARRAY_END, " "))


def latex_array_options(text: Column) -> Column:
    """Options laid out as a LaTeX array, with or without the opening parenthesis."""
    inner = _clean(
        F.replace(F.replace(_unframe(text), F.lit("\\\\"), F.lit(" ")), F.lit("&"), F.lit(" ")),
        (r"(?U)\{\s*\{", " "), (r"(?U)\}\s*\}", " "),
    )

    def parse(t: Column) -> Column:
        loose = split_options(F.regexp_replace(t, r"(?U)(?<!\()([1-4])\)\s", r"($1) "))
        return let(split_options(t), lambda direct: F.when(F.size(direct) > 0, direct).otherwise(loose))

    return let(F.when(F.contains(text, F.lit("\\begin")), inner).otherwise(F.lit("")), parse)


def equation_options(text: Column) -> Column:
    """Options in the cells of an equation array; fewer than two cells count as none."""
    cells = F.transform(
        F.split(F.when(F.contains(text, F.lit("\\begin")), _unframe(text)).otherwise(F.lit("")), C.ARRAY_CELL_BREAK),
        lambda cell: F.struct(
            letter(F.regexp_extract(cell, C.CELL_OPTION, 1)).alias("label"),
            py_strip(F.regexp_extract(cell, C.CELL_OPTION, 2)).alias("value"),
        ),
    )
    return let(last_per_label(F.filter(cells, lambda c: c["value"] != "")), lambda found: F.when(
        F.size(found) >= 2, found).otherwise(F.slice(found, 1, 0)))


def embedded_array_options(text: Column) -> Column:
    """Options of a text block that opens with ``( $\\begin`` ."""
    inside = F.concat(F.lit("$$"), F.regexp_extract(text, r"(?s)\$(.*)\$", 1), F.lit("$$"))
    return equation_options(F.when(py_strip(text).rlike(C.EMBEDDED_ARRAY), inside).otherwise(F.lit("")))


def is_merged_marker(text: Column) -> Column:
    return text.rlike(C.MERGED_MARKER)


def merged_marker_options(text: Column) -> Column:
    """``(13) $a$ $b$`` gives A and C, ``(24)`` gives B and D; empty when it cannot be split.

    NULL when the text is no merged marker.
    """
    pair = F.regexp_extract(text, C.MERGED_MARKER, 1)
    first = F.when(pair == "13", F.lit("A")).otherwise(F.lit("B"))
    second = F.when(pair == "13", F.lit("C")).otherwise(F.lit("D"))

    def two(values: Column) -> Column:
        return F.array(
            F.struct(first.alias("label"), F.get(values, F.lit(0)).alias("value")),
            F.struct(second.alias("label"), F.get(values, F.lit(1)).alias("value")),
        )

    def values_of(rest: Column) -> Column:
        math = F.regexp_extract_all(rest, F.lit(r"\$[^$]+\$"), F.lit(0))
        parts = F.filter(F.transform(F.split(rest, r"(?U)\s{2,}|\n", 2), py_strip), lambda x: x != "")
        return let(math, lambda m: F.when(F.size(m) >= 2, m).otherwise(parts))

    values = let(py_strip(F.regexp_extract(text, C.MERGED_MARKER, 2)), values_of)
    split = let(values, lambda found: F.when(F.size(found) >= 2, two(found)).otherwise(F.slice(two(found), 1, 0)))
    return F.when(is_merged_marker(text), split)


def stem_fragment(text: Column) -> Column:
    """Text before the first option marker, or all of it."""
    return py_strip(F.get(F.split(text, C.OPTION_MARKER, 2), F.lit(0)))


def missing_labels(options: Column) -> Column:
    expected = F.array(*[F.lit(x) for x in C.OPTION_LABELS])
    return F.array_except(expected, F.map_keys(options))


# --- Questions and answers ---------------------------------------------------------------

def is_text(kind: Column) -> Column:
    return F.coalesce(kind == "text", F.lit(False))


#: All decimal digits beyond ASCII, by their Unicode property, and the ASCII digits of equal value.
_DIGITS = [chr(c) for c in range(0x80, 0x110000) if unicodedata.decimal(chr(c), None) is not None]
_VALUES = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def as_int(digits: Column) -> Column:
    """Number written in any script's digits; NULL where it does not fit."""
    return F.translate(digits, "".join(_DIGITS), _VALUES).try_cast("int")


def start_number(kind: Column, text: Column) -> Column:
    """Number of an inline-layout question start, else NULL."""
    return as_int(F.when(is_text(kind), group1(py_strip(text), C.QUESTION_START)))


def question_number(text: Column) -> Column:
    """Number of a full-paper question start, ``Q1.`` before ``1. text``, else NULL."""
    return as_int(F.coalesce(group1(text, C.Q_PREFIX), group1(text, C.PLAIN_NUMBER_START)))


def strip_number(text: Column) -> Column:
    by_prefix = py_strip(F.regexp_replace(text, C.Q_PREFIX, ""))
    return F.when(by_prefix != py_strip(text), by_prefix).otherwise(
        py_strip(F.regexp_replace(text, C.PLAIN_NUMBER_PREFIX, "")))


def is_answer(kind: Column, text: Column) -> Column:
    return is_text(kind) & F.coalesce(text.rlike(C.ANSWER_LINE), F.lit(False))


def extract_answer(text: Column) -> Column:
    return letter(group1(text, C.ANSWER_LINE))


def normalize_key_answer(section_type: Column, raw: Column) -> Column:
    """Multiple-choice key values become letters, anything else upper case; numbers stay."""
    value = py_strip(raw)
    return F.when(section_type == "mcq", letter(value)).otherwise(value)


def key_entries(text: Column, pattern: str = C.KEY_ENTRY) -> Column:
    """``array<struct<number,answer>>`` of the key entries of a text, in text order."""
    numbers = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    answers = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.transform(
        F.arrays_zip(numbers.alias("n"), answers.alias("a")),
        lambda z: F.struct(as_int(z["n"]).alias("number"), py_strip(z["a"]).alias("answer")),
    )


def is_key_header(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(C.KEY_HEADER), F.lit(False))


def block_body(text: Column, html: Column) -> Column:
    """Tag-free content of a text or table block."""
    return strip_tags(F.coalesce(F.when(text != "", text), html, F.lit("")))


# --- Noise -----------------------------------------------------------------------------------

def normalize_text(text: Column) -> Column:
    return py_strip(_clean(py_strip(text), (C.INLINE_WATERMARK, " "), (r" {2,}", " ")))


def is_noise(text: Column) -> Column:
    t = py_strip(F.coalesce(text, F.lit("")))
    watermark = matches_any(t, C.WATERMARKS)
    header = matches_any(t, C.PAGE_HEADERS)
    return (
        (F.length(t) < C.MIN_TEXT_LENGTH)
        | t.rlike(r"(?U)^\d{1,4}$")
        | watermark
        | ((F.length(t) < C.SHORT_HEADER_LENGTH) & header & question_number(t).isNull())
    )


def is_blank(text: Column) -> Column:
    return py_strip(F.coalesce(text, F.lit(""))) == ""


def is_garbled(text: Column) -> Column:
    foreign = F.regexp_count(text, F.lit(r"[^\x00-\x7F]"))
    garbled = foreign / F.greatest(F.length(text), F.lit(1)) > C.GARBLED_RATIO
    return F.when(F.octet_length(text) == F.length(text), F.lit(False)).otherwise(garbled)  # all ASCII


def is_banner(text: Column, text_level: Column) -> Column:
    hit = reduce(or_, [F.contains(text, F.lit(b)) for b in C.BANNER_TEXTS])
    return (F.coalesce(text_level, F.lit(0)) != 0) & hit


def has_ad(text: Column) -> Column:
    return matches_any(F.lower(text), [rf"\Q{k.lower()}\E" for k in C.AD_KEYWORDS])


# --- Headers of inline papers -------------------------------------------------------------------

def header_subject(text: Column) -> Column:
    up = F.upper(text)
    return reduce(lambda acc, kv: acc.when(F.contains(up, F.lit(kv[0])), F.lit(kv[1])),
                  C.HEADER_SUBJECTS[1:],
                  F.when(F.contains(up, F.lit(C.HEADER_SUBJECTS[0][0])), F.lit(C.HEADER_SUBJECTS[0][1])))


def section_label(text: Column, pattern: str) -> Column:
    return F.concat(F.lit("SECTION-"), F.upper(group1(text, pattern)))


def base_name(path: Column) -> Column:
    """Last path component, as a file listing names it."""
    return F.regexp_extract(F.regexp_replace(path, r"/+$", ""), r"([^/]*)$", 1)


def looks_like_question(text: Column) -> Column:
    t = py_strip(text)
    return t.rlike(C.LONG_NUMBERED_LINE) | t.rlike(C.TWO_OPTIONS_LINE)
