"""Ordered syllabus: flattening, listing, upsert, name resolution, chapter ranges.

A syllabus partition ``(exam_name, subject)`` is turned into one row with its ordered chapters
(``(exam, subject, order)`` is unique, a partition is a curriculum), so that a request is
resolved by one equi-join and array functions, without a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlake import constants as C
from itemlake.functions import text as X
from itemlake.functions.fuzzy import best_match
from itemlake.session import cut_lineage

PARTITION = ["exam_name", "subject"]


def flatten_seed(seed: DataFrame) -> DataFrame:
    """Nested ``(exam_name, subject, chapters)`` to rows with a 1-based ``chapter_order``."""
    return seed.select(
        *PARTITION, F.posexplode("chapters").alias("__at", "c"),
    ).select(*PARTITION, "c.chapter_name", (F.col("__at") + 1).alias("chapter_order"), "c.chapter_aliases")


def partition_counts(syllabus: DataFrame) -> DataFrame:
    return syllabus.groupBy(*PARTITION).agg(F.count(F.lit(1)).alias("chapter_count"))


def list_chapters(syllabus: DataFrame, exam_name: str, subject: str) -> DataFrame:
    return (syllabus.filter((F.col("exam_name") == exam_name) & (F.col("subject") == subject))
            .select("chapter_order", "chapter_name",
                    F.coalesce("chapter_aliases", F.array().cast("array<string>")).alias("chapter_aliases"))
            .orderBy("chapter_order"))


def upsert(syllabus: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace name and aliases at ``(exam, subject, order)``, insert what is new.

    Of several changes of one key the last by ``edit_seq`` counts, or the greatest name without that column.
    """
    keys = [*PARTITION, "chapter_order"]
    seq = ["edit_seq"] if "edit_seq" in changes.columns else []
    last = F.max(F.struct(*seq, "chapter_name", "chapter_aliases"))
    new = changes.groupBy(*keys).agg(last.alias("__c")).select(
        *keys, F.col("__c.chapter_name").alias("__name"), F.col("__c.chapter_aliases").alias("__aliases"),
        F.lit(True).alias("__new"))
    joined = syllabus.join(new, keys, "full_outer")
    replaced = F.col("__new").isNotNull()
    return joined.select(
        *keys,
        F.when(replaced, F.col("__name")).otherwise(F.col("chapter_name")).alias("chapter_name"),
        F.when(replaced, F.col("__aliases")).otherwise(F.col("chapter_aliases")).alias("chapter_aliases"),
        F.when(replaced & F.col("chapter_name").isNull(), "created")
        .when(replaced, "updated").otherwise("kept").alias("action"))


def uniqueness_violations(syllabus: DataFrame) -> DataFrame:
    """``(rule, exam_name, subject, key, n)`` where an order or a name repeats."""
    rules = F.explode(F.array(
        F.struct(F.lit("order").alias("rule"), F.col("chapter_order").cast("string").alias("key")),
        F.struct(F.lit("name").alias("rule"), F.col("chapter_name").alias("key")))).alias("r")
    return (syllabus.select(*PARTITION, rules).groupBy("r.rule", *PARTITION, "r.key")
            .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))


def partitions(syllabus: DataFrame) -> DataFrame:
    """One row per partition with ``chapters``: ordered structs of order, name, aliases."""
    chapter = F.struct(
        F.col("chapter_order").cast("int").alias("ord"), F.col("chapter_name").alias("name"),
        F.coalesce("chapter_aliases", F.array().cast("array<string>")).alias("aliases"))
    return syllabus.groupBy(*PARTITION).agg(F.array_sort(F.collect_list(chapter)).alias("chapters"))


# --- Name resolution ------------------------------------------------------------------

def exact_or_alias(chapters: Column, name: Column) -> Column:
    """``struct<ord,name,kind>`` of the first exact, else first alias match; NULL when none."""
    key = F.lower(X.py_strip(name))

    def hit(kind: str, test) -> Column:
        return F.get(F.transform(F.filter(chapters, test), lambda c: F.struct(
            c["ord"].alias("ord"), c["name"].alias("name"), F.lit(kind).alias("kind"),
            F.lit(None).cast("double").alias("score"))), F.lit(0))

    exact = hit("exact", lambda c: F.lower(c["name"]) == key)
    alias = hit("alias", lambda c: F.exists(c["aliases"], lambda a: F.lower(a) == key))
    return F.coalesce(exact, alias)


def _corpus(chapters: Column) -> tuple[Column, Column]:
    """Names and aliases in search order, and the position of their chapter; what is a chapter's name
    stands for that chapter, even where an alias of an earlier one is equal."""
    names = F.transform(chapters, lambda c: c["name"])
    entries = F.flatten(F.transform(chapters, lambda c, i: F.transform(
        F.concat(F.array(c["name"]), c["aliases"]),
        lambda n: F.struct(n.alias("n"), i.alias("i")))))
    named = F.transform(entries, lambda e: F.coalesce(
        F.nullif(F.array_position(names, e["n"]), F.lit(0)) - 1, e["i"]).cast("int"))
    return F.transform(entries, lambda e: e["n"]), named


def resolve_names(names: DataFrame, syllabus: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Resolve distinct ``(exam_name, subject, name)`` rows; adds ``hit`` (NULL when unknown).

    Fuzzy scoring runs once per distinct name that exact and alias matching leave open, over the
    chapters of its own partition.
    """
    joined = names.select(*PARTITION, "name").distinct().join(partitions(syllabus), PARTITION, "left")
    tried = joined.withColumn("hit", exact_or_alias(F.col("chapters"), F.col("name")))
    if not fuzzy:
        return tried.drop("chapters")
    corpus, owner = _corpus(F.col("chapters"))
    tried = cut_lineage(tried)
    settled = tried.filter(F.col("hit").isNotNull() | F.col("chapters").isNull()).drop("chapters")
    open_names = cut_lineage(tried.filter(F.col("hit").isNull() & F.col("chapters").isNotNull())
                             .withColumns({"__corpus": corpus, "__owner": owner}))
    scored = open_names.withColumn("__best", best_match(F.col("name"), F.col("__corpus")))
    chapter = F.get("chapters", F.get("__owner", F.col("__best.idx")))
    hit = F.when(F.col("__best.score") >= C.FUZZY_SCORE, F.struct(
        chapter["ord"].alias("ord"), chapter["name"].alias("name"), F.lit("fuzzy").alias("kind"),
        F.col("__best.score").alias("score")))
    return settled.unionByName(scored.select(*PARTITION, "name", hit.alias("hit")))


def match_warning(name: Column, hit: Column) -> Column:
    quoted = F.concat(F.lit("'"), name, F.lit("'"))
    target = F.concat(F.lit(" → '"), hit["name"], F.lit("'"))
    return (F.when(hit["kind"] == "alias", F.concat(F.lit("Matched "), quoted, F.lit(" via alias"), target))
            .when(hit["kind"] == "fuzzy", F.concat(
                F.lit("Fuzzy matched "), quoted, target, F.lit(" (score: "),
                hit["score"].cast("string"), F.lit(")"))))


# --- Requests ---------------------------------------------------------------------------

def boundary_names(requests: DataFrame) -> DataFrame:
    """Every chapter name a request needs resolved: ``(request_id, exam, subject, role, at, name)``."""
    mode = F.col("chapter_filter_mode")
    lower = F.when(mode == "exact", F.col("chapter")).when(mode == "upto", F.col("chapter_upto")).when(
        mode.isin("from", "between"), F.col("chapter_from")).when(mode == "after", F.col("chapter_after"))
    upper = F.when(mode == "between", F.col("chapter_to"))
    needed = F.concat(
        F.array(F.struct(F.lit("first").alias("role"), F.lit(0).alias("at"), lower.alias("name")),
                F.struct(F.lit("second").alias("role"), F.lit(0).alias("at"), upper.alias("name"))),
        F.transform(F.coalesce("exclude_chapters", F.array().cast("array<string>")), lambda n, i: F.struct(
            F.lit("exclude").alias("role"), i.alias("at"), n.alias("name"))))
    return (requests.select("request_id", *PARTITION, F.explode(needed).alias("n"))
            .select("request_id", *PARTITION, "n.*").filter(F.col("name").isNotNull()))


def resolve_requests(requests: DataFrame, syllabus: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Requests with concrete chapters.

    Adds ``resolved_chapters``, ``excluded_chapters``, ``range_description``,
    ``resolver_warnings`` and ``resolver_error`` (NULL when resolved). In mode ``all`` an empty
    chapter list is allowed and means no include filter.
    """
    needed = boundary_names(requests)
    hits = needed.join(resolve_names(needed, syllabus, fuzzy), [*PARTITION, "name"], "left")
    # A request names at most two boundaries and the exclusions of its own list.
    detail = F.struct("role", "at", "name", "hit")
    answers = hits.groupBy("request_id").agg(F.collect_list(detail).alias("hits"))
    joined = (requests.join(answers, "request_id", "left")
              .join(partitions(syllabus), PARTITION, "left")
              .withColumn("hits", F.coalesce("hits", F.array().cast(
                  "array<struct<role:string,at:int,name:string,"
                  "hit:struct<ord:int,name:string,kind:string,score:double>>>"))))

    def role(name: str) -> Column:
        return F.get(F.filter("hits", lambda h: h["role"] == name), F.lit(0))

    excluded = F.array_sort(F.filter("hits", lambda h: h["role"] == "exclude"))
    stepped = joined.withColumns({
        "__first": role("first"), "__second": role("second"),
        "__excluded": F.transform(
            excluded, lambda h: F.struct(h["at"].alias("at"), h["name"].alias("name"), h["hit"].alias("hit"))),
        "__total": F.size("chapters"),
    })
    mode, total = F.col("chapter_filter_mode"), F.col("__total")
    a, b = F.col("__first.hit"), F.col("__second.hit")
    lo = (F.when(mode == "all", F.lit(1 - 2**31)).when(mode.isin("exact", "from"), a["ord"])
          .when(mode == "upto", F.lit(1 - 2**31)).when(mode == "after", a["ord"] + 1)
          .when(mode == "between", F.least(a["ord"], b["ord"])))
    hi = (F.when(mode.isin("all", "from", "after"), F.lit(2**31 - 1))
          .when(mode.isin("exact", "upto"), a["ord"]).when(mode == "between", F.greatest(a["ord"], b["ord"])))
    ranged = stepped.withColumns({"__lo": lo, "__hi": hi})
    in_range = F.filter("chapters", lambda c: c["ord"].between(F.col("__lo"), F.col("__hi")))
    names = F.transform(in_range, lambda c: c["name"])
    out_names = F.transform("__excluded", lambda h: h["hit"]["name"])
    picked = ranged.withColumns({"__range": names, "excluded_chapters": out_names})
    resolved = F.filter("__range", lambda n: ~F.array_contains(
        F.array_compact("excluded_chapters"), n))

    def missing(*found: Column) -> Column:
        return F.get(F.transform(F.filter(F.concat(*found), lambda h: h["hit"].isNull()),
                                 lambda h: h["name"]), F.lit(0))

    boundary = missing(F.filter("hits", lambda h: h["role"] == "first"), F.filter("hits", lambda h: h["role"] == "second"))
    exclusion = missing(excluded)
    suggestions = F.array_join(F.transform(
        F.slice("chapters", 1, C.SUGGESTIONS),
        lambda c: F.concat(F.lit("'"), c["name"], F.lit("'"))), ", ")

    def not_found(name: Column) -> Column:
        return F.concat(
            F.lit("ChapterNotFound: Chapter '"), name, F.lit("' not found in "), F.col("exam_name"),
            F.lit(" "), F.col("subject"), F.lit(" syllabus. Did you mean one of: "), suggestions, F.lit("?"))

    # The range comes first, exclusions are looked up once it is known.
    error = (
        F.when(F.col("chapters").isNull(), F.concat(
            F.lit("SyllabusNotFound: No syllabus for "), F.col("exam_name"), F.lit(" / "), F.col("subject")))
        .when(boundary.isNotNull(), not_found(boundary))
        .when((mode == "after") & (F.size("__range") == 0), F.concat(
            F.lit("EmptyRange: 'after' mode on the last chapter '"), a["name"], F.lit("' (#"),
            a["ord"].cast("string"), F.lit(") produces no chapters.")))
        .when(exclusion.isNotNull(), not_found(exclusion))
        .when((mode != "all") & (F.size("resolved_chapters") == 0), F.concat(
            F.lit("EmptyRange: Chapter filter mode '"), mode, F.lit("' produced no chapters after applying "),
            F.size("excluded_chapters").cast("string"), F.lit(" exclusion(s)."))))

    def s(c: Column) -> Column:
        return c.cast("string")

    description = (
        F.when(mode == "all", F.concat(F.lit("All "), s(total), F.lit(" chapters")))
        .when(mode == "exact", F.concat(F.lit("Chapter "), s(a["ord"]), F.lit(" of "), s(total),
                                        F.lit(": '"), a["name"], F.lit("'")))
        .when(mode == "upto", F.concat(F.lit("Chapters 1–"), s(a["ord"]), F.lit(" of "), s(total),
                                       F.lit(" (up to '"), a["name"], F.lit("')")))
        .when(mode == "from", F.concat(F.lit("Chapters "), s(a["ord"]), F.lit("–"), s(total), F.lit(" of "),
                                       s(total), F.lit(" (from '"), a["name"], F.lit("')")))
        .when(mode == "after", F.concat(F.lit("Chapters "), s(a["ord"] + 1), F.lit("–"), s(total),
                                        F.lit(" of "), s(total), F.lit(" (after '"), a["name"],
                                        F.lit("', exclusive)")))
        .when(mode == "between", F.concat(F.lit("Chapters "), s(F.col("__lo")), F.lit("–"), s(F.col("__hi")),
                                          F.lit(" of "), s(total), F.lit(" ('"), a["name"], F.lit("' to '"),
                                          b["name"], F.lit("')"))))
    warnings = F.array_compact(F.concat(
        F.array(match_warning(F.col("__first.name"), a), match_warning(F.col("__second.name"), b)),
        F.transform("__excluded", lambda h: F.concat(F.lit("[exclude] "), match_warning(h["name"], h["hit"])))))
    done = picked.withColumn("resolved_chapters", resolved).withColumns({
        "range_description": description, "resolver_warnings": warnings, "resolver_error": error})
    return done.select(*requests.columns, "resolved_chapters", "excluded_chapters",
                       "range_description", "resolver_warnings", "resolver_error")


def canonical_chapters(questions: DataFrame, syllabus: DataFrame) -> DataFrame:
    """Opt-in: replace a chapter that is only an alias by the syllabus name."""
    alias = (syllabus.select(*PARTITION, "chapter_order", "chapter_name",
                             F.explode("chapter_aliases").alias("alias"))
             .groupBy(*PARTITION, F.lower("alias").alias("__key"))
             .agg(F.min_by("chapter_name", "chapter_order").alias("__name")))
    exact = syllabus.select(*PARTITION, F.lower("chapter_name").alias("__key"), F.col("chapter_name").alias("__exact"))
    keyed = questions.withColumn("__key", F.lower(X.py_strip(F.col("chapter"))))
    joined = (keyed.join(exact, [*PARTITION, "__key"], "left").join(alias, [*PARTITION, "__key"], "left"))
    return (joined.withColumn("chapter", F.coalesce("__exact", "__name", "chapter"))
            .select(questions.columns))
