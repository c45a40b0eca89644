"""Requests to draft papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlake.operators import papers
from itemlake.operators import requests as R
from itemlake.operators import select as S
from itemlake.operators import syllabus as Y
from itemlake.session import cut_lineage, dealt


def judge_requests(requests: DataFrame, syllabus: DataFrame, fuzzy: bool = True) -> tuple[DataFrame, DataFrame]:
    """Valid requests with their chapters or ``resolver_error``, and rejected ones with ``errors``.

    Requests are few next to questions, and every later step comes back to them, so each stage
    is written once. Few files hold them, so they are dealt to all tasks first.
    """
    checked = cut_lineage(R.validate_requests(R.normalize_requests(dealt(requests))))
    valid, rejected = checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)
    return cut_lineage(Y.resolve_requests(valid, syllabus, fuzzy)), rejected


def resolve(requests: DataFrame, syllabus: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Normalised, valid and resolved requests; the others are told by ``request_problems``."""
    resolved, _ = judge_requests(requests, syllabus, fuzzy)
    return resolved.filter(F.col("resolver_error").isNull()).drop("resolver_error")


def request_problems(requests: DataFrame, syllabus: DataFrame, fuzzy: bool = True) -> DataFrame:
    """``(request_id, problem)``: every validation error, or why chapters could not be resolved."""
    resolved, rejected = judge_requests(requests, syllabus, fuzzy)
    failed = resolved.filter(F.col("resolver_error").isNotNull())
    return rejected.select("request_id", F.explode("errors").alias("problem")).unionByName(
        failed.select("request_id", F.col("resolver_error").alias("problem")))


def draft_for_requests(resolved: DataFrame, questions: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Paper rows for all resolved requests with enough candidates."""
    chosen = S.select_for_requests(resolved, questions, index)
    return papers.draft_rows(chosen.withColumnRenamed("request_id", "paper_id"))


def preview(resolved: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Availability per request, facet counts per request, sample questions per request."""
    pools = S.prepare(S.with_spec(resolved), questions)
    facets = pools.requests.select("request_id", "spec").join(S.facet_counts(pools.cells), "spec").drop("spec")
    return S.availability(pools.requests, pools.cells), facets, S.preview_samples(pools, questions)
