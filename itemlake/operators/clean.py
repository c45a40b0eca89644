"""Block cleaning. Blocks are ``(doc_id, block_idx, type, text, text_level, page_idx, img_path,
html)`` and only their relative order matters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlake import constants as C
from itemlake.functions import text as X
from itemlake.operators.ordered import ordered_scan
from itemlake.session import cut_lineage


def drop_empty(blocks: DataFrame) -> DataFrame:
    return blocks.filter(~(X.is_text(F.col("type")) & X.is_blank(F.col("text"))))


def ad_pages(blocks: DataFrame) -> DataFrame:
    """Distinct ``(doc_id, page_idx)`` holding an advert keyword."""
    hit = X.is_text(F.col("type")) & X.has_ad(F.col("text")) & F.col("page_idx").isNotNull()
    return blocks.filter(hit).select("doc_id", "page_idx").distinct()


def drop_ad_pages(blocks: DataFrame) -> DataFrame:
    """Blocks without a page never match and stay."""
    return blocks.join(ad_pages(blocks), ["doc_id", "page_idx"], "left_anti").select(blocks.columns)


def drop_banners(blocks: DataFrame) -> DataFrame:
    banner = X.is_text(F.col("type")) & X.is_banner(F.col("text"), F.col("text_level"))
    return blocks.filter(~F.coalesce(banner, F.lit(False)))


def drop_garbled(blocks: DataFrame) -> DataFrame:
    bad = X.is_text(F.col("type")) & (X.is_blank(F.col("text")) | X.is_garbled(F.col("text")))
    return blocks.filter(~F.coalesce(bad, F.lit(False)))


def drop_repeated_answers(blocks: DataFrame) -> DataFrame:
    """Of answer-only blocks in a row keep the last."""
    only = X.is_text(F.col("type")) & F.coalesce(
        X.py_strip(F.col("text")).rlike(C.ANSWER_ONLY), F.lit(False))
    flagged = blocks.withColumn("__only", only)
    scanned = ordered_scan(flagged, ["doc_id"], ["block_idx"],
                           following={"__next_only": F.col("__only")})
    repeated = F.col("__only") & F.coalesce("__next_only", F.lit(False))
    return scanned.filter(~repeated).select(blocks.columns)


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """All cleaning steps; the order matters, each step sees what the one before left.

    The last step scans its input twice, so what the others leave is written first.
    """
    kept = drop_garbled(drop_banners(drop_ad_pages(drop_empty(blocks))))
    return drop_repeated_answers(cut_lineage(kept))


def page_counts(blocks: DataFrame) -> DataFrame:
    pages = F.max(F.coalesce("page_idx", F.lit(0))) + 1
    return blocks.groupBy("doc_id").agg(pages.cast("int").alias("page_count"))


def block_profile(blocks: DataFrame) -> DataFrame:
    """Number of blocks per document and kind, synonyms folded."""
    kind = F.lower(F.coalesce("type", F.lit("unknown")))
    columns = [F.count_if(kind.isin(names)).alias(f"{name}_blocks")
               for name, names in C.BLOCK_TYPES.items()]
    known = [n for names in C.BLOCK_TYPES.values() for n in names]
    return blocks.groupBy("doc_id").agg(
        *columns, F.count_if(~kind.isin(known)).alias("other_blocks"))
