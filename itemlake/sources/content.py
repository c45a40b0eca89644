"""Content lists: one JSON array of blocks per document file."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlake.schemas import CONTENT_LIST, SYLLABUS_SEED

SUFFIX = r"(_content_list)?\.json$"


def parse_content_lists(raw: DataFrame) -> DataFrame:
    """``(doc_id, value)`` JSON arrays to ordered blocks; missing fields become NULL.

    Documents that are no array of blocks give none; ``rejected_content_lists`` tells of them.
    """
    blocks = F.from_json("value", CONTENT_LIST)
    return (raw.filter(F.json_array_length("value").isNotNull())
            .select("doc_id", F.posexplode(blocks).alias("__at", "b"))
            .select("doc_id", F.col("__at").cast("long").alias("block_idx"), "b.*"))


def rejected_content_lists(raw: DataFrame) -> DataFrame:
    """``(doc_id, reason)`` of every document that ``parse_content_lists`` cannot read."""
    reason = (F.when(F.json_array_length("value").isNull(), F.lit("no JSON array"))
              .when(F.from_json("value", CONTENT_LIST).isNull(), F.lit("no blocks in the array")))
    return raw.select("doc_id", reason.alias("reason")).filter(F.col("reason").isNotNull())


def _below(path: Column, folder: str) -> Column:
    """The decoded path below ``folder``, so that files of one name in two folders stay two; the whole path where
    the folder is named in another way than its files."""
    plain = re.sub(r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?(?=/)", "", folder)
    root = (plain if plain.startswith("/") else os.path.abspath(plain)).rstrip("/") + "/"
    # A plus sign stands for itself in a path; the function decodes forms, where it is a blank.
    whole = F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?(?=/)", "")
    return F.when(F.startswith(whole, F.lit(root)), F.substring(whole, len(root) + 1, 2**31 - 1)).otherwise(whole)


def _document_name(folder: str) -> Column:
    return F.regexp_replace(_below(F.col("_metadata.file_path"), folder), SUFFIX, "")


def raw_content_lists(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, value)`` of all content-list files of a folder; each is one document, named by its path
    below the folder without the ending.

    Spark's readers pass over files without a byte; those give no row.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(
        folder, wholetext=True)
    return raw.select(_document_name(folder).alias("doc_id"), "value")


def read_content_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of all readable content-list files of a folder."""
    return parse_content_lists(raw_content_lists(spark, folder))


def stream_content_lists(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The same files as a stream of ``(doc_id, value)``, parsed inside the batch."""
    raw = (spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True)
           .option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_batch).load(folder))
    return raw.select(_document_name(folder).alias("doc_id"), "value")


def read_image_listing(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, filename)`` of the files under ``folder/<doc_id>/``; contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("_metadata.file_path"))
    parts = files.select(F.split(_below(F.col("file_path"), folder), "/").alias("parts"))
    return parts.select(F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), "/").alias("doc_id"),
                        F.element_at("parts", -1).alias("filename"))


def read_syllabus_seed(spark: SparkSession, path: str) -> DataFrame:
    """Nested syllabus as JSON lines: exam, subject and the ordered chapters with aliases."""
    return spark.read.schema(SYLLABUS_SEED).json(path)
