"""Raw documents to packed training sequences: stages that each read what the one before wrote.

Every stage but the last returns the columns of documents. ``run`` applies them all; between stages the
rows are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlake.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from itemlake.llm.common import cut_lineage, read
from itemlake.llm.queries import tokenizer


#: On sf0.1 one line is on 8.7 to 13.2 % of every source's pages, all others on at most 4.6 %: the bar lies between.
#: Lines of 40 characters or more count from five pages and 1 % on.
LINE_RATIO, LONG_LINE_RATIO = 0.06, 0.01


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score stays below one half."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their site's boilerplate lines; ``n_chars`` counts what is left."""
    return line_dedup.drop_boilerplate(docs, ratio=LINE_RATIO, long_ratio=LONG_LINE_RATIO).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in full sequences, with their ids and the ids' checksum."""
    pieces = packing.pack(docs, tokenizer())
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate), ("near_dedup", drop_near_copies),
          ("decontamination", drop_contaminated), ("packing", pack)]
#: The scores and signatures are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
