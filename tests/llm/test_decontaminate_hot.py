"""Decontamination where many items and documents share a passage, and word counts without hashes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from itemlake.llm import decontaminate
from itemlake.llm.words import word_counts, words_of

PASSAGE = " ".join(f"p{i}" for i in range(20))


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
def test_word_counts_equal_hashed_words(limit):
    texts = ["", "a", "a b", " a-b ", "Ünï 中文x", "x", "y", "", "  ", "a" * 50, "b,c"]
    want = np.diff(words_of(pa.array(texts)).bounds)
    assert word_counts(pa.array(texts), limit).tolist() == want.tolist()
    assert word_counts(pa.array(["skip me", *texts])[1:], limit).tolist() == want.tolist()


def test_shared_passage_meets_documents_once(spark):
    items = spark.range(120).select(F.col("id").cast("string").alias("item_id"), F.concat(
        F.lit("i"), F.col("id"), F.lit(f" {PASSAGE} e"), F.col("id")).alias("text"))
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("d"), F.col("id"), F.lit(f" {PASSAGE} "), F.repeat(F.lit("z "), 20)).alias("text"), F.lit(1).alias("n_words"))
    rows = decontaminate.contamination(docs, items).collect()
    every = sorted(str(i) for i in range(120))
    assert len(rows) == 60 and all(r.contamination.asDict(True) == {
        "n_words": 41, "n_hit": 20, "spans": [{"start": 1, "end": 21}], "items": every} for r in rows)
    assert decontaminate.drop_contaminated(docs, items).count() == 0
    # Each of the passage's eight windows is one distinct window, in the same set of all items.
    made = items.select(F.col("item_id").alias("item"), "text").mapInArrow(
        decontaminate._item_windows(13, 6), "item string, size int, print long, check long").distinct()
    windows, sets = decontaminate._with_sets(made)
    shared = windows.groupBy("items_of").count().join(sets.groupBy("items_of").agg(F.count("item").alias("n")), "items_of").filter("n = 120")
    assert [r["count"] for r in shared.collect()] == [8]


def test_clashing_columns_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, None, "a"), (1, PASSAGE, "b"), (1, PASSAGE, "b"), (2, "", "c")],
                                 "doc_id long, text string, text_key string").withColumn("check", F.lit(1)).withColumn("items", F.lit(2))
    items = spark.createDataFrame([(None, PASSAGE), ("7", None), ("8", "")], "item_id string, text string")
    rows = sorted((r.text_key, r.contamination.n_words, r.contamination.n_hit, list(r.contamination["items"]))
                  for r in decontaminate.contamination(docs, items).collect())
    assert rows == [("a", 0, 0, []), ("b", 20, 20, [""]), ("b", 20, 20, [""]), ("c", 0, 0, [])]
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {r.text_key for r in kept.collect()} == {"a", "c"}
