"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

The lexicon is learnt: words and word beginnings that are much more frequent in toxic than in other
labelled documents, as (hash, toxic documents, other documents). Features are densities of lexicon
words, their nearness to the second person, capitals, marks and obfuscation. While trees and calibration are
fitted, a document does not count itself into the lexicon; scores take the counts of the whole sample. Trees are fitted
by Spark ML on three quarters of a bounded sample of labelled rows, the calibration on the rest; all documents are scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlake.llm.common import cut_lineage, freeing, small_batches
from itemlake.llm.words import VALUES, Words, span_hashes, word_slices, words_of

#: Labelled rows used for fitting, about; with the size of the ranked lexicon the only bound in this operator.
SAMPLE_ROWS = 20_000
#: Entries of the lexicon, and documents that an entry must occur in.
LEXICON, SUPPORT = 2_000, 3
TREES, DEPTH = 20, 3
STEMS = (4, 5, 6)  # bytes of the word beginnings
NEAR = 6  # words
LEAST_ODDS = 2.0
SECOND_PERSON = ("you your yours yourself u ur du dein deine dir dich ihr euch tu te toi ton ta tes vous votre vos "
                 "tú ti tuyo usted ustedes vosotros").split()
_PERSON = np.sort(words_of(pa.array([" ".join(SECOND_PERSON)])).hashes)
_LEET = VALUES.copy()
for _digit, _letter in zip(b"013457", b"oieast"):
    _LEET[_digit] = VALUES[_letter]
_CAPITAL, _LETTER, _SHOUT, _MARK = (np.zeros(256, np.float32) for _ in range(4))
_CAPITAL[65:91] = 1
_LETTER[65:91] = _LETTER[97:123] = 1
_SHOUT[[33, 63]] = 1
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_U = np.uint64


class Model(NamedTuple):
    lexicon: tuple[np.ndarray, np.ndarray, np.ndarray, int, int]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    rate: float


def _forms(w: Words, values: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Hashes of every word, then of its beginnings (of the word itself where it is shorter)."""
    table = VALUES if values is None else values
    raw = table[w.raw]
    yield w.hashes if values is None else span_hashes(raw, w.starts, w.ends)
    for n in STEMS:
        yield span_hashes(raw, w.starts, np.minimum(w.starts + n, w.ends)) ^ _U(n)


def _count_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per form and label."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for first, last, w in word_slices(batch.column(0)):
            of = np.repeat(np.arange(last - first), np.diff(w.bounds))
            forms = list(_forms(w))
            form, doc = np.concatenate(forms), np.tile(of, len(forms))
            order = np.lexsort((doc, form))
            form, doc = form[order], doc[order]
            new = np.ones(len(form), bool)
            new[1:] = (form[1:] != form[:-1]) | (doc[1:] != doc[:-1])
            form, label = form[new], toxic[first:last][doc[new]]
            distinct, at = np.unique(form, return_inverse=True)
            bad = np.bincount(at, weights=label, minlength=len(distinct)).astype(np.int64)
            every = np.bincount(at, minlength=len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(bad), pa.array(every - bad)],
                                             ["form", "toxic", "other"])


def learn_lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """``(forms, toxic documents, other documents, all toxic, all other)`` from ``sample (text, label)``.

    All forms of the sample are counted and weighed by Spark; of those in at least SUPPORT toxic documents and with odds
    of at least LEAST_ODDS (logarithms) the LEXICON best by odds times toxic documents come back.
    """
    totals = sample.agg(F.sum("label"), F.count(F.lit(1))).first()
    bad, every = int(totals[0] or 0), int(totals[1])
    counted = (sample.select("text", "label").mapInArrow(freeing(_count_forms), "form long, toxic long, other long")
               .groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).filter(F.col("toxic") >= SUPPORT))
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("other") + 0.5) / (every - bad + 1))
    rows = (counted.withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
            .orderBy(F.desc(F.col("odds") * F.col("toxic")), "form").limit(LEXICON).collect())
    forms = np.array([r["form"] for r in rows], np.int64).view(np.uint64)
    toxic, other = (np.array([r[c] for r in rows], np.int64) for c in ("toxic", "other"))
    best = np.argsort(forms)
    return forms[best], toxic[best], other[best], bad, every - bad


def _odds(toxic, other, all_toxic, all_other):
    return (np.log((np.maximum(toxic, 0) + 0.5) / (max(all_toxic, 0) + 1))
            - np.log((np.maximum(other, 0) + 0.5) / (max(all_other, 0) + 1)))


def _features(lexicon):
    forms, toxic, other, all_toxic, all_other = lexicon
    # Weights for documents outside the sample, for toxic ones in it and for others in it.
    weights = np.stack([_odds(toxic, other, all_toxic, all_other),
                        np.where(toxic > SUPPORT, _odds(toxic - 1, other, all_toxic - 1, all_other), 0),
                        _odds(toxic, other - 1, all_toxic, all_other - 1)]) if len(forms) else np.zeros((3, 1))
    table = forms if len(forms) else np.zeros(1, np.uint64)

    def word_weights(w: Words, part: np.ndarray, values=None) -> np.ndarray:
        best = np.zeros(len(w.hashes))
        for h in _forms(w, values):
            at = np.minimum(np.searchsorted(table, h), len(table) - 1)
            hit = np.flatnonzero(table[at] == h)
            best[hit] = np.maximum(best[hit], weights[part[hit], at[hit]])
        return np.where(best >= LEAST_ODDS, best, 0)

    def of_slice(w: Words, part: np.ndarray) -> np.ndarray:
        n = len(w.bounds) - 1
        lengths = np.diff(w.bounds)
        of = np.repeat(np.arange(n), lengths)

        def per_text(amount):
            sums = np.concatenate([[0.0], np.cumsum(amount, dtype=np.float64)])
            return sums[w.bounds[1:]] - sums[w.bounds[:-1]]

        def per_byte(amount):
            sums = np.concatenate([[0.0], np.cumsum(amount, dtype=np.float64)])
            return sums[w.text_bounds[1:]] - sums[w.text_bounds[:-1]]

        weight = word_weights(w, part[of])
        hit = weight > 0
        words, bytes_ = np.maximum(lengths, 1), np.maximum(np.diff(w.text_bounds), 1)
        hits = per_text(hit)
        most = np.zeros(n)
        np.maximum.at(most, of[hit], weight[hit])
        person = np.isin(w.hashes, _PERSON)
        near = np.concatenate([[0], np.cumsum(person)])
        i = np.flatnonzero(hit)
        low = np.maximum(i - NEAR, w.bounds[:-1][of[i]])
        high = np.minimum(i + NEAR + 1, w.bounds[1:][of[i]])
        close = np.zeros(len(hit))
        close[i] = (near[high] - near[low]) > 0
        hidden = np.zeros(len(hit))
        digits = np.concatenate([[0], np.cumsum((w.raw >= 48) & (w.raw <= 57))])
        mixed = (digits[w.ends] > digits[w.starts]) & (digits[w.ends] - digits[w.starts] < w.ends - w.starts)
        if mixed.any():
            hidden = ((word_weights(w, part[of], _LEET) > 0) & mixed & ~hit).astype(float)
        mark, letter = _MARK[w.raw], _LETTER[w.raw]
        inner = np.zeros(len(w.raw), np.float32)
        inner[1:-1] = mark[1:-1] * letter[:-2] * letter[2:] if len(w.raw) > 2 else 0
        same = np.zeros(len(w.raw), np.float32)
        if len(w.raw) > 2:
            same[2:] = (w.raw[2:] == w.raw[1:-1]) & (w.raw[1:-1] == w.raw[:-2]) & (letter[2:] > 0)
        letters = np.maximum(per_byte(letter), 1)
        return np.stack([
            hits / words, np.log1p(hits), per_text(weight) / words, most, per_text(close) / words, np.log1p(per_text(close)),
            per_text(person) / words, per_byte(_CAPITAL[w.raw]) / letters, per_byte(_SHOUT[w.raw]) / bytes_,
            per_byte(mark) / bytes_, per_text(mixed) / words, np.log1p(per_text(hidden)), per_byte(inner) / bytes_,
            per_byte(same) / bytes_, np.log1p(lengths)], axis=1)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, parts in batches:
            part = parts.to_numpy(zero_copy_only=False).astype(np.int64)
            rows = [of_slice(w, part[a:b]) for a, b, w in word_slices(texts)]
            flat = np.concatenate(rows) if rows else np.zeros((0, 15))
            yield pa.FixedSizeListArray.from_arrays(pa.array(flat.reshape(-1)), flat.shape[1]).cast(pa.list_(pa.float64()))
    return F.arrow_udf(freeing(run), "array<double>")


def held_out(doc_id: str | Column) -> Column:
    """Whether a row is kept from learning: its id's checksum divides by five."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a hash sample of about ``sample_rows`` labelled rows that are not held out.

    Rows without id or label are left out; several labels of an id count as toxic if one is. Without
    labels of both kinds the model gives their rate, or 0, to every text.
    """
    known = (labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
             .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out("id"))
             .groupBy("id").agg(F.max("label").alias("label")))
    small_batches(docs.sparkSession)
    known = cut_lineage(known)
    share = min(1.0, sample_rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < round(share * 1_000_000))
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    # The sample is about sample_rows ids, so it may go to every task.
    sample = cut_lineage(texts.join(F.broadcast(chosen), "id").select("id", "text", "label").repartition(8, "id"))
    lexicon = learn_lexicon(sample)
    rate = lexicon[3] / max(1, lexicon[3] + lexicon[4])
    if not lexicon[3] or not lexicon[4]:
        return Model(lexicon, None, None, rate)
    part = F.when(F.col("label") == 1, 1).otherwise(2)
    rows = cut_lineage(sample.select("id", F.col("label").cast("double").alias("label"),
                                     _features(lexicon)("text", part).alias("values")))
    ready = rows.select("id", "label", array_to_vector("values").alias("__features"))
    later = F.pmod(F.xxhash64("id", F.lit(12)), F.lit(4)) == 0
    trees = (GBTClassifier(featuresCol="__features", labelCol="label", predictionCol="__predicted", maxIter=TREES,
                           maxDepth=DEPTH, stepSize=0.3, seed=7, checkpointInterval=-1)
             .setRawPredictionCol("__raw").setProbabilityCol("__probability").fit(ready.filter(~later)))
    margins = trees.transform(ready.filter(later)).select("label", vector_to_array("__raw")[1].alias("__margin"))
    both = margins.agg(F.count_distinct("label")).first()[0] == 2
    calibration = IsotonicRegression(featuresCol="__margin", labelCol="label", predictionCol="__level").fit(margins) if both else None
    return Model(lexicon, trees, calibration, rate)


def score(docs: DataFrame, model: Model, *, text: str = "text", result: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; NULL and empty texts are scored as texts without words.

    The score is the calibrated value; within a step of the calibration the trees' own probability
    orders the texts, with a hundredth of the weight.
    """
    if model.trees is None:
        return docs.withColumn(result, F.lit(float(model.rate)))
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.withColumn("__features", array_to_vector(_features(model.lexicon)(whole, F.lit(0))))
    rows = model.trees.transform(rows)
    chance = vector_to_array("__probability")[1]
    if model.calibration is not None:
        rows = model.calibration.transform(rows.withColumn("__margin", vector_to_array("__raw")[1]))
        chance = F.col("__level") * 0.99 + chance * 0.01
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.least(F.greatest(chance, F.lit(0.0)), F.lit(1.0)).alias(result))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """The documents scored below ``threshold``, unchanged."""
    scored = score(docs, fit(docs, labels, **options), text=options.get("text", "text"), result="__score")
    return scored.filter(F.col("__score") < threshold).drop("__score")
