"""Language ID by fusing evidence.

The posterior of a language adds up logarithms of: the text's likelihood under byte trigrams; what
the markup declares; what the address says (a language segment of the path or the top-level domain); and
the host's prior. How far declarations and addresses can be trusted is measured by grouped
aggregation over all rows against the text's own verdict, and host priors are smoothed towards
their domain's and those towards the whole corpus'.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlake.llm.common import cut_lineage, freeing, typed
from itemlake.llm.encode import plain_strings, text_slices
from itemlake.llm.words import VALUES

#: Labelled rows that the trigram model is fitted on, about.
SAMPLE_ROWS = 5_000
BUCKETS = 1 << 15
#: Trigrams of one text depend on each other: a text counts as so many independent ones at most.
EVIDENCE = 60.0
#: Pseudo-counts of the smoothing: declarations, addresses, hosts, domains.
TRUST, HOST = 20.0, 10.0


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # log probability of each trigram bucket, by language


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bucket, text, n)``: trigram buckets of every text, the text each belongs to, trigrams per text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    letter = ((raw >= 97) & (raw <= 122)) | ((raw >= 65) & (raw <= 90)) | (raw >= 128)
    code = np.where(letter, VALUES[raw], VALUES[32])
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    with np.errstate(over="ignore"):
        mixed = code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:]
    bucket = ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 15)).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    keep = (of[:-2] == of[2:]) & (letter[1:-1] | letter[:-2] | letter[2:])
    return bucket[keep], of[:-2][keep], np.bincount(of[:-2][keep], minlength=len(texts))


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        sample_rows: int = SAMPLE_ROWS) -> Model:
    """Trigram model from a hash sample of about ``sample_rows`` rows with a language and a text.

    At most BUCKETS sums per language come back from the sample.
    """
    rows = (typed(docs, {"id": (doc_id, "string"), "text": (text, "string"), "lang": (lang, "string")})
            .filter(F.col("lang").isNotNull() & (F.length("text") > 0)))
    share = min(1.0, sample_rows / max(1, rows.count()))
    chosen = rows.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < math.ceil(share * 1_000_000))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            texts = plain_strings(batch.column(0))
            for a, b in text_slices(texts):
                bucket, of, _ = _trigrams(texts.slice(a, b - a))
                for one in set(langs[a:b]):
                    n = np.bincount(bucket[(langs[a:b] == one)[of]], minlength=BUCKETS)
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(at), pa.string()), pa.array(at), pa.array(n[at])],
                                                     ["lang", "bucket", "n"])

    sums = (chosen.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(sums["lang"].unique())
    counts = np.full((len(languages), BUCKETS), 0.5)
    for i, one in enumerate(languages):
        own = sums[sums["lang"] == one]
        counts[i, own["bucket"].to_numpy(np.int64)] += own["n"].to_numpy(np.float64)
    return Model(languages, np.log(counts / counts.sum(axis=1, keepdims=True)))


def text_evidence(model: Model, text: str | Column) -> Column:
    """Log likelihood of a text under each language, of EVIDENCE trigrams at most; zeros without letters."""
    weights = model.weights

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            texts = plain_strings(texts)
            out = []
            for a, b in text_slices(texts):
                bucket, of, n = _trigrams(texts.slice(a, b - a))
                scale = np.minimum(n, EVIDENCE) / np.maximum(n, 1)
                out.append(np.stack([np.bincount(of, weights=w[bucket], minlength=b - a) * scale for w in weights], axis=1)
                           if len(weights) else np.zeros((b - a, 0)))
            flat = np.concatenate(out) if out else np.zeros((0, len(weights)))
            values = pa.array(flat.reshape(-1))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(weights)), values)
    return F.arrow_udf(freeing(run), "array<double>")(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def declared_language(html: str | Column) -> Column:
    """Primary code of the language that the root element declares, or NULL."""
    column = F.col(html) if isinstance(html, str) else html
    return F.nullif(F.lower(F.regexp_extract(column, r"(?is)<html[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b", 1)), F.lit(""))


def host_of(url: str | Column) -> Column:
    column = F.col(url) if isinstance(url, str) else url
    return F.nullif(F.lower(F.regexp_extract(column, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def address_language(url: str | Column) -> Column:
    """A two-letter first segment of the path, else a two-letter top-level domain, else NULL."""
    column = F.lower(F.col(url) if isinstance(url, str) else url)
    segment = F.regexp_extract(column, r"^(?:[a-z][a-z0-9+.\-]*://)?[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1)
    domain = F.regexp_extract(host_of(column), r"\.([a-z]{2})$", 1)
    return F.coalesce(F.nullif(segment, F.lit("")), F.nullif(domain, F.lit("")))


def _softmax(scores: Column) -> Column:
    raised = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def identify(rows: DataFrame, model: Model, pages: DataFrame | None = None, *, key: str = "id") -> DataFrame:
    """``rows (key, text, host, declared, address)`` to key, ``lang``, ``confidence`` and ``text_lang``.

    ``pages (key, host, declared, address)`` may say more about a key, any number of times. Where there are pages they
    count instead of the row's own declaration and address, and the row's host only for pages without one: each page's
    evidence is a sum of logarithms, and the mean over the pages is added to the text's, as pages of one document
    repeat each other. Trust tables and host priors are measured over all of them.

    Each row gives a row, also of repeated or NULL keys; pages of unknown or NULL keys count for nothing. NULL
    evidence counts for no language; rows without host take the corpus' prior; a text without letters is judged by the
    other evidence alone; without a model ``lang`` is NULL.
    """
    size = len(model.languages)
    scored = cut_lineage(rows.select(
        F.monotonically_increasing_id().alias("row"), F.col(key), "host", "declared", "address",
        text_evidence(model, "text").alias("text_score")))
    if not size:
        return scored.select(key, F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"),
                             F.lit(None).cast("string").alias("text_lang"))
    names = F.array(*[F.lit(x) for x in model.languages])

    def known(column: str) -> Column:
        return F.when(F.col(column).isin(model.languages), F.col(column)).when(F.col(column).isNotNull(), F.lit("other"))

    told = scored.withColumns({"n": F.lit(1).cast("long"), "paged": F.lit(False)})
    if pages is not None:
        # Equal pages of a key are counted before they meet its row, so a key with very many is few rows.
        counts = pages.filter(F.col(key).isNotNull()).groupBy(
            F.col(key).alias("p_key"), F.col("host").alias("p_host"), known("declared").alias("p_declared"),
            known("address").alias("p_address")).agg(F.count(F.lit(1)).alias("p_n"))
        paged = F.col("p_key").isNotNull()
        told = cut_lineage(scored.join(counts, scored[key] == F.col("p_key"), "left").select(
            "row", key, "text_score", F.coalesce("p_host", "host").alias("host"),
            F.when(paged, F.col("p_declared")).otherwise(F.col("declared")).alias("declared"),
            F.when(paged, F.col("p_address")).otherwise(F.col("address")).alias("address"),
            F.coalesce("p_n", F.lit(1)).alias("n"), paged.alias("paged")))
    first = told.withColumns({"share": _softmax(F.col("text_score")), "domain": F.substring_index("host", ".", -2)})

    def sums() -> list[Column]:
        return [F.sum(F.col("n") * F.col("share")[i]).alias(f"s{i}") for i in range(size)]

    def trusted(column: str) -> Column:
        """log P(said | language): at most (languages + 1) * languages sums come back."""
        table = {r["said"]: [r[f"s{i}"] for i in range(size)] for r in
                 first.groupBy(known(column).alias("said")).agg(*sums()).collect() if r["said"]}
        said = [*model.languages, "other"]
        totals = [sum(v[i] for v in table.values()) for i in range(size)]
        pairs = []
        for s in said:
            counts = table.get(s, [0.0] * size)
            guess = [0.7 if s == x else 0.3 / size for x in model.languages]
            pairs += [F.lit(s), F.array(*[F.lit(math.log((counts[i] + TRUST * guess[i]) / (totals[i] + TRUST)))
                                          for i in range(size)])]
        none = F.array(*[F.lit(0.0)] * size)
        return F.coalesce(F.create_map(*pairs)[known(column)], none)

    whole = first.agg(*sums()).first()
    count = sum(x or 0.0 for x in whole)
    corpus = F.array(*[F.lit(((x or 0.0) + 1) / (count + size)) for x in whole])
    hosts = first.filter(F.col("host").isNotNull()).groupBy("host", "domain").agg(*sums())

    def smoothed(parent: Column) -> Column:
        own = F.array(*[F.col(f"s{i}") for i in range(size)])
        total = sum((F.col(f"s{i}") for i in range(size)), F.lit(0.0))
        return F.zip_with(own, parent, lambda n, p: (n + p * HOST) / (total + HOST))

    domains = (hosts.groupBy("domain").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(size)])
               .select("domain", smoothed(corpus).alias("parent")))
    priors = cut_lineage(hosts.join(domains, "domain").select(F.col("host").alias("p_host"), smoothed(F.col("parent")).alias("prior")))
    joined = first.join(priors, first["host"] == priors["p_host"], "left").withColumn("prior", F.coalesce("prior", corpus))
    evidence = F.zip_with(F.transform("prior", lambda x: F.log(x)),
                          F.zip_with(trusted("declared"), trusted("address"), lambda a, b: a + b), lambda a, b: a + b)
    valued = joined.select("row", key, "text_score", "n", "paged", evidence.alias("evidence"))
    if pages is not None:
        mean = F.array(*[F.sum(F.col("n") * F.col("evidence")[i]) / F.sum("n") for i in range(size)])
        valued = valued.filter(~F.col("paged")).select(key, "text_score", "evidence").unionByName(
            valued.filter("paged").groupBy("row").agg(F.first(key).alias(key), F.first("text_score").alias("text_score"),
                                                      mean.alias("evidence")).drop("row"))
    judged = (valued.withColumn("posterior", _softmax(F.zip_with("text_score", "evidence", lambda a, b: a + b)))
              .withColumn("share", _softmax(F.col("text_score"))))
    best = F.array_max("posterior")
    return judged.select(
        key, F.element_at(names, F.array_position("posterior", best).cast("int")).alias("lang"), best.alias("confidence"),
        F.element_at(names, F.array_position("share", F.array_max("share")).cast("int")).alias("text_lang"))


def document_rows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Documents as rows to identify: ``id, text, host, declared, address``; the source is the host. Other columns go."""
    return typed(docs, {"id": (doc_id, "long"), "text": (text, "string"), "host": (source, "string")}).withColumns(
        {"declared": F.lit(None).cast("string"), "address": F.lit(None).cast("string")})


def page_evidence(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """What every page says about the document whose number ends its address: ``id, host, declared, address``.

    Pages whose address ends in no number, or is NULL, are left out.
    """
    number = F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?[^/?#]+/(?:[^?#]*/)?(\d+)(?:\.\w+)?/?(?:[?#].*)?$", 1)
    said = typed(pages, {"url": (url, "string"), "html": (html, "string")})
    return said.select(number.try_cast("long").alias("id"), host_of("url").alias("host"), declared_language("html").alias("declared"),
                       address_language("url").alias("address")).filter(F.col("id").isNotNull())
