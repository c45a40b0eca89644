"""The operators' queries over whole tables, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlake.llm import (decontaminate, fingerprints, language, line_dedup, near_dedup, packing, quotes, simhash, source_audit,
                          spelling, token_files, toxicity, warc)
from itemlake.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), tokenizer(), end=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read(spark, sf_dir, "documents"), tokenizer(), end=1)


@query("op6_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort("contamination.items"), ",")
    return found.select(
        "doc_id", "contamination.n_words", "contamination.n_hit",
        F.size("contamination.items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"))


@query("op8_line_dedup", """
    WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
    totals AS (SELECT source, count(*) AS host_pages FROM pages GROUP BY source),
    lines AS (
        SELECT source, line, count(*) AS pages
        FROM (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM pages)
        WHERE trim(line) <> '' GROUP BY source, line),
    boiler AS (
        SELECT lines.source, list(line) AS dropped
        FROM lines JOIN totals ON lines.source IS NOT DISTINCT FROM totals.source
        WHERE pages >= 5 AND pages / host_pages > 0.1 GROUP BY lines.source),
    cut AS (
        SELECT doc_id, string_split(text, chr(10)) AS own,
               [x FOR x IN string_split(text, chr(10)) IF NOT list_contains(coalesce(dropped, []), x)] AS kept
        FROM documents LEFT JOIN boiler ON documents.source IS NOT DISTINCT FROM boiler.source)
    SELECT doc_id, array_to_string(kept, chr(10)) AS text, coalesce(len(own), 0) AS n_lines,
           coalesce(len(own) - len(kept), 0) AS n_dropped
    FROM cut""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, counts=True).select("doc_id", "text", "n_lines", "n_dropped")


@query("op4_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_dedup.near_duplicates(read(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "class_rows")


@query("op5_fingerprints")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(read(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_warc")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


@query("op7_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs)
    said = language.page_evidence(read(spark, sf_dir, "pages"))
    return language.identify(language.document_rows(docs), model, said).withColumnRenamed("id", "doc_id")


@query("op2_quotes")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(read(spark, sf_dir, "conversations"))


@query("op11_simhash")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.observed_words(read(spark, sf_dir, "documents")))


@query("op13_source_audit", """
    WITH d AS (
        SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    occurring AS (SELECT lang, source, rid, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
    counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM occurring GROUP BY ALL),
    kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL HAVING sum(docs) >= 3),
    langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY ALL),
    present AS (SELECT DISTINCT lang, source FROM d),
    totals AS (
        SELECT present.lang, present.source, coalesce(sum(counts.n) FILTER (kept.term IS NOT NULL), 0)::HUGEINT AS total
        FROM present LEFT JOIN counts ON counts.lang = present.lang AND counts.source = present.source
        LEFT JOIN kept ON kept.lang = counts.lang AND kept.term = counts.term GROUP BY ALL),
    shares AS (
        SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
               1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + l.v) AS p,
               1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
        FROM totals AS t JOIN langs AS l ON l.lang = t.lang JOIN kept AS k ON k.lang = t.lang
        LEFT JOIN counts AS c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
    far AS (
        SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
        FROM shares AS a JOIN shares AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0) AS value
        FROM present AS a JOIN present AS b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
    own AS (
        SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value
        FROM shares WHERE n > 0 AND p > q),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
        FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(read(spark, sf_dir, "documents"))
