"""Text functions and model responses over whole columns of text."""

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from itemlake.functions import metadata as M
from itemlake.functions import text as X
from itemlake.operators import bank as B
from itemlake.operators import layouts as L
from itemlake.plans import ingest
from itemlake.plans.queries import query
from itemlake.plans.queries.blocks import INLINE_BUILT, flat
from itemlake.session import cut_lineage, new_folder
from itemlake.sources import sinks

MARK = "\\(\\s*([1-4A-Da-d])\\s*\\)"


@query("strip_latex_for_search", """
SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(mixed,
  '(?s)\\$\\$.*?\\$\\$', ' ', 'g'), '\\$[^$]+\\$', ' ', 'g'), '\\\\[a-zA-Z]+\\{[^}]*\\}', ' ', 'g'), '\\\\[a-zA-Z]+', ' ', 'g'),
  '[{}\\\\^_]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM latex""")
def _(v):
    return v.latex.select("id", X.strip_latex_for_search(F.col("mixed")).alias("plain"))


@query("search_text_of_documents", """
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '(?s)\\$\\$.*?\\$\\$', ' ', 'g'), '\\$[^$]+\\$', ' ', 'g'), '\\\\[a-zA-Z]+\\{[^}]*\\}', ' ', 'g'), '\\\\[a-zA-Z]+', ' ', 'g'),
  '[{}\\\\^_]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM documents""")
def _(v):
    return v.documents.select("doc_id", X.strip_latex_for_search(F.col("text")).alias("plain"))


OPTIONS = f"""
WITH m AS (SELECT doc_id, block_idx, regexp_extract_all(text, '{MARK}', 1) AS ls, string_split_regex(text, '{MARK}')[2:] AS ps
  FROM blk_inline WHERE type = 'text'),
u AS (SELECT doc_id, block_idx, len(ls) AS k, upper(translate(unnest(ls), '1234', 'ABCD')) AS l, trim(unnest(ps)) AS v,
  generate_subscripts(ls, 1) AS i FROM m),
lasts AS (SELECT doc_id, block_idx, k, l, arg_max(v, i) AS v FROM u WHERE k >= MINIMUM AND (MINIMUM > 1 OR v <> '') GROUP BY ALL),
opts AS (SELECT doc_id, block_idx, string_agg(l || '=' || v, '|' ORDER BY l) AS options FROM lasts GROUP BY ALL)
SELECT b.doc_id, b.block_idx, coalesce(o.options, '') AS options FROM blk_inline b LEFT JOIN opts o USING (doc_id, block_idx) WHERE b.type = 'text'
"""


@query("split_options", OPTIONS.replace("MINIMUM", "2"))
def _(v):
    return v.blk_inline.filter("type = 'text'").select(
        "doc_id", "block_idx", flat(X.split_options(F.col("text"))).alias("options"))


@query("inline_options", OPTIONS.replace("MINIMUM", "1"))
def _(v):
    return v.blk_inline.filter("type = 'text'").select(
        "doc_id", "block_idx", flat(X.inline_options(F.col("text"))).alias("options"))


@query("stem_fragments", f"""
SELECT doc_id, block_idx, trim(string_split_regex(text, '{MARK}')[1]) AS stem FROM blk_inline WHERE type = 'text'""")
def _(v):
    return v.blk_inline.filter("type = 'text'").select(
        "doc_id", "block_idx", X.stem_fragment(F.col("text")).alias("stem"))


@query("extract_answers", """
SELECT doc_id, block_idx, ['A', 'B', 'C', 'D'][TRY_CAST(regexp_extract(text, '(?i)Ans\\.?\\s*\\(\\s*([1-4])\\s*\\)', 1) AS INT)] AS answer
FROM blk_inline WHERE type = 'text'""")
def _(v):
    return v.blk_inline.filter("type = 'text'").select(
        "doc_id", "block_idx", X.extract_answer(F.col("text")).alias("answer"))


@query("question_starts", """
SELECT doc_id, block_idx, CASE WHEN type = 'text' THEN TRY_CAST(regexp_extract(trim(text), '^(\\d{1,3})\\.\\s+', 1) AS INT) END AS number,
  type = 'text' AND regexp_matches(coalesce(text, ''), '(?i)Ans\\.?\\s*\\(\\s*[1-4A-Da-d]\\s*\\)') AS is_answer FROM blk_inline""")
def _(v):
    kind, text = F.col("type"), F.col("text")
    return v.blk_inline.select("doc_id", "block_idx", X.start_number(kind, text).alias("number"),
                               X.is_answer(kind, text).alias("is_answer"))


@query("question_number_prefixes", """
SELECT doc_id, block_idx, TRY_CAST(coalesce(nullif(regexp_extract(text, '^\\s*[Qq]\\.?\\s*(\\d{1,3})\\s*[\\.\\)]\\s*', 1), ''),
    nullif(regexp_extract(text, '^\\s*(\\d{1,3})\\s*[\\.\\)]\\s+\\S', 1), '')) AS INT) AS number,
  CASE WHEN regexp_matches(text, '^\\s*[Qq]\\.?\\s*\\d{1,3}\\s*[\\.\\)]') THEN trim(regexp_replace(text, '^\\s*[Qq]\\.?\\s*(\\d{1,3})\\s*[\\.\\)]\\s*', ''))
    ELSE trim(regexp_replace(text, '^\\s*\\d{1,3}\\s*[\\.\\)]\\s*', '')) END AS rest
FROM blk_full WHERE type = 'text'""")
def _(v):
    text = F.col("text")
    return v.full_blocks.filter("type = 'text'").select(
        "doc_id", "block_idx", X.question_number(text).alias("number"), X.strip_number(text).alias("rest"))


@query("normalized_block_text", """
SELECT doc_id, block_idx, trim(regexp_replace(regexp_replace(trim(text), '(?i)\\bmathon\\s*go\\b', ' ', 'g'), ' {2,}', ' ', 'g')) AS text
FROM blk_full WHERE type = 'text'""")
def _(v):
    return v.full_blocks.filter("type = 'text'").select("doc_id", "block_idx", X.normalize_text(F.col("text")).alias("text"))


@query("key_headers", """
SELECT doc_id, block_idx, regexp_matches(lower(text), 'answer key|ans key|ans\\. key|answers|answer sheet|solution key') AS is_header
FROM blk_full WHERE type = 'text'""")
def _(v):
    return v.full_blocks.filter("type = 'text'").select("doc_id", "block_idx", X.is_key_header(F.col("text")).alias("is_header"))


@query("equation_array_options", """
SELECT l.id, CASE p.p_partkey % 5 WHEN 0 THEN concat('A=', p_size, '|C=', p_name) WHEN 1 THEN concat('B=', p_size, '|D=', p_brand) ELSE '' END AS options
FROM latex l JOIN part p ON p.p_partkey = l.id""")
def _(v):
    return v.latex.select("id", flat(X.equation_options(F.when(F.col("cells").startswith("$$"), F.col("cells")).otherwise(""))).alias("options"))


@query("embedded_array_options", """
SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 3 THEN concat('B=', p_size, '|D=', p_name) ELSE '' END AS options FROM part""")
def _(v):
    return v.latex.select("id", flat(X.embedded_array_options(F.col("cells"))).alias("options"))


@query("latex_array_options", """
SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN concat('A=', p_size, '|C=', p_name) WHEN 3 THEN concat('B=', p_size, '|D=', p_name, '   $ )')
  ELSE '' END AS options FROM part""")
def _(v):
    return v.latex.select("id", flat(X.latex_array_options(F.col("cells"))).alias("options"))


@query("merged_marker_options", """
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN concat('A=$', p_size, '$|C=$', p_name, '$') WHEN 1 THEN concat('B=left ', p_size, '|D=right')
  WHEN 2 THEN '' END AS options FROM part""")
def _(v):
    return v.latex.select("id", flat(X.merged_marker_options(F.col("merged"))).alias("options"))


@query("wrap_bare_latex", """
SELECT id, regexp_replace(bare, '(\\\\(text|frac)(\\{[^}]*\\})*([\\^_]\\{[^}]*\\})*([\\^_][0-9])*)', '$\\1$', 'g') AS wrapped FROM latex""")
def _(v):
    return v.latex.select("id", X.wrap_bare_latex(F.col("bare")).alias("wrapped"))


@query("formula_markers", """
SELECT doc_id, contains(text, '$') OR contains(text, '\\frac') OR contains(text, '\\sqrt') OR contains(text, '\\int') OR contains(text, '\\sum') AS has_formula
FROM documents""")
def _(v):
    return v.documents.select("doc_id", X.has_formula_marker(F.col("text")).alias("has_formula"))


@query("formula_and_table_counts", """
SELECT id, len(regexp_extract_all(t, '\\$\\$[^$]+\\$\\$')) + len(regexp_extract_all(regexp_replace(t, '\\$\\$', '', 'g'), '\\$[^$]+\\$'))
  AS formulas, len(regexp_extract_all(t, '(\\|[^\\n]+\\|[\\r\\n]+)+')) AS tables
FROM (SELECT p_partkey AS id, concat('$$', p_size, '$$ and ', CASE WHEN p_size % 2 = 0 THEN '$x$' ELSE 'x' END, chr(10), '| a | b |', chr(10), '| ', p_name,
  ' | c |', chr(10), 'text', chr(10), CASE WHEN p_size % 3 = 0 THEN concat('| z | y |', chr(10)) ELSE '' END) AS t FROM part) AS s""")
def _(v):
    texts = v.part.selectExpr("p_partkey AS id", """concat('$$', p_size, '$$ and ', CASE WHEN p_size % 2 = 0 THEN '$x$' ELSE 'x' END, chr(10),
        '| a | b |', chr(10), '| ', p_name, ' | c |', chr(10), 'text', chr(10), CASE WHEN p_size % 3 = 0 THEN concat('| z | y |', chr(10)) ELSE '' END) AS t""")
    return texts.select("id", X.formula_count(F.col("t")).cast("long").alias("formulas"),
                        X.table_count(F.col("t")).cast("long").alias("tables"))


@query("stem_previews", """
SELECT id, concat(rtrim(left(t, 120)), CASE WHEN len(t) > 120 THEN '…' ELSE '' END) AS preview
FROM (SELECT id, trim(regexp_replace(regexp_replace(coalesce(nullif(raw_text, ''), stem_md), '(?s)\\$\\$?.*?\\$\\$?', '[formula]', 'g'), '\\s+', ' ', 'g')) AS t FROM q_docs) AS s""")
def _(v):
    return v.q_docs.select("id", X.stem_preview(F.col("raw_text"), F.col("stem_md")).alias("preview"))


@query("options_search_text", """
SELECT id, CASE WHEN section_type = 'mcq' THEN concat_ws(' ', opt_a, opt_b, opt_c) ELSE '' END AS search,
  CASE WHEN section_type = 'mcq' THEN concat('(A) ', opt_a, chr(10), '(B) ', opt_b, chr(10), '(C) ', opt_c)
    ELSE '(No options — integer/numerical type)' END AS prompt FROM q_parts""")
def _(v):
    options = F.col("options")
    return v.questions.select("id", X.options_text(options).alias("search"), X.options_prompt_text(options).alias("prompt"))


@query("print_math", """
SELECT id, regexp_replace(regexp_replace(mixed, '(?s)\\$\\$(.*?)\\$\\$', '\\\\(\\1\\\\)', 'g'), '(?s)\\$(.*?)\\$', '\\\\(\\1\\\\)', 'g') AS printed FROM latex""")
def _(v):
    return v.latex.select("id", X.print_math(F.col("mixed")).alias("printed"))


@query("strip_html_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS body FROM pages")
def _(v):
    return v.pages.select("page_id", X.strip_tags(F.col("html")).alias("body"))


@query("key_answer_normalization", """
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN CAST(l_linenumber AS VARCHAR)
  WHEN l_linenumber <= 4 THEN ['A', 'B', 'C', 'D'][l_linenumber] ELSE concat(l_linenumber, 'X') END AS answer
FROM lineitem""")
def _(v):
    rows = v.lineitem.selectExpr(
        "l_orderkey", "l_partkey", "l_linenumber", "CASE WHEN l_linestatus = 'O' THEN 'integer' ELSE 'mcq' END AS section",
        "CASE WHEN l_linestatus = 'F' AND l_linenumber > 4 THEN concat(l_linenumber, 'x') ELSE concat(' ', l_linenumber) END AS raw")
    return rows.select("l_orderkey", "l_partkey", "l_linenumber",
                       X.normalize_key_answer(F.col("section"), F.col("raw")).alias("answer"))


# --- Model responses --------------------------------------------------------------------------

@query("json_recovery", """
SELECT p_partkey AS id, p_partkey % 17 <> 0 AS parsed, CASE WHEN p_partkey % 17 <> 0 THEN concat(chr(92), 'theta ', p_name) END AS topic FROM part""")
def _(v):
    parsed = v.latex.select("id", M.recover_json(F.col("response")).alias("json"))
    return parsed.select("id", F.col("json").isNotNull().alias("parsed"),
                         F.try_variant_get("json", "$.topic", "string").alias("topic"))


@query("metadata_normalization", """
SELECT p_partkey AS id, CASE WHEN ok THEN CASE p_partkey % 3 WHEN 0 THEN 'Oscillations' WHEN 2 THEN p_brand END END AS chapter,
  CASE WHEN ok THEN CASE p_partkey % 4 WHEN 0 THEN 'physics' WHEN 1 THEN 'mathematics' WHEN 2 THEN 'history' END END AS subject,
  CASE WHEN ok THEN 'easy' END AS difficulty, CASE WHEN ok THEN p_type ELSE '' END AS concepts,
  ok AND p_partkey % 2 = 0 AS has_formula, p_size > 25 AS has_diagram
FROM (SELECT *, p_partkey % 17 <> 0 AS ok FROM part) AS p""")
def _(v):
    rows = v.latex.join(v.part.selectExpr("p_partkey AS id", "CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS images"), "id")
    parsed = rows.select("id", "images", M.recover_json(F.col("response")).alias("json"))
    fields = M.metadata_columns(F.col("json"), F.col("images"))
    return parsed.select("id", fields["chapter"].alias("chapter"), fields["meta_subject"].alias("subject"),
                         fields["difficulty"].alias("difficulty"), F.array_join(fields["concepts"], ",").alias("concepts"),
                         fields["has_formula"].alias("has_formula"), fields["has_diagram"].alias("has_diagram"))


def _bank_parts(v):
    questions = cut_lineage(L.build_inline(v.cleaned_blocks))
    responses = questions.selectExpr("doc_id", "start_idx", """concat('{"chapter": "Chapter ', question_number % 5,
        '", "topic": "t', question_number, '", "difficulty": "hard", "concepts": ["a", "b"], "has_formula": "yes"}') AS response""")
    return questions, ingest.normalized_metadata(responses, questions)


@query("questions_with_metadata", INLINE_BUILT + """
SELECT doc_id, start_idx, question_number, answer, concat('Chapter ', question_number % 5) AS chapter, concat('t', question_number) AS topic,
  'hard' AS difficulty, true AS has_formula FROM built_inline""")
def _(v):
    questions, metadata = _bank_parts(v)
    return B.with_metadata(questions, metadata).select(
        "doc_id", "start_idx", "question_number", "answer", "chapter", "topic", "difficulty", "has_formula")


BANK_ROWS = INLINE_BUILT + """
SELECT doc_id AS ingestion_id, concat('upload ', doc_id, '.pdf') AS source_pdf, question_number, stem_md, answer, section_type,
  'JEE Main' AS exam_name, 'physics' AS subject, concat('Chapter ', question_number % 5) AS chapter, 'hard' AS difficulty, 'active' AS status,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    concat(stem_md, ' ', regexp_replace(regexp_replace(options, '^A=', ''), '\\|[BCD]=', ' ', 'g')),
    '(?s)\\$\\$.*?\\$\\$', ' ', 'g'), '\\$[^$]+\\$', ' ', 'g'), '[{}\\\\^_]', ' ', 'g'), '\\s+', ' ', 'g')) AS raw_text
FROM built_inline"""


@query("bank_rows", BANK_ROWS)
def _(v):
    questions, metadata = _bank_parts(v)
    uploads = v.events.selectExpr("user_id AS id").distinct().selectExpr(
        "id", "concat('upload ', id, '.pdf') AS filename", "'JEE Main' AS exam_name", "'physics' AS subject")
    rows = B.bank_rows(questions, metadata, uploads)
    return rows.select("ingestion_id", "source_pdf", "question_number", "stem_md", "answer", "section_type", "exam_name",
                       "subject", "chapter", "difficulty", "raw_text", "status")


@query("saved_bank", BANK_ROWS)
def _(v):
    """The partitioned bank after a batch, the same batch again, and a batch of a third of the documents once more."""
    listed = v.blk_inline.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        "block_idx", "type", "text", "text_level", "page_idx", "img_path"))).alias("blocks"))  # a content list is one file
    listed = cut_lineage(listed.withColumn("doc_id", F.col("doc_id").cast("string")))
    raw = listed.select("doc_id", F.to_json(F.transform("blocks", lambda b: b.dropFields("block_idx"))).alias("value"))
    number = F.regexp_extract("b.text", r"^(\d+)\. Find", 1)
    responses = listed.select("doc_id", F.posexplode("blocks").alias("at", "b")).filter(number != "").select(
        "doc_id", F.col("at").cast("long").alias("start_idx"),
        F.concat(F.lit('{"chapter": "Chapter '), number.cast("int") % 5, F.lit('", "difficulty": "hard"}')).alias("response"))
    uploads = listed.selectExpr("doc_id AS id", "concat('upload ', doc_id, '.pdf') AS filename", "'inline_answer' AS layout_type",
                                "'JEE Main' AS exam_name", "'physics' AS subject")
    path = new_folder(v.spark)
    for batch, part in ((0, raw), (0, raw), (1, raw.filter("CAST(doc_id AS BIGINT) % 3 = 0"))):
        ingest.save_documents(part, uploads, responses, path, batch)
    names = ["ingestion_id", "source_pdf", "question_number", "stem_md", "answer", "section_type", "exam_name", "subject", "chapter",
             "difficulty", "raw_text", "status"]
    kinds = {"question_number": IntegerType()}
    rows = sinks.read_bank(v.spark, path, StructType([StructField(n, kinds.get(n, StringType())) for n in names]))
    return rows.withColumn("ingestion_id", F.col("ingestion_id").cast("long"))
