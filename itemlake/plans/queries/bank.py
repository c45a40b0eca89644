"""Browsing, statistics, edits, lineage, deletes, ingestion records, syllabus."""

from pyspark.sql import functions as F

from itemlake import schemas
from itemlake.functions import text as X
from itemlake.operators import bank as B
from itemlake.operators import ingestions as I
from itemlake.operators import syllabus as Y
from itemlake.plans.queries import query

DOC_LIST = ("id, question_number, subject, chapter, topic, difficulty, question_type, has_diagram, "
            "has_formula, section_type, status, generation_type, parent_question_id")


@query("browse_filter", """
SELECT id, subject, chapter FROM q_docs WHERE status = 'active' AND subject = 'en' AND difficulty = 'medium'
  AND section_type = 'mcq' AND has_diagram = false AND raw_text ILIKE '%on%e%'""")
def _(v):
    return B.browse(v.q_docs, subject="en", chapter="", difficulty="medium", section_type="mcq",
                    has_diagram=False, search="on%e").select("id", "subject", "chapter")


@query("active_only", "SELECT id, status FROM q_docs WHERE status = 'active'")
def _(v):
    return B.active(v.q_docs).select("id", "status")


@query("question_list_page", f"""
SELECT {DOC_LIST} FROM q_docs WHERE status = 'active' AND exam_name = 'E1'
ORDER BY created_at DESC, id LIMIT 50 OFFSET 20""")
def _(v):
    return B.newest_page(B.browse(v.q_docs, exam_name="E1"), 20, 50).select(schemas.LIST_COLUMNS)


@query("question_detail", """
SELECT id, ingestion_id, question_number, stem_md, section_type, exam_name, subject, chapter, topic, subtopic,
  difficulty, question_type, has_diagram, has_formula, status, generation_type, parent_question_id
FROM q_docs""")
def _(v):
    return v.q_docs.select("id", "ingestion_id", "question_number", "stem_md", "section_type", "exam_name",
                           "subject", "chapter", "topic", "subtopic", "difficulty", "question_type",
                           "has_diagram", "has_formula", "status", "generation_type", "parent_question_id")


@query("paper_list_page", """
SELECT id, prompt, status, created_at FROM paps WHERE status = 'draft'
ORDER BY created_at DESC, id LIMIT 20 OFFSET 10""")
def _(v):
    return B.newest_page(B.by_status(v.papers, "draft"), 10, 20).select(schemas.PAPER_LIST_COLUMNS)


@query("latest_ingestions", """
SELECT id, filename, status, layout_type, created_at FROM ingestions ORDER BY created_at DESC, id LIMIT 50""")
def _(v):
    return B.newest_page(v.ingestions, 0, 50).select("id", "filename", "status", "layout_type", "created_at")


@query("ingestions_by_status", "SELECT id, status FROM ingestions WHERE status = 'FAILED'")
def _(v):
    return B.by_status(v.ingestions, "FAILED").select("id", "status")


@query("bank_statistics", """
WITH a AS (SELECT * FROM q_docs WHERE status = 'active')
SELECT 'total' AS facet, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM a
UNION ALL SELECT 'subject', subject, count(*) FROM a WHERE subject <> '' GROUP BY subject
UNION ALL SELECT 'difficulty', difficulty, count(*) FROM a WHERE difficulty <> '' GROUP BY difficulty
UNION ALL SELECT 'chapter', chapter, count(*) FROM a WHERE chapter <> '' GROUP BY chapter
UNION ALL SELECT 'section_type', section_type, count(*) FROM a GROUP BY section_type""")
def _(v):
    return B.bank_statistics(v.q_docs)


@query("incomplete_metadata", """
SELECT id, concat_ws(',', CASE WHEN coalesce(exam_name, '') = '' THEN 'Exam' END,
  CASE WHEN coalesce(subject, '') = '' THEN 'Subject' END, CASE WHEN coalesce(chapter, '') = '' THEN 'Chapter' END,
  CASE WHEN coalesce(topic, '') = '' THEN 'Topic' END, CASE WHEN coalesce(subtopic, '') = '' THEN 'Subtopic' END,
  CASE WHEN coalesce(difficulty, '') = '' THEN 'Difficulty' END,
  CASE WHEN coalesce(question_type, '') = '' THEN 'Type' END) AS missing
FROM q_docs WHERE coalesce(topic, '') = '' OR coalesce(subtopic, '') = '' OR coalesce(difficulty, '') = ''
  OR coalesce(question_type, '') = '' OR coalesce(chapter, '') = '' OR coalesce(subject, '') = ''""")
def _(v):
    return B.incomplete_metadata(v.q_docs).withColumn("missing", F.array_join("missing", ","))


@query("missing_metadata_by_subject", """
SELECT subject, count(*) FILTER (coalesce(exam_name, '') = '') AS missing_exam_name,
  count(*) FILTER (coalesce(chapter, '') = '') AS missing_chapter,
  count(*) FILTER (coalesce(topic, '') = '') AS missing_topic,
  count(*) FILTER (coalesce(subtopic, '') = '') AS missing_subtopic,
  count(*) FILTER (coalesce(difficulty, '') = '') AS missing_difficulty,
  count(*) FILTER (coalesce(question_type, '') = '') AS missing_question_type
FROM q_docs GROUP BY subject""")
def _(v):
    return B.missing_by_subject(v.q_docs)


@query("ingestion_status_counts", "SELECT status, count(*) AS n FROM ingestions GROUP BY status")
def _(v):
    return B.status_counts(v.ingestions)


@query("subject_totals", "SELECT coalesce(question_type, 'unknown') AS subject, count(*) AS n FROM q_docs GROUP BY 1")
def _(v):
    return B.subject_totals(v.q_docs.select(F.col("question_type").alias("subject")))


@query("ingestion_question_counts", """
SELECT i.id, any_value(i.status) AS status, count(q.id) AS n
FROM ingestions i LEFT JOIN q_docs q ON q.ingestion_id = i.id GROUP BY i.id""")
def _(v):
    return B.ingestion_counts(v.ingestions, v.q_docs)


# --- Edits -------------------------------------------------------------------------------

@query("metadata_patch", """
WITH p AS (SELECT doc_id AS id, quality, toxic FROM labels)
SELECT q.id, CASE WHEN p.quality = 1 THEN CASE WHEN p.toxic = 1 THEN NULL ELSE 'patched' END ELSE q.chapter END AS chapter,
  CASE WHEN p.quality = 0 THEN 'hard' ELSE q.difficulty END AS difficulty,
  CASE WHEN p.quality = 1 THEN true ELSE q.has_diagram END AS has_diagram, q.topic
FROM q_docs q LEFT JOIN p ON p.id = q.id""")
def _(v):
    patches = v.labels.selectExpr(
        "doc_id AS id", "CASE WHEN quality = 1 THEN array('chapter', 'has_diagram') ELSE array('difficulty') END AS set_fields",
        "CASE WHEN toxic = 0 THEN 'patched' END AS chapter", "'hard' AS difficulty", "true AS has_diagram",
        "'unused' AS topic")
    return B.patch_metadata(v.q_docs, patches).select("id", "chapter", "difficulty", "has_diagram", "topic")


CHANGES = "SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'flagged' WHEN quality = 0 THEN 'deleted' ELSE 'archived' END AS new_status FROM labels"


def _changes(v):
    return v.labels.selectExpr("doc_id AS id", "CASE WHEN toxic = 1 THEN 'flagged' WHEN quality = 0 THEN 'deleted' "
                               "ELSE 'archived' END AS new_status")


@query("status_change", f"""
WITH ch AS ({CHANGES})
SELECT q.id, coalesce(ch.new_status, q.status) AS status
FROM q_docs q LEFT JOIN ch ON ch.id = q.id AND ch.new_status IN ('active', 'archived', 'flagged')""")
def _(v):
    return B.change_status(v.q_docs, _changes(v)).select("id", "status")


@query("status_change_rejects", f"""
WITH ch AS ({CHANGES})
SELECT id, new_status, 'Status must be: active, archived, or flagged.' AS reason FROM ch WHERE new_status = 'deleted'""")
def _(v):
    return B.split_status_changes(_changes(v))[1]


@query("variant_lineage", """
SELECT p.id, count(*) AS variants FROM q_docs p JOIN q_docs c ON c.parent_question_id = p.id GROUP BY p.id""")
def _(v):
    return B.variant_counts(v.q_docs)


@query("save_variants", """
SELECT q.id AS parent_question_id, q.ingestion_id, CAST(NULL AS INT) AS question_number, concat(q.stem_md, ' again') AS stem_md,
  'B' AS answer, q.exam_name, q.subject, q.chapter, q.difficulty, q.section_type, q.question_type, false AS has_diagram,
  contains(q.stem_md, '$') OR contains(q.stem_md, '\\frac') AS has_formula, 'ai_regenerated' AS generation_type,
  'active' AS status, CAST(NULL AS VARCHAR) AS raw_text, 0 AS image_count
FROM q_parts q WHERE q.question_number < 10""")
def _(v):
    drafts = v.q_parts.filter("question_number < 10").selectExpr(
        "id AS parent_id", "concat(stem_md, ' again') AS stem_md", "map('A', 'x', 'B', 'y') AS options", "'B' AS answer")
    saved = B.save_variants(drafts, v.questions)
    return saved.select("parent_question_id", "ingestion_id", "question_number", "stem_md", "answer", "exam_name",
                        "subject", "chapter", "difficulty", "section_type", "question_type", "has_diagram",
                        "has_formula", "generation_type", "status", "raw_text", F.size("images").alias("image_count"))


# --- Deletes ------------------------------------------------------------------------------

LAST_LINE = "line = 7 AND flag = 'R' AND linestatus = 'O'"


@query("delete_questions", """
WITH req AS (SELECT id FROM q_docs WHERE difficulty = 'hard'),
used AS (SELECT question_id FROM pq0 WHERE line = 7 AND flag = 'R' AND linestatus = 'O'),
gone AS (SELECT id FROM req WHERE id NOT IN (SELECT question_id FROM used))
SELECT id, CASE WHEN parent_question_id IN (SELECT id FROM gone) THEN NULL ELSE parent_question_id END AS parent_question_id
FROM q_docs WHERE id NOT IN (SELECT id FROM gone)""")
def _(v):
    asked = v.q_docs.filter("difficulty = 'hard'").select("id")
    return B.delete_questions(v.q_docs, asked, v.pq0.filter(LAST_LINE)).select("id", "parent_question_id")


@query("delete_blocked", """
SELECT DISTINCT id FROM q_docs WHERE difficulty = 'hard'
  AND id IN (SELECT question_id FROM pq0 WHERE line = 7 AND flag = 'R' AND linestatus = 'O')""")
def _(v):
    return B.deletable(v.q_docs.filter("difficulty = 'hard'").select("id"), v.pq0.filter(LAST_LINE))[1]


DELETE_ING = """
WITH req AS (SELECT id FROM ingestions WHERE status = 'FAILED'),
used AS (SELECT question_id FROM pq0 WHERE question_id % 50 > 25),
blocked AS (SELECT DISTINCT q.ingestion_id AS id FROM q_docs q WHERE q.ingestion_id IN (SELECT id FROM req)
            AND q.id IN (SELECT question_id FROM used)),
gone AS (SELECT id FROM req WHERE id NOT IN (SELECT id FROM blocked))
"""


def _delete_ingestions(v):
    asked = v.ingestions.filter("status = 'FAILED'").select("id")
    return B.delete_ingestions(v.ingestions, v.q_docs, v.pq0.filter("question_id % 50 > 25"), asked)


@query("delete_ingestions", DELETE_ING + "SELECT id, status FROM ingestions WHERE id NOT IN (SELECT id FROM gone)")
def _(v):
    return _delete_ingestions(v)[0].select("id", "status")


@query("delete_ingestions_cascade", DELETE_ING + """
SELECT id, ingestion_id FROM q_docs WHERE ingestion_id NOT IN (SELECT id FROM gone)""")
def _(v):
    return _delete_ingestions(v)[1].select("id", "ingestion_id")


# --- Ingestion records ------------------------------------------------------------------------

@query("upload_normalization", """
SELECT id, CASE exam_raw WHEN ' jee mains ' THEN 'JEE Main' WHEN 'NEET UG 2025' THEN 'NEET'
    WHEN 'JEE Main 2024 April' THEN 'JEE Main' WHEN 'Olympiad' THEN 'Olympiad' END AS exam_name,
  CASE subject_raw WHEN 'Maths' THEN 'mathematics' WHEN ' PHY ' THEN 'physics' WHEN 'Zoology' THEN 'zoology' END AS subject,
  'UPLOADED' AS status FROM ingestions""")
def _(v):
    raw = v.ingestions.withColumnsRenamed({"exam_raw": "exam_name", "subject_raw": "subject"})
    return I.normalize_uploads(raw).select("id", "exam_name", "subject", "status")


@query("allowed_subjects", """
SELECT id, subject, exam_name, CASE WHEN exam_name = 'JEE Main' THEN subject IN ('physics', 'chemistry', 'mathematics')
  WHEN exam_name = 'NEET' THEN subject IN ('physics', 'chemistry', 'biology')
  ELSE subject IN ('physics', 'chemistry', 'mathematics', 'biology', 'english', 'hindi') END AS allowed
FROM (SELECT id, CASE exam_raw WHEN ' jee mains ' THEN 'JEE Main' WHEN 'NEET UG 2025' THEN 'NEET'
    WHEN 'JEE Main 2024 April' THEN 'JEE Main' WHEN 'Olympiad' THEN 'Olympiad' END AS exam_name,
  CASE subject_raw WHEN 'Maths' THEN 'mathematics' WHEN ' PHY ' THEN 'physics' WHEN 'Zoology' THEN 'zoology' END AS subject
  FROM ingestions) AS n""")
def _(v):
    from itemlake.functions.names import subject_allowed
    raw = v.ingestions.withColumnsRenamed({"exam_raw": "exam_name", "subject_raw": "subject"})
    named = I.normalize_uploads(raw)
    exam = F.coalesce("exam_name", F.lit(""))
    return named.select("id", "subject", "exam_name", subject_allowed(exam, F.col("subject")).alias("allowed"))


@query("ingestion_transitions", """
SELECT ingestion_id, seq, status, before,
  coalesce(CASE WHEN before IS NULL THEN status = 'UPLOADED' WHEN before = 'FAILED' THEN status = 'UPLOADED'
    WHEN status = 'FAILED' THEN true
    ELSE (before, status) IN (('UPLOADED', 'MINERU_COMPLETE'), ('MINERU_COMPLETE', 'QUESTIONS_BUILT'),
      ('QUESTIONS_BUILT', 'METADATA_COMPLETE'), ('METADATA_COMPLETE', 'SAVED')) END, false) AS legal
FROM (SELECT *, lag(status) OVER (PARTITION BY ingestion_id ORDER BY seq) AS before FROM ing) AS e""")
def _(v):
    return I.check_transitions(v.ing).select("ingestion_id", "seq", "status", "before", "legal")


LATEST = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY ingestion_id ORDER BY seq DESC) AS rn FROM ing),
reached AS (SELECT ingestion_id, arg_max(status, seq) AS stage FROM ing WHERE status <> 'FAILED' GROUP BY ingestion_id),
latest AS (SELECT r.ingestion_id, r.seq, r.status, CASE WHEN r.status = 'FAILED' THEN reached.stage END AS failed_at_stage,
  CASE WHEN r.status = 'FAILED' THEN left(r.error, 2000) END AS error_message
  FROM r LEFT JOIN reached USING (ingestion_id) WHERE rn = 1)
"""


@query("ingestion_status_board", LATEST + "SELECT * FROM latest")
def _(v):
    return I.latest_status(v.ing)


@query("retry_failed", LATEST + """
SELECT ingestion_id, seq, CASE WHEN status = 'FAILED' AND ingestion_id % 3 = 0 THEN 'UPLOADED' ELSE status END AS status,
  CASE WHEN ingestion_id % 3 <> 0 THEN failed_at_stage END AS failed_at_stage,
  CASE WHEN ingestion_id % 3 <> 0 THEN error_message END AS error_message FROM latest""")
def _(v):
    latest = I.latest_status(v.ing)
    return I.retry(latest, latest.filter("ingestion_id % 3 = 0"))[0]


@query("retry_rejects", LATEST + """
SELECT ingestion_id, concat('Can only retry FAILED ingestions. Current: ', status) AS reason
FROM latest WHERE ingestion_id % 3 = 0 AND status <> 'FAILED'""")
def _(v):
    latest = I.latest_status(v.ing)
    return I.retry(latest, latest.filter("ingestion_id % 3 = 0"))[1]


@query("error_truncation", "SELECT doc_id, left(text, 2000) AS error FROM documents")
def _(v):
    return v.documents.select("doc_id", X.error_text(F.col("text")).alias("error"))


# --- Syllabus --------------------------------------------------------------------------------------

@query("syllabus_flatten", """
SELECT concat('E', p_partkey) AS exam_name, p_type AS subject, w AS chapter_name, CAST(i AS INT) AS chapter_order,
  concat(w, '!') AS alias
FROM (SELECT p_partkey, p_type, unnest(split(p_name, ' ')) AS w, generate_subscripts(split(p_name, ' '), 1) AS i FROM part) AS s""")
def _(v):
    seed = v.part.selectExpr(
        "concat('E', p_partkey) AS exam_name", "p_type AS subject",
        "transform(split(p_name, ' '), w -> named_struct('chapter_name', w, 'chapter_aliases', array(concat(w, '!')))) AS chapters")
    return Y.flatten_seed(seed).select("exam_name", "subject", "chapter_name", "chapter_order",
                                       F.col("chapter_aliases")[0].alias("alias"))


@query("syllabus_partitions", "SELECT exam_name, subject, count(*) AS chapter_count FROM syl GROUP BY ALL")
def _(v):
    return Y.partition_counts(v.syllabus)


@query("syllabus_listing", """
SELECT chapter_order, chapter_name, alias FROM syl WHERE exam_name = 'E1' AND subject = 'promo' ORDER BY 1""")
def _(v):
    return Y.list_chapters(v.syllabus, "E1", "promo").select(
        "chapter_order", "chapter_name", F.col("chapter_aliases")[0].alias("alias"))


@query("syllabus_upsert", """
WITH ch AS (SELECT exam_name, subject, chapter_order + 20 AS chapter_order, concat('New ', chapter_name) AS chapter_name,
  concat('n', alias) AS alias FROM syl WHERE subject <> 'large')
SELECT coalesce(s.exam_name, c.exam_name) AS exam_name, coalesce(s.subject, c.subject) AS subject,
  coalesce(s.chapter_order, c.chapter_order) AS chapter_order, coalesce(c.chapter_name, s.chapter_name) AS chapter_name,
  coalesce(c.alias, s.alias) AS alias,
  CASE WHEN c.chapter_name IS NULL THEN 'kept' WHEN s.chapter_name IS NULL THEN 'created' ELSE 'updated' END AS action
FROM syl s FULL JOIN ch c ON s.exam_name = c.exam_name AND s.subject = c.subject AND s.chapter_order = c.chapter_order""")
def _(v):
    changes = v.syllabus.filter("subject <> 'large'").selectExpr(
        "exam_name", "subject", "chapter_order + 20 AS chapter_order", "concat('New ', chapter_name) AS chapter_name",
        "transform(chapter_aliases, a -> concat('n', a)) AS chapter_aliases")
    return Y.upsert(v.syllabus, changes).select(
        "exam_name", "subject", "chapter_order", "chapter_name", F.col("chapter_aliases")[0].alias("alias"), "action")


@query("syllabus_uniqueness", """
SELECT 'name' AS rule, concat('E', p_partkey % 2) AS exam_name, p_type AS subject, p_brand AS key, count(*) AS n
FROM part GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'order', concat('E', p_partkey % 2), p_type, CAST(p_size AS VARCHAR), count(*)
FROM part GROUP BY ALL HAVING count(*) > 1""")
def _(v):
    loose = v.part.selectExpr("concat('E', p_partkey % 2) AS exam_name", "p_type AS subject",
                              "p_size AS chapter_order", "p_brand AS chapter_name")
    return Y.uniqueness_violations(loose)


@query("canonical_chapters", """
SELECT q.id, coalesce(e.chapter_name, a.chapter_name, q.chapter) AS chapter
FROM (SELECT id, exam_name, subject, CASE WHEN id % 3 = 0 THEN lower(replace(chapter, '#', ' ')) ELSE chapter END AS chapter
      FROM q_parts) q
LEFT JOIN syl e ON e.exam_name = q.exam_name AND e.subject = q.subject AND lower(e.chapter_name) = lower(q.chapter)
LEFT JOIN syl a ON a.exam_name = q.exam_name AND a.subject = q.subject AND lower(a.alias) = lower(q.chapter)""")
def _(v):
    noisy = v.q_parts.selectExpr("id", "exam_name", "subject",
                                 "CASE WHEN id % 3 = 0 THEN lower(replace(chapter, '#', ' ')) ELSE chapter END AS chapter")
    return Y.canonical_chapters(noisy, v.syllabus).select("id", "chapter")
