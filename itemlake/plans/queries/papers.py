"""Papers: reading, shuffling, edits, alternatives, export."""

from pyspark.sql import functions as F

from itemlake.operators import export as E
from itemlake.operators import papers as P
from itemlake.operators import select as S
from itemlake.plans.queries import query
from itemlake.plans.queries.requests import POOL, SHUFFLE_KEYS, shuffled_places
from itemlake.session import new_folder
from itemlake.sources.sinks import append_questions, read_documents, write_documents, write_markdown

ROWS = "paper_id, question_id, position, paper_section, display_number, locked"


@query("paper_detail", """
SELECT p.id AS paper_id, p.status, pq.position, pq.paper_section, pq.locked, pq.question_id, q.chapter, q.difficulty,
  q.question_type, q.section_type
FROM paps p LEFT JOIN pq ON pq.paper_id = p.id LEFT JOIN q_parts q ON q.id = pq.question_id""")
def _(v):
    return P.paper_detail(v.papers, v.paper_rows, v.questions).drop("created_at", "display_number")


@query("paper_progress", """
SELECT paper_id, count(*) AS total, count(*) FILTER (locked) AS locked, count(*) FILTER (NOT locked) AS pending,
  count(*) FILTER (NOT locked) = 0 AS all_done FROM pq GROUP BY paper_id""")
def _(v):
    return P.progress(v.paper_rows)


@query("section_changes", """
SELECT paper_id, position, paper_section,
  CASE WHEN position = 1 THEN paper_section IS NOT NULL
    ELSE lag(paper_section) OVER (PARTITION BY paper_id ORDER BY position) IS DISTINCT FROM paper_section END AS section_starts
FROM pq""")
def _(v):
    return P.section_changes(v.paper_rows).select("paper_id", "position", "paper_section", "section_starts")


@query("renumber_positions", """
SELECT paper_id, question_id, position, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY position) AS INT) AS display_number
FROM (SELECT paper_id, question_id, position * 3 AS position FROM pq WHERE NOT locked) AS p""")
def _(v):
    loose = v.paper_rows.filter("NOT locked").withColumn("position", (F.col("position") * 3).cast("int"))
    return P.renumber(loose).select("paper_id", "question_id", "position", "display_number")


@query("shuffle_papers", f"""
WITH d AS (SELECT pq.* FROM pq JOIN paps p ON p.id = pq.paper_id WHERE p.status <> 'approved'),
loose AS (SELECT * FROM d WHERE NOT locked AND paper_section IN ('Section A', 'Section B')),
free AS (SELECT paper_id, paper_section, position, row_number() OVER (PARTITION BY paper_id, paper_section ORDER BY position) AS k FROM loose),
mixed AS (SELECT paper_id, paper_section, question_id, row_number() OVER (PARTITION BY paper_id, paper_section
    ORDER BY md5(concat_ws(':', paper_id + 5, question_id)), question_id) AS k FROM loose),
moved AS (SELECT m.paper_id, m.question_id, f.position FROM mixed m JOIN free f USING (paper_id, paper_section, k)),
placed AS (SELECT pq.paper_id, pq.question_id, coalesce(m.position, pq.position) AS position, pq.paper_section, pq.display_number, pq.locked
  FROM pq LEFT JOIN moved m ON m.paper_id = pq.paper_id AND m.question_id = pq.question_id)
SELECT paper_id, question_id, position, paper_section, locked,
  CAST(row_number() OVER (PARTITION BY paper_id ORDER BY position) AS INT) AS display_number FROM placed""")
def _(v):
    return P.shuffle(v.papers, v.paper_rows, F.col("paper_id") + 5)[0]


@query("shuffle_rejects", """
SELECT id AS paper_id, 'Cannot shuffle an approved paper.' AS reason FROM paps WHERE status = 'approved'""")
def _(v):
    return P.shuffle(v.papers, v.paper_rows, F.col("paper_id"))[1]


# --- Edits ---------------------------------------------------------------------------------

SWAPS = """
WITH ed AS (SELECT paper_id, question_id, CASE WHEN position = 2 THEN question_id + 1000000000 ELSE (question_id * 13 + 7) % 1000 END AS new_question_id
  FROM pq WHERE locked AND position <= 2),
checked AS (SELECT ed.*, CASE WHEN p.status = 'approved' THEN 'Cannot edit an approved paper.'
    WHEN ed.new_question_id NOT IN (SELECT id FROM q_parts) THEN 'Question not found.'
    WHEN EXISTS (SELECT 1 FROM pq x WHERE x.paper_id = ed.paper_id AND x.question_id = ed.new_question_id)
      THEN 'This question is already in the paper.' END AS reason
  FROM ed JOIN paps p ON p.id = ed.paper_id)
"""


def _swaps(v):
    edits = v.paper_rows.filter("locked AND position <= 2").selectExpr(
        "paper_id", "question_id",
        "CASE WHEN position = 2 THEN question_id + 1000000000 ELSE (question_id * 13 + 7) % 1000 END AS new_question_id")
    return P.swap(v.papers, v.paper_rows, edits, v.questions)


@query("swap_questions", SWAPS + """
SELECT pq.paper_id, coalesce(j.new_question_id, pq.question_id) AS question_id, pq.position, pq.paper_section, pq.display_number, pq.locked
FROM pq LEFT JOIN checked j ON j.paper_id = pq.paper_id AND j.question_id = pq.question_id AND j.reason IS NULL""")
def _(v):
    return _swaps(v)[0]


@query("swap_rejects", SWAPS + "SELECT * FROM checked WHERE reason IS NOT NULL")
def _(v):
    return _swaps(v)[1]


REMOVALS = """
WITH gone AS (SELECT pq.paper_id, pq.question_id FROM pq JOIN paps p ON p.id = pq.paper_id
  WHERE pq.paper_section = 'Section B' AND p.status <> 'approved')
"""


@query("remove_questions", REMOVALS + """
SELECT paper_id, question_id, CAST(position - before AS INT) AS position, paper_section,
  CAST(position - before AS INT) AS display_number, locked
FROM (SELECT pq.*, g.question_id IS NOT NULL AS is_gone, count(g.question_id) OVER (PARTITION BY pq.paper_id ORDER BY pq.position) AS before
      FROM pq LEFT JOIN gone g ON g.paper_id = pq.paper_id AND g.question_id = pq.question_id) AS w
WHERE NOT is_gone""")
def _(v):
    return P.remove(v.papers, v.paper_rows, v.paper_rows.filter("paper_section = 'Section B'"))[0]


@query("remove_rejects", """
SELECT pq.paper_id, pq.question_id, 'Cannot edit an approved paper.' AS reason
FROM pq JOIN paps p ON p.id = pq.paper_id WHERE pq.paper_section = 'Section B' AND p.status = 'approved'""")
def _(v):
    return P.remove(v.papers, v.paper_rows, v.paper_rows.filter("paper_section = 'Section B'"))[1]


ADDS = """
WITH ed AS (SELECT o_orderkey AS paper_id, (o_orderkey * 7 + k.k) % 1500 AS question_id,
    CAST(CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 2 WHEN 2 THEN 50 ELSE 0 END AS INT) AS position,
    CASE WHEN o_orderkey % 5 = 0 THEN 'Section C' END AS paper_section, k.k AS edit_seq
  FROM orders CROSS JOIN (SELECT unnest([1, 2]) AS k) AS k),
checked AS (SELECT ed.*, q.section_type, CASE WHEN p.status = 'approved' THEN 'Cannot edit an approved paper.'
    WHEN q.id IS NULL THEN 'Question not found.'
    WHEN x.question_id IS NOT NULL THEN 'This question is already in the paper.' END AS reason
  FROM ed JOIN paps p ON p.id = ed.paper_id LEFT JOIN q_parts q ON q.id = ed.question_id
  LEFT JOIN pq x ON x.paper_id = ed.paper_id AND x.question_id = ed.question_id),
now AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY edit_seq) AS rn FROM checked WHERE reason IS NULL),
ends AS (SELECT paper_id, max(position) AS e FROM pq GROUP BY paper_id),
placed AS (SELECT n.*, least(coalesce(nullif(n.position, 0), coalesce(e, 0) + 1), coalesce(e, 0) + 1) AS spot
  FROM now n LEFT JOIN ends USING (paper_id) WHERE rn = 1)
"""


def _adds(v):
    edits = v.orders.selectExpr("o_orderkey", "explode(array(1, 2)) AS k").selectExpr(
        "o_orderkey AS paper_id", "(o_orderkey * 7 + k) % 1500 AS question_id",
        "CASE o_orderkey % 4 WHEN 1 THEN 2 WHEN 2 THEN 50 WHEN 3 THEN 0 END AS position",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'Section C' END AS paper_section", "k AS edit_seq")
    return P.add(v.papers, v.paper_rows, edits, v.questions)


@query("add_questions", ADDS + """
SELECT pq.paper_id, pq.question_id, CAST(CASE WHEN pq.position >= a.spot THEN pq.position + 1 ELSE pq.position END AS INT) AS position,
  pq.paper_section, CAST(CASE WHEN pq.position >= a.spot THEN pq.position + 1 ELSE pq.position END AS INT) AS display_number, pq.locked
FROM pq LEFT JOIN placed a ON a.paper_id = pq.paper_id
UNION ALL SELECT paper_id, question_id, CAST(spot AS INT), coalesce(paper_section,
  CASE WHEN section_type = 'mcq' THEN 'Section A' ELSE 'Section B' END), CAST(spot AS INT), false FROM placed""")
def _(v):
    return _adds(v)[0]


@query("add_rejects", ADDS + "SELECT paper_id, question_id, position, paper_section, edit_seq, reason FROM checked WHERE reason IS NOT NULL")
def _(v):
    return _adds(v)[1]


@query("add_deferred", ADDS + "SELECT paper_id, question_id, position, paper_section, edit_seq FROM now WHERE rn > 1")
def _(v):
    return _adds(v)[2]


#: One by one: the list of a paper's questions, and an edit put into it at each step.
ADDED = """
WITH RECURSIVE ed AS (SELECT o_orderkey AS paper_id, (o_orderkey * 7 + k.k * k.k) % 1500 AS question_id,
    CAST(CASE (o_orderkey + k.k) % 5 WHEN 0 THEN NULL WHEN 1 THEN 2 WHEN 2 THEN 50 WHEN 3 THEN 1 ELSE 3 END AS INT) AS position, 40 - k.k AS edit_seq
  FROM orders CROSS JOIN (SELECT unnest(range(6)) AS k) AS k WHERE o_orderkey % 3 = 0),
weighed AS (SELECT ed.*, q.section_type, CASE WHEN p.status = 'approved' THEN 'Cannot edit an approved paper.'
    WHEN q.id IS NULL THEN 'Question not found.'
    WHEN x.question_id IS NOT NULL THEN 'This question is already in the paper.' END AS reason
  FROM ed JOIN paps p ON p.id = ed.paper_id LEFT JOIN q_parts q ON q.id = ed.question_id
  LEFT JOIN pq x ON x.paper_id = ed.paper_id AND x.question_id = ed.question_id),
nth AS (SELECT *, row_number() OVER (PARTITION BY paper_id, question_id ORDER BY edit_seq) AS nth FROM weighed WHERE reason IS NULL),
steps AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY edit_seq, question_id) AS step FROM nth WHERE nth = 1),
lists AS (SELECT paper_id, list(question_id ORDER BY position) AS ids FROM pq GROUP BY paper_id),
grown AS (SELECT p.id AS paper_id, CAST(0 AS BIGINT) AS step, coalesce(l.ids, []) AS ids FROM paps p LEFT JOIN lists l ON l.paper_id = p.id
    WHERE p.id IN (SELECT paper_id FROM steps)
  UNION ALL SELECT g.paper_id, s.step, CASE WHEN s.position > 0 AND s.position <= len(g.ids)
      THEN g.ids[1:s.position - 1] || [s.question_id] || g.ids[s.position:] ELSE g.ids || [s.question_id] END
    FROM grown g JOIN steps s ON s.paper_id = g.paper_id AND s.step = g.step + 1),
ended AS (SELECT paper_id, arg_max(ids, step) AS ids FROM grown GROUP BY paper_id),
spots AS (SELECT paper_id, unnest(ids) AS question_id, unnest(range(1, len(ids) + 1)) AS spot FROM ended)
"""


def _added(v):
    edits = v.orders.filter("o_orderkey % 3 = 0").selectExpr("o_orderkey", "explode(sequence(0, 5)) AS k").selectExpr(
        "o_orderkey AS paper_id", "(o_orderkey * 7 + k * k) % 1500 AS question_id",
        "CASE (o_orderkey + k) % 5 WHEN 1 THEN 2 WHEN 2 THEN 50 WHEN 3 THEN 1 WHEN 4 THEN 3 END AS position",
        "cast(NULL AS string) AS paper_section", "40 - k AS edit_seq")
    return P.add_batch(v.papers, v.paper_rows, edits, v.questions)


@query("add_batches", ADDED + """
SELECT pq.paper_id, pq.question_id, CAST(coalesce(s.spot, pq.position) AS INT) AS position, pq.paper_section, pq.locked
FROM pq LEFT JOIN spots s ON s.paper_id = pq.paper_id AND s.question_id = pq.question_id
UNION ALL SELECT s.paper_id, s.question_id, CAST(s.spot AS INT), CASE WHEN t.section_type = 'mcq' THEN 'Section A' ELSE 'Section B' END, false
FROM spots s JOIN steps t ON t.paper_id = s.paper_id AND t.question_id = s.question_id""")
def _(v):
    return _added(v)[0].drop("display_number")


@query("add_batch_rejects", ADDED + """
SELECT paper_id, question_id, position, edit_seq, reason FROM weighed WHERE reason IS NOT NULL
UNION ALL SELECT paper_id, question_id, position, edit_seq, 'This question is already in the paper.' FROM nth WHERE nth > 1""")
def _(v):
    return _added(v)[1].drop("paper_section")


@query("membership_guard", """
SELECT pq.paper_id, pq.question_id, 'This question is already in the paper.' AS reason
FROM pq JOIN orders o ON o.o_orderkey = pq.paper_id AND o.o_custkey = pq.question_id""")
def _(v):
    edits = v.orders.selectExpr("o_orderkey AS paper_id", "o_custkey AS question_id")
    return P.membership_rejects(edits, v.paper_rows)


@query("toggle_locks", """
SELECT pq.paper_id, pq.question_id, pq.position, pq.paper_section, pq.display_number,
  CASE WHEN p.status <> 'approved' AND pq.paper_section = 'Section A' THEN NOT pq.locked ELSE pq.locked END AS locked
FROM pq JOIN paps p ON p.id = pq.paper_id""")
def _(v):
    return P.toggle_locks(v.papers, v.paper_rows, v.paper_rows.filter("paper_section = 'Section A'"))[0]


@query("approve_papers", """
SELECT id, CASE WHEN prompt LIKE '%URGENT%' THEN 'approved' ELSE status END AS status,
  CASE WHEN prompt LIKE '%URGENT%' AND status = 'draft' AND created_at < TIMESTAMP '1997-01-01 00:00:00' THEN 'old' ELSE notes END AS notes
FROM paps""")
def _(v):
    edits = v.papers.filter("prompt LIKE '%URGENT%'").selectExpr(
        "id AS paper_id", "CASE WHEN created_at < TIMESTAMP_NTZ '1997-01-01 00:00:00' THEN 'old' ELSE '' END AS notes")
    return P.approve(v.papers, edits)[0].select("id", "status", "notes")


@query("approve_rejects", """
SELECT id AS paper_id, 'Paper is already approved.' AS reason FROM paps WHERE prompt LIKE '%URGENT%' AND status = 'approved'""")
def _(v):
    edits = v.papers.filter("prompt LIKE '%URGENT%'").selectExpr("id AS paper_id", "'' AS notes")
    return P.approve(v.papers, edits)[1]


@query("delete_papers", """
SELECT pq.* FROM pq JOIN paps p ON p.id = pq.paper_id WHERE p.prompt NOT LIKE '%LOW%'""")
def _(v):
    return P.delete_papers(v.papers, v.paper_rows, v.papers.filter("prompt LIKE '%LOW%'").select("id"))[1]


def _regeneration(v):
    """Draft papers of two customers' segments, drawn anew from their stored blueprint."""
    asked = v.papers.select(F.col("id").alias("paper_id"), (F.col("id") * 11 + 3).alias("seed"))
    drafts = asked.join(v.papers.filter("status = 'draft'").select(F.col("id").alias("paper_id"), "blueprint"), "paper_id")
    blueprints = drafts.selectExpr(
        "paper_id AS request_id", "blueprint.exam_name AS exam_name", "blueprint.subject AS subject",
        "CASE WHEN paper_id % 3 = 0 THEN array('Brand#99') ELSE array('Brand#1', 'Brand#2', 'Brand#3') END AS chapters",
        "3 AS section_a_count", "0 AS section_b_count",
        "array(named_struct('tier', 'easy', 'frac', 0.2D), named_struct('tier', 'medium', 'frac', 0.5D), "
        "named_struct('tier', 'hard', 'frac', 0.3D)) AS split", "seed")
    chosen = S.select_for_blueprints(blueprints, v.questions).withColumnRenamed("request_id", "paper_id")
    return P.regenerate(v.papers, v.paper_rows, asked, chosen)


@query("regenerate_papers", """
WITH RECURSIVE bp AS (SELECT id AS request_id, concat('E', custkey % 2) AS exam_name, CASE WHEN id % 3 = 0 THEN ['Brand#99']
    ELSE ['Brand#1', 'Brand#2', 'Brand#3'] END AS chapters, id * 11 + 3 AS seed FROM paps WHERE status = 'draft'),
asked AS (SELECT request_id, 'A' AS label, 3 AS count, seed FROM bp),
mine AS (SELECT b.request_id, 'A' AS label, q.* FROM bp b JOIN q_parts q ON q.subject = 'small' AND q.section_type = 'mcq'
  AND q.status = 'active' AND q.exam_name = b.exam_name AND list_contains(b.chapters, q.chapter)),
split AS (SELECT request_id, label, unnest(['easy', 'medium', 'hard']) AS tier, unnest([1, 2, 3]) AS ord,
  unnest([0.2::DOUBLE, 0.5::DOUBLE, 0.3::DOUBLE]) AS frac FROM asked),
""" + POOL.replace("{source}", "mine") + """
SELECT pq.* FROM pq WHERE paper_id NOT IN (SELECT request_id FROM chosen)
UNION ALL SELECT request_id, id, CAST(pos AS INT), 'Section A', CAST(pos AS INT), false
FROM (SELECT c.request_id, c.id, row_number() OVER (PARTITION BY c.request_id ORDER BY list_position(b.chapters, c.chapter), c.id) AS pos
  FROM chosen c JOIN bp b USING (request_id)) AS n""")
def _(v):
    return _regeneration(v)[1]


@query("regenerate_blueprints", """
WITH have AS (SELECT DISTINCT exam_name FROM q_parts WHERE status = 'active' AND section_type = 'mcq' AND subject = 'small'
  AND chapter IN ('Brand#1', 'Brand#2', 'Brand#3'))
SELECT id, CASE WHEN status = 'draft' AND id % 3 <> 0 AND concat('E', custkey % 2) IN (SELECT exam_name FROM have)
  THEN id * 11 + 3 ELSE id * 7 END AS seed FROM paps""")
def _(v):
    return _regeneration(v)[0].select("id", "blueprint.seed")


# --- Alternatives --------------------------------------------------------------------------

@query("alternative_counts", """
WITH r AS (SELECT pq.paper_id, pq.question_id, q.subject, q.chapter, q.section_type, q.difficulty
  FROM pq JOIN q_parts q ON q.id = pq.question_id)
SELECT r.paper_id, r.question_id, least(3, count(a.id)) AS n
FROM r JOIN q_parts a ON a.status = 'active' AND a.subject = r.subject AND a.chapter IS NOT DISTINCT FROM r.chapter
  AND a.section_type = r.section_type AND (r.difficulty IS NULL OR a.difficulty = r.difficulty)
LEFT JOIN pq x ON x.paper_id = r.paper_id AND x.question_id = a.id
WHERE x.question_id IS NULL GROUP BY r.paper_id, r.question_id""")
def _(v):
    found = P.alternatives(v.paper_rows, v.questions, F.col("paper_id"))
    return found.groupBy("paper_id", "question_id").agg(F.count(F.lit(1)).alias("n"))


@query("question_alternatives", """
WITH RECURSIVE r AS (SELECT pq.paper_id, pq.question_id, q.subject, q.chapter, q.section_type, q.difficulty
  FROM pq JOIN q_parts q ON q.id = pq.question_id),
free AS (SELECT r.paper_id, r.question_id, a.id, count(*) OVER w AS n,
    row_number() OVER (PARTITION BY r.paper_id, r.question_id ORDER BY md5(CAST(a.id AS VARCHAR)), a.id) - 1 AS at
  FROM r JOIN q_parts a ON a.status = 'active' AND a.subject = r.subject AND a.chapter IS NOT DISTINCT FROM r.chapter
    AND a.section_type = r.section_type AND (r.difficulty IS NULL OR a.difficulty = r.difficulty)
  LEFT JOIN pq x ON x.paper_id = r.paper_id AND x.question_id = a.id
  WHERE x.question_id IS NULL WINDOW w AS (PARTITION BY r.paper_id, r.question_id)),
keyed AS (SELECT *, """ + SHUFFLE_KEYS + """ FROM (
    SELECT DISTINCT paper_id, question_id, n, md5(concat_ws(':', paper_id, question_id)) AS d FROM free)),
stops AS (SELECT *, unnest(range(CAST(least(n, 3) AS BIGINT))) AS i FROM keyed),
""" + shuffled_places("paper_id, question_id, i") + """
SELECT g.paper_id, g.question_id, CAST(g.i + 1 AS INT) AS rank, f.id AS alternative_id
FROM g JOIN free f ON f.paper_id = g.paper_id AND f.question_id = g.question_id AND f.at = g.at""")
def _(v):
    return P.alternatives(v.paper_rows, v.questions, F.col("paper_id"))


# --- Export -----------------------------------------------------------------------------------

LINES = """
WITH m AS (SELECT pq.*, q.stem_md, q.section_type, q.opt_a, q.opt_b, q.opt_c, q.figure,
    CASE WHEN position = 1 THEN paper_section IS NOT NULL
      ELSE lag(paper_section) OVER (PARTITION BY paper_id ORDER BY position) IS DISTINCT FROM paper_section END AS starts
  FROM pq JOIN paps p ON p.id = pq.paper_id AND p.status = 'approved' JOIN q_parts q ON q.id = pq.question_id),
lines AS (SELECT paper_id, position, concat(
    CASE WHEN starts THEN concat(chr(10), '## ', coalesce(paper_section, 'None'), chr(10), chr(10)) ELSE '' END,
    '**Q', display_number, '.** ', stem_md, chr(10),
    CASE WHEN section_type = 'mcq' THEN concat(chr(10), '(A) ', opt_a, '  ', chr(10), '(B) ', opt_b, '  ', chr(10),
      '(C) ', opt_c, '  ', chr(10)) ELSE '' END,
    CASE WHEN figure IS NOT NULL THEN concat(chr(10), '![diagram](images/', figure, ')', chr(10)) ELSE '' END) AS markdown FROM m)
"""


@query("export_lines", LINES + "SELECT * FROM lines")
def _(v):
    return E.markdown_lines(v.papers, v.paper_rows, v.questions)


@query("export_markdown", LINES + """
SELECT paper_id, CAST(0 AS INT) AS part, string_agg(markdown, chr(10) ORDER BY position) AS markdown FROM lines GROUP BY paper_id""")
def _(v):
    return E.in_parts(E.markdown_lines(v.papers, v.paper_rows, v.questions))


@query("export_documents", LINES + """
SELECT paper_id, string_agg(markdown, chr(10) ORDER BY position) AS markdown FROM lines GROUP BY paper_id""")
def _(v):
    return E.documents(E.markdown_lines(v.papers, v.paper_rows, v.questions))


# All papers of a fifth of the customers in one document, so documents have far more than 1000 lines.
BOOKS = LINES + """,
books AS (SELECT p.custkey % 5 AS paper_id, l.paper_id * 1000 + l.position AS position, l.markdown
  FROM lines l JOIN paps p ON p.id = l.paper_id)
"""


def books(v):
    lines = E.markdown_lines(v.papers, v.paper_rows, v.questions)
    owners = v.paps.select(F.col("id").alias("paper_id"), "custkey")
    return lines.join(owners, "paper_id").selectExpr("custkey % 5 AS paper_id", "paper_id * 1000 + position AS position", "markdown")


@query("export_long_documents", BOOKS + """
SELECT paper_id, string_agg(markdown, chr(10) ORDER BY position) AS markdown FROM books GROUP BY paper_id""")
def _(v):
    return E.documents(books(v))


@query("packed_documents", BOOKS + """
SELECT paper_id, string_agg(markdown, chr(10) ORDER BY position) AS markdown FROM (SELECT * FROM books
  UNION ALL SELECT paper_id + 100, position, markdown FROM lines) AS b GROUP BY paper_id""")
def _(v):
    path = new_folder(v.spark)
    single = E.markdown_lines(v.papers, v.paper_rows, v.questions).selectExpr("paper_id + 100 AS paper_id", "cast(position AS bigint) AS position", "markdown")
    write_documents(books(v).unionByName(single), path, size=1 << 20)
    return read_documents(v.spark, path)


@query("draft_markdown", """
WITH body AS (SELECT pq.paper_id, pq.position, concat('## Q', pq.display_number, '.', chr(10), chr(10), q.stem_md, chr(10), chr(10),
    CASE WHEN q.section_type = 'mcq' THEN concat('- **A.** ', q.opt_a, CASE WHEN q.answer = 'A' THEN ' ✅' ELSE '' END, chr(10),
      '- **B.** ', q.opt_b, chr(10), '- **C.** ', q.opt_c, CASE WHEN q.answer = 'C' THEN ' ✅' ELSE '' END, chr(10)) ELSE '' END,
    chr(10), '*Chapter: ', coalesce(q.chapter, '—'), ' | Difficulty: ', coalesce(q.difficulty, '—'), ' | Answer: ', q.answer, '*',
    chr(10), chr(10), '---', chr(10)) AS md
  FROM pq JOIN q_parts q ON q.id = pq.question_id),
heads AS (SELECT p.id AS paper_id, 0 AS position, concat('# E', p.custkey % 2, ' — small', chr(10), chr(10), '> Prompt: "', p.prompt, '"',
    chr(10), '> Questions: ', (SELECT count(*) FROM pq WHERE pq.paper_id = p.id), ' | Status: ', p.status, chr(10)) AS md FROM paps p)
SELECT paper_id, CAST(0 AS INT) AS part, string_agg(md, chr(10) ORDER BY position) AS markdown
FROM (SELECT * FROM body UNION ALL SELECT * FROM heads) AS a GROUP BY paper_id""")
def _(v):
    return E.in_parts(E.draft_markdown_lines(v.papers, v.paper_rows, v.questions))


@query("answer_key", """
SELECT pq.paper_id, pq.position, pq.display_number AS number, q.answer FROM pq JOIN q_parts q ON q.id = pq.question_id""")
def _(v):
    return E.answer_key(v.paper_rows, v.questions)


@query("markdown_sink", LINES + """
SELECT paper_id, CAST(0 AS INT) AS part, string_agg(markdown, chr(10) ORDER BY position) AS markdown FROM lines GROUP BY paper_id""")
def _(v):
    path = new_folder(v.spark)
    write_markdown(E.in_parts(E.markdown_lines(v.papers, v.paper_rows, v.questions)), path)
    return v.spark.read.schema("paper_id bigint, part int, markdown string").parquet(path)


@query("question_append", """
SELECT id, exam_name, subject, chapter, stem_md FROM q_parts UNION ALL SELECT id, exam_name, subject, chapter, stem_md FROM q_docs""")
def _(v):
    path = new_folder(v.spark)
    columns = ["id", "exam_name", "subject", "chapter", "stem_md"]
    append_questions(v.q_parts.select(columns), path)
    append_questions(v.q_docs.select(columns), path)
    schema = "id bigint, chapter string, stem_md string, exam_name string, subject string"
    return v.spark.read.schema(schema).parquet(path).select(columns)
