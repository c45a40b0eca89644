"""Blocks: scans, cleaning, layout detection, building, reports, streams."""

from pyspark.sql import functions as F


from itemlake.functions import text as X
from itemlake.operators import clean as K
from itemlake.operators import layouts as L
from itemlake.plans import ingest
from itemlake.plans.queries import query
from itemlake.plans.queries.bank import LATEST
from itemlake.session import cut_lineage, new_folder
from itemlake.sources.content import parse_content_lists
from itemlake.streaming.status import BOARD, read_status_board, start_status_board


def flat(options="options"):
    """Options as one text, ``A=x|B=y``."""
    return F.array_join(F.transform(options, lambda o: F.concat(o["label"], F.lit("="), o["value"])), "|")


@query("content_list_scan", """
SELECT p_partkey AS doc_id, CAST(0 AS BIGINT) AS block_idx, 'text' AS type, concat('1. ', p_name) AS text, CAST(NULL AS INT) AS text_level,
  p_size AS page_idx, CAST(NULL AS VARCHAR) AS img_path FROM part
UNION ALL SELECT p_partkey, 1, 'image', NULL, NULL, p_size, concat('i/', p_brand, '.jpg') FROM part
UNION ALL SELECT p_partkey, 2, 'text', p_type, 1, NULL, NULL FROM part""")
def _(v):
    raw = v.part.selectExpr("p_partkey AS doc_id", """concat('[', to_json(named_struct('type', 'text', 'text', concat('1. ', p_name),
        'page_idx', p_size)), ',', to_json(named_struct('type', 'image', 'img_path', concat('i/', p_brand, '.jpg'), 'page_idx', p_size)),
        ',', to_json(named_struct('type', 'text', 'text', p_type, 'text_level', 1, 'extra', true)), ']') AS value""")
    return parse_content_lists(raw).drop("html")


@query("page_counts", "SELECT doc_id, CAST(max(coalesce(page_idx, 0)) + 1 AS INT) AS page_count FROM blk_inline GROUP BY doc_id")
def _(v):
    return K.page_counts(v.blk_inline)


@query("block_profile", """
SELECT doc_id, count(*) FILTER (t IN ('text', 'plain_text')) AS text_blocks, count(*) FILTER (t IN ('image', 'figure', 'chart')) AS image_blocks,
  count(*) FILTER (t = 'table') AS table_blocks,
  count(*) FILTER (t IN ('equation', 'formula', 'inline_equation', 'interline_equation')) AS equation_blocks,
  count(*) FILTER (t NOT IN ('text', 'plain_text', 'image', 'figure', 'chart', 'table', 'equation', 'formula', 'inline_equation', 'interline_equation')) AS other_blocks
FROM (SELECT user_id AS doc_id, CASE event_type WHEN 'view' THEN 'plain_text' WHEN 'click' THEN 'chart' WHEN 'signup' THEN 'table'
  WHEN 'purchase' THEN 'interline_equation' ELSE 'unknown' END AS t FROM events) AS e GROUP BY doc_id""")
def _(v):
    return K.block_profile(v.events.selectExpr("user_id AS doc_id", """CASE event_type WHEN 'view' THEN 'Plain_Text'
        WHEN 'click' THEN 'chart' WHEN 'signup' THEN 'TABLE' WHEN 'purchase' THEN 'interline_equation' END AS type"""))


# --- Cleaning ----------------------------------------------------------------------------

@query("drop_empty_blocks", "SELECT doc_id, block_idx FROM blk_inline WHERE NOT (type = 'text' AND trim(coalesce(text, '')) = '')")
def _(v):
    return K.drop_empty(v.blk_inline).select("doc_id", "block_idx")


@query("drop_ad_pages", """
SELECT doc_id, block_idx FROM blk_inline b WHERE NOT EXISTS (SELECT 1 FROM blk_inline a WHERE a.doc_id = b.doc_id
  AND a.page_idx = b.page_idx AND a.type = 'text' AND lower(a.text) LIKE '%join leader course%')""")
def _(v):
    return K.drop_ad_pages(v.blk_inline).select("doc_id", "block_idx")


@query("drop_banners", """
SELECT doc_id, block_idx FROM blk_inline
WHERE NOT coalesce(type = 'text' AND text_level IS NOT NULL AND contains(text, 'TEST PAPER WITH ANSWER KEY'), false)""")
def _(v):
    return K.drop_banners(v.blk_inline).select("doc_id", "block_idx")


@query("drop_garbled", """
SELECT doc_id, turn FROM (SELECT conv_id AS doc_id, turn, CASE WHEN turn % 2 = 0 THEN regexp_replace(text, '[a-z]', 'é', 'g') ELSE text END AS t
  FROM conversations) AS c
WHERE trim(t) <> '' AND len(regexp_replace(t, '[\\x00-\\x7F]', '', 'g')) / len(t) <= 0.4""")
def _(v):
    blocks = v.conversations.selectExpr("conv_id AS doc_id", "turn", "'text' AS type",
                                        "CASE WHEN turn % 2 = 0 THEN regexp_replace(text, '[a-z]', 'é') ELSE text END AS text")
    return K.drop_garbled(blocks).select("doc_id", "turn")


KEPT = """
kept AS (SELECT b.* FROM blk_inline b
  WHERE NOT (type = 'text' AND trim(coalesce(text, '')) = '')
    AND NOT EXISTS (SELECT 1 FROM blk_inline a WHERE a.doc_id = b.doc_id
      AND a.page_idx = b.page_idx AND a.type = 'text' AND lower(a.text) LIKE '%join leader course%')
    AND NOT coalesce(type = 'text' AND text_level IS NOT NULL AND contains(text, 'TEST PAPER WITH ANSWER KEY'), false)),
nexts AS (SELECT *, coalesce(type = 'text' AND regexp_full_match(trim(text), 'Ans\\.?\\s*\\(\\s*[1-4A-Da-d]\\s*\\)'), false) AS ans FROM kept),
cleaned AS (SELECT * FROM (SELECT *, coalesce(lead(ans) OVER (PARTITION BY doc_id ORDER BY block_idx), false) AS next_ans FROM nexts) AS n
  WHERE NOT (ans AND next_ans))
"""


@query("drop_repeated_answers", """
WITH a AS (SELECT *, coalesce(type = 'text' AND regexp_full_match(trim(text), 'Ans\\.?\\s*\\(\\s*[1-4A-Da-d]\\s*\\)'), false) AS ans FROM blk_inline)
SELECT doc_id, block_idx FROM (SELECT *, coalesce(lead(ans) OVER (PARTITION BY doc_id ORDER BY block_idx), false) AS next_ans FROM a) AS n
WHERE NOT (ans AND next_ans)""")
def _(v):
    return K.drop_repeated_answers(v.blk_inline).select("doc_id", "block_idx")


@query("clean_blocks", "WITH " + KEPT + "SELECT doc_id, block_idx, type, text FROM cleaned")
def _(v):
    return K.clean_blocks(v.blk_inline).select("doc_id", "block_idx", "type", "text")


# --- Detection -------------------------------------------------------------------------------

@query("detect_inline_layout", """
WITH f AS (SELECT doc_id, block_idx, type = 'text' AND regexp_matches(trim(text), '^\\d{1,3}\\.\\s+') AS st,
    coalesce(type = 'text' AND regexp_matches(text, '(?i)Ans\\.?\\s*\\(\\s*[1-4A-Da-d]\\s*\\)'), false) AS ans FROM blk_inline),
n AS (SELECT *, coalesce(max(CAST(ans AS INT)) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS near FROM f)
SELECT doc_id, count(*) FILTER (st) AS starts, count(*) FILTER (st AND near = 1) AS answered,
  coalesce(count(*) FILTER (st AND near = 1) / nullif(count(*) FILTER (st), 0) > 0.6, false) AS is_inline FROM n GROUP BY doc_id""")
def _(v):
    return L.detect_inline(v.blk_inline)


@query("detect_key_layouts", """
WITH t AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n
  FROM blk_full WHERE type = 'text'),
f AS (SELECT *, regexp_matches(lower(text), 'answer key|ans key|ans\\. key|answers|answer sheet|solution key') AS hdr,
  regexp_matches(text, '\\bAns\\b\\.?\\s*[\\(\\[]') AS hint, regexp_matches(text, '^\\s*[Qq]\\.?\\s*(\\d{1,3})\\s*[\\.\\)]\\s*') AS pre FROM t)
SELECT doc_id, bool_or(hdr AND pos >= floor(n * 0.7::DOUBLE)) AND count(*) FILTER (hint AND pos < floor(n * 0.7::DOUBLE)) < 3 AS is_separate_key,
  bool_or(pre AND pos < 50) AND bool_or(hdr AND pos >= floor(n * 0.75::DOUBLE)) AS is_full_paper FROM f GROUP BY doc_id""")
def _(v):
    return L.detect_by_key(v.full_blocks)


@query("layout_detection", """
WITH f AS (SELECT doc_id, block_idx, coalesce(type = 'text' AND regexp_matches(trim(text), '^\\d{1,3}\\.\\s+'), false) AS st,
    coalesce(type = 'text' AND regexp_matches(text, '(?i)Ans\\.?\\s*\\(\\s*[1-4A-Da-d]\\s*\\)'), false) AS ans FROM blk_sep),
n AS (SELECT *, coalesce(max(CAST(ans AS INT)) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS near FROM f),
i AS (SELECT doc_id, coalesce(count(*) FILTER (st AND near = 1) / nullif(count(*) FILTER (st), 0) > 0.6, false) AS is_inline FROM n GROUP BY doc_id),
t AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n
  FROM blk_sep WHERE type = 'text'),
h AS (SELECT *, contains(lower(text), 'answer key') AS hdr, regexp_matches(text, '\\bAns\\b\\.?\\s*[\\(\\[]') AS hint,
  regexp_matches(text, '^\\s*[Qq]\\.?\\s*(\\d{1,3})\\s*[\\.\\)]\\s*') AS pre FROM t),
k AS (SELECT doc_id, bool_or(hdr AND pos >= floor(n * 0.7::DOUBLE)) AND count(*) FILTER (hint AND pos < floor(n * 0.7::DOUBLE)) < 3 AS is_separate_key,
  bool_or(pre AND pos < 50) AND bool_or(hdr AND pos >= floor(n * 0.75::DOUBLE)) AS is_full_paper FROM h GROUP BY doc_id)
SELECT doc_id, is_inline, is_separate_key, is_full_paper, CASE WHEN is_full_paper THEN 'full_paper' WHEN is_separate_key THEN 'separate_answer_key'
  WHEN is_inline THEN 'inline_answer' END AS layout_type FROM i LEFT JOIN k USING (doc_id)""")
def _(v):
    return L.detect_layout(cut_lineage(v.blk_sep))


@query("layout_errors", """
SELECT id AS doc_id, layout_type, CASE WHEN layout_type IS NULL THEN 'ingestion.layout_type is not set'
  WHEN layout_type = 'with_solution' THEN 'layout ''with_solution'' is not implemented'
  ELSE 'Unknown layout_type: ''columns''' END AS error
FROM ingestions WHERE layout_type IS NULL OR layout_type IN ('with_solution', 'columns')""")
def _(v):
    return L.layout_errors(v.ingestions.selectExpr("id AS doc_id", "layout_type"))


# --- Grouping ------------------------------------------------------------------------------------

@query("question_runs", """
WITH s AS (SELECT *, CASE WHEN type = 'text' THEN TRY_CAST(nullif(regexp_extract(trim(text), '^(\\d{1,3})\\.\\s+', 1), '') AS INT) END AS n FROM blk_inline),
g AS (SELECT *, max(CASE WHEN n IS NOT NULL THEN block_idx END) OVER (PARTITION BY doc_id ORDER BY block_idx) AS start_idx FROM s)
SELECT g.doc_id, g.block_idx, g.start_idx, s.n AS question_number FROM g JOIN s ON s.doc_id = g.doc_id AND s.block_idx = g.start_idx""")
def _(v):
    number = X.start_number(F.col("type"), F.col("text"))
    return L.question_runs(v.blk_inline, number).select("doc_id", "block_idx", "start_idx", "question_number")


LABELS = """
s AS (SELECT *, CASE WHEN type = 'text' THEN TRY_CAST(nullif(regexp_extract(trim(text), '^(\\d{1,3})\\.\\s+', 1), '') AS INT) END AS n,
  CASE WHEN text_level IS NOT NULL AND contains(upper(text), 'PHYSICS') THEN 'physics'
    WHEN text_level IS NOT NULL AND contains(upper(text), 'CHEMISTRY') THEN 'chemistry' END AS subj,
  CASE WHEN text_level IS NOT NULL THEN nullif(concat('SECTION-', upper(regexp_extract(text, '(?i)SECTION[-\\s]*([A-B])', 1))), 'SECTION-') END AS sec
  FROM {source}),
g AS (SELECT *, max(CASE WHEN n IS NOT NULL THEN block_idx END) OVER w AS start_idx,
  last_value(subj IGNORE NULLS) OVER w AS subj_c, last_value(sec IGNORE NULLS) OVER w AS sec_c
  FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx ROWS UNBOUNDED PRECEDING)),
starts AS (SELECT doc_id, block_idx AS start_idx, n, page_idx, subj_c, sec_c,
  lead(struct_pack(a := subj_c, b := sec_c)) OVER (PARTITION BY doc_id ORDER BY block_idx) AS closing FROM g WHERE n IS NOT NULL),
ends AS (SELECT doc_id, start_idx, arg_max(struct_pack(a := subj_c, b := sec_c), block_idx) AS tail FROM g WHERE start_idx IS NOT NULL GROUP BY ALL),
runs AS (SELECT st.doc_id, st.start_idx, st.n, st.page_idx, coalesce(closing, tail) AS label FROM starts st JOIN ends USING (doc_id, start_idx))
"""


@query("header_carry_forward", "WITH " + LABELS.replace("{source}", "blk_inline") + """
SELECT doc_id, start_idx, n AS question_number, label.a AS subject, label.b AS section_label FROM runs""")
def _(v):
    labels = L.inline_runs(v.blk_inline).groupBy("doc_id", "start_idx", "question_number").agg(
        F.max_by("__label", "block_idx").alias("label"))
    return labels.select("doc_id", "start_idx", "question_number", "label.subject",
                         F.col("label.section").alias("section_label"))


# --- Inline builder -----------------------------------------------------------------------------------

INLINE = "WITH " + KEPT + ", " + LABELS.replace("{source}", "cleaned") + """,
b AS (SELECT g.doc_id, g.start_idx, g.block_idx, g.type, g.text, g.img_path,
    CASE WHEN type = 'text' THEN nullif(regexp_extract(text, '(?i)Ans\\.?\\s*\\(\\s*([1-4])\\s*\\)', 1), '') END AS ans,
    type = 'text' AND len(regexp_extract_all(text, '\\(\\s*([1-4A-Da-d])\\s*\\)')) >= 2 AS has_opts
  FROM g WHERE start_idx IS NOT NULL),
a AS (SELECT doc_id, start_idx, min(block_idx) AS ans_idx, arg_min(ans, block_idx) AS ans FROM b WHERE ans IS NOT NULL GROUP BY ALL),
pre AS (SELECT b.*, a.ans_idx FROM b JOIN a USING (doc_id, start_idx) WHERE type = 'text' AND trim(text) <> '' AND b.block_idx < a.ans_idx),
o AS (SELECT doc_id, start_idx, min(block_idx) AS opt_idx, arg_min(text, block_idx) AS opt_text FROM pre WHERE has_opts GROUP BY ALL),
piece AS (SELECT pre.doc_id, pre.start_idx, pre.block_idx, CASE WHEN pre.block_idx = o.opt_idx
    THEN CASE WHEN instr(text, '(1)') > 1 THEN trim(left(text, instr(text, '(1)') - 1)) ELSE '' END ELSE text END AS t
  FROM pre LEFT JOIN o USING (doc_id, start_idx)),
stem AS (SELECT doc_id, start_idx, string_agg(t, chr(10) || chr(10) ORDER BY block_idx) AS stem FROM piece WHERE t <> '' GROUP BY ALL),
eq AS (SELECT doc_id, start_idx, string_agg('$$' || trim(text) || '$$', chr(10) || chr(10) ORDER BY block_idx) AS eq FROM b
  WHERE type = 'equation' AND trim(text) <> '' GROUP BY ALL)
"""


INLINE_BUILT = INLINE + """, built_inline AS (
SELECT r.doc_id, r.start_idx, r.n AS question_number, concat_ws(chr(10) || chr(10), coalesce(stem, ''), eq) AS stem_md,
  ['A', 'B', 'C', 'D'][CAST(a.ans AS INT)] AS answer, CASE WHEN o.opt_idx IS NULL THEN 'integer' ELSE 'mcq' END AS section_type,
  r.label.a AS subject, r.label.b AS section_label, r.page_idx AS source_page,
  CASE WHEN o.opt_idx IS NULL THEN '' ELSE concat('A=', trim(regexp_extract(opt_text, '\\(1\\)([^(]*)', 1)), '|B=', trim(regexp_extract(opt_text, '\\(2\\)([^(]*)', 1)),
    '|C=', trim(regexp_extract(opt_text, '\\(3\\)([^(]*)', 1)), '|D=', trim(regexp_extract(opt_text, '\\(4\\)([^(]*)', 1))) END AS options
FROM runs r JOIN a USING (doc_id, start_idx) LEFT JOIN o USING (doc_id, start_idx) LEFT JOIN stem USING (doc_id, start_idx)
LEFT JOIN eq USING (doc_id, start_idx)
WHERE coalesce(stem, eq) IS NOT NULL)
"""


@query("build_inline_questions", INLINE_BUILT + "SELECT * FROM built_inline")
def _(v):
    return L.build_inline(v.cleaned_blocks).select(
        "doc_id", "start_idx", "question_number", "stem_md", "answer", "section_type", "subject", "section_label",
        "source_page", flat().alias("options"))


# --- Separate key -----------------------------------------------------------------------------------------

SEPARATE_KEY = """
WITH e AS (SELECT doc_id, block_idx, regexp_extract_all(text, '(\\d{1,3})\\.\\(([1-4])\\)', 1) AS ns, regexp_extract_all(text, '(\\d{1,3})\\.\\(([1-4])\\)', 2) AS vs
  FROM blk_sep WHERE block_idx > 1000000000000),
u AS (SELECT doc_id, block_idx, unnest(ns) AS n, unnest(vs) AS v, generate_subscripts(ns, 1) AS i FROM e),
key AS (SELECT doc_id, CAST(n AS INT) AS question_number, arg_max(v, block_idx * 100 - i) AS raw_answer FROM u GROUP BY ALL)
"""


@query("separate_key_entries", SEPARATE_KEY + "SELECT * FROM key")
def _(v):
    return L.separate_key_entries(v.blk_sep)


SEPARATE_BUILT = SEPARATE_KEY + """,
s AS (SELECT *, CASE WHEN type = 'text' THEN TRY_CAST(nullif(regexp_extract(trim(text), '^(\\d{1,3})\\.\\s+', 1), '') AS INT) END AS n
  FROM blk_sep WHERE block_idx < 1000000000000),
g AS (SELECT *, max(CASE WHEN n IS NOT NULL THEN block_idx END) OVER (PARTITION BY doc_id ORDER BY block_idx) AS start_idx FROM s),
q AS (SELECT doc_id, start_idx, min(n) AS question_number, bool_or(type = 'text' AND text LIKE '(1)%') AS mcq,
    count(*) FILTER (type = 'text') AS texts FROM g WHERE start_idx IS NOT NULL GROUP BY doc_id, start_idx)
SELECT q.doc_id, q.start_idx, q.question_number, CASE WHEN mcq THEN 'mcq' ELSE 'integer' END AS section_type,
  CASE WHEN mcq THEN ['A', 'B', 'C', 'D'][CAST(raw_answer AS INT)] ELSE raw_answer END AS answer
FROM q LEFT JOIN key USING (doc_id, question_number)"""


@query("build_separate_key_questions", SEPARATE_BUILT)
def _(v):
    return L.build_separate_key(v.blk_sep).select("doc_id", "start_idx", "question_number", "section_type", "answer")


# --- Full papers ----------------------------------------------------------------------------------------------

FULL = """
WITH noise AS (SELECT *, trim(coalesce(text, '')) AS t FROM blk_full),
clean AS (SELECT * EXCLUDE (t), coalesce(nullif(text, ''), html, '') AS raw_body FROM noise WHERE NOT (type = 'text' AND (len(t) < 4 OR regexp_matches(t, '(?i)mathon\\s*go')
  OR regexp_matches(t, '^\\d{1,4}$') OR (len(t) < 100 AND (t LIKE '2025 (22 Jan Shift 1)%' OR t LIKE 'JEE Main Previous%'))))),
hdr AS (SELECT *, regexp_replace(raw_body, '<[^>]+>', ' ', 'g') AS body,
    row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS total FROM clean),
bound AS (SELECT doc_id, max(CASE WHEN type IN ('text', 'table') AND contains(lower(body), 'answer key') THEN block_idx END) AS header_idx,
    max(CASE WHEN type = 'image' AND pos >= total - 5 THEN block_idx END) AS image_idx FROM hdr GROUP BY doc_id),
boundary AS (SELECT doc_id, coalesce(header_idx, image_idx) AS boundary_idx,
    CASE WHEN header_idx IS NULL THEN image_idx END AS image_idx FROM bound),
entry AS (SELECT h.doc_id, h.block_idx, CAST(regexp_extract(body, '(\\d{1,3})\\s*\\.\\s*\\(\\s*([^)]{1,8})\\s*\\)', 1) AS INT) AS question_number,
    trim(regexp_extract(body, '(\\d{1,3})\\s*\\.\\s*\\(\\s*([^)]{1,8})\\s*\\)', 2)) AS v
  FROM hdr h JOIN boundary b USING (doc_id) WHERE h.block_idx >= b.boundary_idx AND type IN ('text', 'table')
    AND regexp_matches(body, '(\\d{1,3})\\s*\\.\\s*\\(\\s*([^)]{1,8})\\s*\\)')),
key AS (SELECT doc_id, question_number, arg_min(v, block_idx) AS raw_answer FROM entry GROUP BY ALL),
body0 AS (SELECT h.* FROM hdr h JOIN boundary b USING (doc_id) WHERE b.boundary_idx IS NULL OR h.block_idx < b.boundary_idx),
num AS (SELECT *, CASE WHEN type = 'text' THEN TRY_CAST(coalesce(nullif(regexp_extract(trim(text), '^[Qq]\\.?\\s*(\\d{1,3})\\s*[\\.\\)]\\s*', 1), ''),
    nullif(regexp_extract(trim(text), '^(\\d{1,3})\\s*[\\.\\)]\\s+\\S', 1), '')) AS INT) END AS n,
    CASE WHEN type = 'text' AND trim(text) = 'SECTION-B' THEN 'SECTION-B' END AS sec FROM body0),
grp AS (SELECT *, max(CASE WHEN n IS NOT NULL THEN block_idx END) OVER w AS start_idx, max(sec) OVER w AS sec_c FROM num
  WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx ROWS UNBOUNDED PRECEDING)),
frag AS (SELECT *, CASE WHEN type = 'equation' OR text LIKE '(13)%' OR text LIKE '(24)%' THEN NULL
    WHEN type = 'text' THEN nullif(trim(regexp_replace(string_split(text, '(1)')[1], ' {2,}', ' ', 'g')), '') END AS fr,
  CASE WHEN type = 'equation' THEN [struct_pack(l := 'A', v := regexp_extract(text, '1\\) (e\\d)', 1)), struct_pack(l := 'C', v := 'f')]
    WHEN text LIKE '(13)%' THEN [struct_pack(l := 'A', v := '$p$'), struct_pack(l := 'C', v := '$q$')]
    WHEN text LIKE '(24)%' THEN [struct_pack(l := 'B', v := '$r$'), struct_pack(l := 'D', v := '$s$')]
    WHEN text LIKE '%(1) u (2) v' THEN [struct_pack(l := 'A', v := 'u'), struct_pack(l := 'B', v := 'v')]
    WHEN text LIKE '(1) a%' THEN [struct_pack(l := 'A', v := regexp_extract(text, '\\(1\\) (a\\d)', 1)), struct_pack(l := 'B', v := 'b'),
      struct_pack(l := 'C', v := 'c'), struct_pack(l := 'D', v := 'd')] END AS opts
  FROM grp WHERE start_idx IS NOT NULL),
cands AS (SELECT doc_id, start_idx, block_idx, unnest(opts) AS o FROM frag WHERE opts IS NOT NULL),
first AS (SELECT doc_id, start_idx, o.l AS l, arg_min(o.v, block_idx) AS v FROM cands GROUP BY ALL),
opt AS (SELECT doc_id, start_idx, string_agg(l || '=' || v, '|' ORDER BY l) AS options, count(*) AS k FROM first GROUP BY ALL),
conf AS (SELECT c.doc_id, c.start_idx, count(*) AS conflicts FROM cands c JOIN first f ON f.doc_id = c.doc_id AND f.start_idx = c.start_idx
  AND f.l = c.o.l AND f.v <> c.o.v GROUP BY ALL),
stems AS (SELECT doc_id, start_idx, trim(regexp_replace(regexp_replace(string_agg(fr, chr(10) ORDER BY block_idx), '^\\s*[Qq]\\.?\\s*(\\d{1,3})\\s*[\\.\\)]\\s*', ''),
    '^\\d{1,3}\\s*[\\.\\)]\\s*', ''), ' ' || chr(10)) AS stem FROM frag WHERE fr IS NOT NULL GROUP BY ALL),
heads AS (SELECT doc_id, block_idx AS start_idx, n, page_idx, sec_c FROM frag WHERE n IS NOT NULL),
groups AS (SELECT h.doc_id, h.start_idx, h.n AS question_number, h.page_idx AS source_page, h.sec_c AS section_label,
    nullif(s.stem, '') AS stem_md, coalesce(o.options, '') AS options, coalesce(o.k, 0) AS k, coalesce(c.conflicts, 0) AS conflicts
  FROM heads h LEFT JOIN stems s USING (doc_id, start_idx) LEFT JOIN opt o USING (doc_id, start_idx) LEFT JOIN conf c USING (doc_id, start_idx)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, question_number ORDER BY start_idx) AS rn,
    count(*) OVER (PARTITION BY doc_id, question_number) AS built FROM groups WHERE stem_md IS NOT NULL),
kept AS (SELECT r.*, k.raw_answer FROM ranked r LEFT JOIN key k USING (doc_id, question_number) WHERE rn = 1),
built AS (SELECT *, CASE WHEN k > 0 THEN 'mcq' ELSE 'integer' END AS section_type,
  coalesce(CASE WHEN k > 0 AND raw_answer IN ('1', '2', '3', '4') THEN ['A', 'B', 'C', 'D'][CAST(raw_answer AS INT)] ELSE raw_answer END, '') AS answer FROM kept)
"""


@query("drop_noise_blocks", FULL + "SELECT doc_id, block_idx FROM clean")
def _(v):
    return L.filter_noise(v.full_blocks).select("doc_id", "block_idx")


@query("key_boundary", FULL + """
SELECT doc_id, boundary_idx, CASE WHEN image_idx IS NOT NULL THEN concat('images/', image_idx, '.jpg') END AS key_img_path FROM boundary""")
def _(v):
    return L.key_boundary(L.filter_noise(v.full_blocks))


@query("full_paper_key", FULL + "SELECT * FROM key")
def _(v):
    kept = cut_lineage(L.filter_noise(v.full_blocks))
    return L.full_paper_key(kept, L.key_boundary(kept))


@query("full_paper_groups", FULL + """
SELECT doc_id, start_idx, question_number, stem_md, options, conflicts, section_label, source_page FROM groups""")
def _(v):
    return L.full_paper_groups(v.full_blocks).select(
        "doc_id", "start_idx", "question_number", "stem_md", flat().alias("options"),
        F.size("conflicts").cast("long").alias("conflicts"), "section_label", "source_page")


@query("duplicate_numbers", FULL + """
SELECT DISTINCT doc_id, question_number, built FROM ranked WHERE built > 1""")
def _(v):
    return L.settle_duplicates(L.full_paper_groups(v.full_blocks)).filter("built > 1").select("doc_id", "question_number", "built")


@query("build_full_paper_questions", FULL + """
SELECT doc_id, start_idx, question_number, stem_md, options, answer, section_type, section_label, source_page FROM built""")
def _(v):
    return L.build_full_paper(v.full_blocks).select(
        "doc_id", "start_idx", "question_number", "stem_md", flat().alias("options"), "answer", "section_type",
        "section_label", "source_page")


@query("orphan_key_entries", FULL + """
SELECT k.* FROM key k WHERE NOT EXISTS (SELECT 1 FROM built b WHERE b.doc_id = k.doc_id AND b.question_number = k.question_number)""")
def _(v):
    paper = L.read_full_paper(v.full_blocks)
    return L.orphan_key_entries(paper.key, L.build_full_paper(v.full_blocks, paper=paper))


@query("document_warnings", FULL + """
SELECT doc_id, 'answer-key boundary not found in MinerU text; the answer-key page may have been emitted as an image block' AS warning
FROM boundary WHERE boundary_idx IS NULL OR image_idx IS NOT NULL
UNION ALL SELECT k.doc_id, concat('answer key contains Q', k.question_number, ' with no built question') FROM key k
WHERE NOT EXISTS (SELECT 1 FROM built b WHERE b.doc_id = k.doc_id AND b.question_number = k.question_number)""")
def _(v):
    blocks, paper = v.full_blocks, L.read_full_paper(v.full_blocks)
    return L.document_warnings(blocks, cut_lineage(L.build_full_paper(blocks, paper=paper)), paper)


@query("missing_option_labels", FULL + """
SELECT b.doc_id, b.question_number, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT unnest(['A', 'B', 'C', 'D']) AS x) AS u
  WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.doc_id = b.doc_id AND f.start_idx = b.start_idx AND f.l = u.x)) AS missing
FROM built b WHERE k BETWEEN 1 AND 3""")
def _(v):
    built = L.build_full_paper(v.full_blocks).filter(F.size("options").between(1, 3))
    return built.select("doc_id", "question_number",
                        F.array_join(X.missing_labels(X.as_map(F.col("options"))), ",").alias("missing"))


@query("missing_numbers", FULL + """
SELECT doc_id, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT unnest(range(lo, hi + 1)) AS x) AS r WHERE NOT list_contains(seen, x)), '') AS missing
FROM (SELECT doc_id, min(question_number) AS lo, max(question_number) AS hi, list(question_number) AS seen FROM built GROUP BY doc_id) AS d""")
def _(v):
    return L.missing_numbers(cut_lineage(L.build_full_paper(v.full_blocks))).select(
        "doc_id", F.array_join("missing", ",").alias("missing"))


@query("builder_quality_report", FULL + """
SELECT doc_id, count(*) AS total_extracted, count(*) FILTER (section_type = 'mcq') AS mcq_count,
  count(*) FILTER (section_type = 'integer') AS integer_count, count(*) FILTER (answer = '') AS no_answer,
  count(*) FILTER (k = 4) AS complete_options, max(question_number) - min(question_number) + 1 - count(*) AS missing FROM built GROUP BY doc_id""")
def _(v):
    report = L.quality_report(cut_lineage(L.build_full_paper(v.full_blocks)))
    return report.select("doc_id", "total_extracted", "mcq_count", "integer_count", "no_answer", "complete_options",
                         F.size("missing").cast("long").alias("missing"))


REPORT = FULL + """,
orphan AS (SELECT k.doc_id, k.question_number FROM key k
  WHERE NOT EXISTS (SELECT 1 FROM built b WHERE b.doc_id = k.doc_id AND b.question_number = k.question_number)),
told AS (SELECT doc_id, -1 AS n, 'answer-key boundary not found in MinerU text; the answer-key page may have been emitted as an image block' AS warning
  FROM boundary WHERE boundary_idx IS NULL OR image_idx IS NOT NULL
  UNION ALL SELECT doc_id, question_number, concat('answer key contains Q', question_number, ' with no built question') FROM orphan),
figures AS (SELECT doc_id, start_idx, count(*) AS linked FROM frag JOIN events e ON e.event_id = block_idx AND e.value < 50
  WHERE type = 'image' GROUP BY ALL)
"""


@query("builder_report", REPORT + """
SELECT d.doc_id, coalesce(q.total_extracted, 0) AS total_extracted, coalesce(q.mcq_count, 0) AS mcq_count,
  coalesce(q.integer_count, 0) AS integer_count, coalesce(q.with_diagram, 0) AS with_diagram, coalesce(q.no_answer, 0) AS no_answer,
  coalesce(q.complete_options, 0) AS complete_options,
  (SELECT count(*) FROM key k WHERE k.doc_id = d.doc_id) AS answer_key_size,
  coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT unnest(range(q.lo, q.hi + 1)) AS x) AS r WHERE NOT list_contains(q.seen, x)), '') AS missing,
  coalesce((SELECT string_agg(question_number, ',' ORDER BY question_number) FROM (SELECT DISTINCT r.question_number FROM ranked r
    WHERE r.doc_id = d.doc_id AND r.built > 1) AS t), '') AS duplicate_question_numbers,
  coalesce((SELECT string_agg(warning, '; ' ORDER BY n) FROM told t WHERE t.doc_id = d.doc_id), '') AS stage_warnings
FROM (SELECT DISTINCT doc_id FROM blk_full) AS d LEFT JOIN (SELECT b.doc_id, count(*) AS total_extracted,
    count(*) FILTER (section_type = 'mcq') AS mcq_count, count(*) FILTER (section_type = 'integer') AS integer_count,
    count(*) FILTER (f.linked > 0) AS with_diagram, count(*) FILTER (answer = '') AS no_answer, count(*) FILTER (k = 4) AS complete_options,
    min(question_number) AS lo, max(question_number) AS hi, list(question_number) AS seen
  FROM built b LEFT JOIN figures f USING (doc_id, start_idx) GROUP BY b.doc_id) AS q USING (doc_id)""")
def _(v):
    files = v.events.filter("value < 50").selectExpr("user_id AS doc_id", "concat(event_id, '.jpg') AS filename")
    report = L.builder_report(v.full_blocks, files)
    return report.select(*[F.array_join(c, "; " if c == "stage_warnings" else ",").alias(c) if kind.startswith("array") else F.col(c)
                           for c, kind in report.dtypes])


@query("processing_report", REPORT + """
SELECT d.doc_id, count(b.start_idx) AS questions_detected, count(b.stem_md) AS questions_stored,
  count(b.start_idx) FILTER (b.stem_md IS NULL) AS questions_skipped, count(b.stem_md) AS answers_mapped,
  CAST(coalesce(sum(b.linked), 0) AS BIGINT) AS images_linked
FROM (SELECT DISTINCT doc_id FROM blk_full) AS d LEFT JOIN (SELECT b.doc_id, b.start_idx, f.linked,
    CASE WHEN b.question_number % 7 <> 3 THEN b.stem_md END AS stem_md
  FROM built b LEFT JOIN figures f USING (doc_id, start_idx)) AS b USING (doc_id) GROUP BY d.doc_id""")
def _(v):
    files = v.events.filter("value < 50").selectExpr("user_id AS doc_id", "concat(event_id, '.jpg') AS filename")
    built = cut_lineage(L.build_full_paper(v.full_blocks, files))
    report = L.processing_report(built, built.filter("question_number % 7 <> 3"), v.full_blocks)
    return report.drop("warning_count", "detected_subjects")


@query("question_warnings", FULL + """,
im AS (SELECT f.doc_id, f.start_idx, f.block_idx FROM frag f LEFT JOIN events e ON e.event_id = f.block_idx AND e.value < 50
  WHERE f.type = 'image' AND e.event_id IS NULL),
starts AS (SELECT doc_id, question_number, min(start_idx) AS first_start FROM groups GROUP BY ALL)
SELECT b.doc_id, b.question_number AS number, 'ok' AS status, concat(
  CASE WHEN b.start_idx > s.first_start THEN concat('Q', b.question_number, ': duplicate question start detected;') ELSE '' END,
  CASE WHEN b.k BETWEEN 1 AND 3 THEN concat('Q', b.question_number, ': options_missing — recovered ', b.k, '/4 options (PDF OCR may have dropped the rest);') ELSE '' END,
  coalesce((SELECT string_agg(concat('Q', b.question_number, ': MinerU image ', chr(39), im.block_idx, '.jpg'' could not be linked;'), '' ORDER BY im.block_idx)
    FROM im WHERE im.doc_id = b.doc_id AND im.start_idx = b.start_idx), ''),
  CASE WHEN b.raw_answer IS NULL THEN concat('Q', b.question_number, ': answer not found in answer key;') ELSE '' END,
  CASE WHEN b.k > 0 AND b.answer NOT IN ('', 'A', 'B', 'C', 'D') THEN concat('Q', b.question_number, ': unrecognised MCQ answer key value ', chr(39), b.raw_answer, chr(39), ';') ELSE '' END
  ) AS warnings
FROM built b JOIN starts s USING (doc_id, question_number)""")
def _(v):
    files = v.events.filter("value < 50").selectExpr("user_id AS doc_id", "concat(event_id, '.jpg') AS filename")
    report = L.question_report(L.build_full_paper(v.full_blocks, files))
    # Which of several option values wins is told by full_paper_groups.
    told = F.filter("warnings", lambda w: ~F.contains(w, F.lit("conflict")))
    return report.select("doc_id", "number", "status", F.array_join(F.transform(told, lambda w: F.concat(w, F.lit(";"))), "").alias("warnings"))


@query("number_order", """
SELECT ingestion_id, id, question_number, row_number() OVER (PARTITION BY ingestion_id ORDER BY coalesce(question_number, 0), id) - 1 AS ordinal
FROM q_docs""")
def _(v):
    return L.number_order(v.q_docs.select("ingestion_id", "id", "question_number"), "ingestion_id", "id")


# --- Images and reports -----------------------------------------------------------------------------------------

@query("image_linking", FULL + """,
im AS (SELECT f.doc_id, f.start_idx, f.block_idx FROM frag f WHERE f.type = 'image')
SELECT b.doc_id, b.question_number, coalesce(string_agg(im.block_idx || '.jpg', ',' ORDER BY im.block_idx)
    FILTER (e.event_id IS NOT NULL), '') AS linked, count(im.block_idx) FILTER (e.event_id IS NULL) AS unlinked
FROM built b LEFT JOIN im ON im.doc_id = b.doc_id AND im.start_idx = b.start_idx
LEFT JOIN events e ON e.event_id = im.block_idx AND e.value < 50 GROUP BY b.doc_id, b.question_number""")
def _(v):
    files = v.events.filter("value < 50").selectExpr("user_id AS doc_id", "concat(event_id, '.jpg') AS filename")
    built = L.build_full_paper(v.full_blocks, files)
    return built.select(
        "doc_id", "question_number", F.array_join(F.transform("images", lambda i: i["filename"]), ",").alias("linked"),
        F.size(F.filter("warnings", lambda w: F.contains(w, F.lit("could not be linked")))).cast("long").alias("unlinked"))


@query("document_report", INLINE + """,
q AS (SELECT r.doc_id, r.label.a AS subject FROM runs r JOIN a USING (doc_id, start_idx) LEFT JOIN stem USING (doc_id, start_idx)
  LEFT JOIN eq USING (doc_id, start_idx) WHERE coalesce(stem, eq) IS NOT NULL)
SELECT doc_id, count(*) AS questions_detected, coalesce(array_to_string(list_sort(list(DISTINCT subject) FILTER (subject IS NOT NULL)), ','), '') AS detected_subjects
FROM q GROUP BY doc_id""")
def _(v):
    report = L.document_report(L.build_inline(v.cleaned_blocks))
    return report.select("doc_id", "questions_detected", F.array_join("detected_subjects", ",").alias("detected_subjects"))


@query("question_report", FULL + "SELECT doc_id, question_number AS number, 'ok' AS status FROM built")
def _(v):
    return L.question_report(L.build_full_paper(v.full_blocks)).select("doc_id", "number", "status")


@query("layout_dispatch", """
SELECT doc_id, question_number, 'full_paper' AS layout_type, section_type, answer FROM (""" + FULL + """SELECT * FROM built) AS f WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, question_number, 'inline_answer', section_type, answer FROM (""" + INLINE_BUILT + """SELECT * FROM built_inline) AS i WHERE doc_id % 3 = 1
UNION ALL SELECT doc_id, question_number, 'separate_answer_key', section_type, answer FROM (""" + SEPARATE_BUILT + """) AS s WHERE doc_id % 3 = 2""")
def _(v):
    documents = v.events.selectExpr("user_id AS doc_id").distinct().selectExpr(
        "doc_id", "CASE doc_id % 3 WHEN 0 THEN 'full_paper' WHEN 1 THEN 'inline_answer' ELSE 'separate_answer_key' END AS layout_type")
    blocks = v.blk_full.filter("doc_id % 3 = 0").unionByName(v.blk_inline.filter("doc_id % 3 = 1")).unionByName(
        v.blk_sep.filter("doc_id % 3 = 2"))
    return ingest.documents_to_questions(cut_lineage(blocks), documents).select(
        "doc_id", "question_number", "layout_type", "section_type", "answer")


# --- Streams --------------------------------------------------------------------------------------------------------

@query("status_board_stream", LATEST + "SELECT * FROM latest")
def _(v):
    work = new_folder(v.spark)
    stream = (v.spark.readStream.schema(v.events.schema).option("pathGlobFilter", "events.parquet").parquet(v.folder)
              .selectExpr("user_id AS ingestion_id", "event_id AS seq", """CASE event_type WHEN 'signup' THEN 'UPLOADED'
                  WHEN 'view' THEN 'MINERU_COMPLETE' WHEN 'click' THEN 'QUESTIONS_BUILT' WHEN 'purchase' THEN 'METADATA_COMPLETE'
                  ELSE CASE WHEN event_id % 2 = 0 THEN 'FAILED' ELSE 'SAVED' END END AS status""",
                          "CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN concat('failed with ', props) END AS error"))
    start_status_board(stream, f"{work}/board", f"{work}/checkpoint").awaitTermination()
    return read_status_board(v.spark.read.schema(f"{BOARD}, batch int").option("basePath", f"{work}/board").parquet(f"{work}/board"))
