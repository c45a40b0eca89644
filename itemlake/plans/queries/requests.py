"""Requests: normalisation, validation, chapters, preview, selection, drafts."""

from pyspark.sql import functions as F

from itemlake.operators import papers as P
from itemlake.operators import requests as R
from itemlake.operators import select as S
from itemlake.operators import syllabus as Y
from itemlake.plans import drafting
from itemlake.plans.queries import query

#: Keys of a shuffle by its digest d, and the sizes of the two halves of a place's binary digits.
SHUFFLE_KEYS = """[CAST('0x' || substr(d, 1, 8) AS BIGINT), CAST('0x' || substr(d, 9, 8) AS BIGINT),
    CAST('0x' || substr(d, 17, 8) AS BIGINT), CAST('0x' || substr(d, 25, 8) AS BIGINT)] AS ks,
  CAST(1 AS BIGINT) << (length(bin(n - 1)) // 2) AS hs, CAST(1 AS BIGINT) << (length(bin(n - 1)) - length(bin(n - 1)) // 2) AS ls"""


def _drawn(half: str, key: int) -> str:
    x = f"((xor({half}, ks[{key}]) * 1540483477) % 2147483647)"
    return f"((xor({x}, {x} >> 15) * 1103515245) % 2147483647)"


def shuffled_places(kept: str) -> str:
    """Tables ``walk`` and ``g (kept, at)`` from ``stops (kept, n, ks, hs, ls, i)``: place i of n and where it goes.

    Four rounds written out, each half changed by the other, and again from where they lead as long as that is outside.
    """
    def turn(place: str) -> str:
        return f"""xor({place} // ls, {_drawn(f"({place} % ls)", 1)} % hs) AS a1, xor({place} % ls, {_drawn("a1", 2)} % ls) AS b1,
    xor(a1, {_drawn("b1", 3)} % hs) AS a2, xor(b1, {_drawn("a2", 4)} % ls) AS b2"""

    return f"""walk AS (SELECT {kept}, n, ks, hs, ls, a2 * ls + b2 AS spot FROM (SELECT *, {turn("i")} FROM stops)
  UNION ALL SELECT {kept}, n, ks, hs, ls, a2 * ls + b2 FROM (SELECT *, {turn("spot")} FROM walk WHERE spot >= n)),
g AS (SELECT {kept}, spot AS at FROM walk WHERE spot < n)"""


@query("request_normalization", "SELECT request_id, exam_name, subject, mode AS chapter_filter_mode FROM nreq")
def _(v):
    return R.normalize_requests(v.requests).select("request_id", "exam_name", "subject", "chapter_filter_mode")


@query("request_validation", """
SELECT request_id, concat_ws(' | ',
  CASE WHEN question_count NOT BETWEEN 1 AND 200 THEN 'question_count must be between 1 and 200' END,
  CASE WHEN difficulty NOT IN ('easy', 'medium', 'hard')
    THEN concat('difficulty must be ''easy'', ''medium'', or ''hard'', got ''', difficulty, '''') END,
  CASE WHEN section_type NOT IN ('mcq', 'integer')
    THEN concat('section_type must be ''mcq'' or ''integer'', got ''', section_type, '''') END,
  CASE WHEN difficulty IS NOT NULL AND dist_easy IS NOT NULL THEN
    'Provide either a single ''difficulty'' filter OR a ''difficulty_distribution'' breakdown, not both.' END) AS errors
FROM nreq""")
def _(v):
    return R.validate_requests(R.normalize_requests(v.requests)).select(
        "request_id", F.array_join("errors", " | ").alias("errors"))


@query("chapter_name_resolution", """
WITH names AS (SELECT DISTINCT exam_name, subject, name1 AS name FROM nreq WHERE mode <> 'all'),
m AS (SELECT n.*, min(CASE WHEN lower(s.chapter_name) = lower(trim(n.name)) THEN s.chapter_order END) AS exact_order,
    min(CASE WHEN lower(s.alias) = lower(trim(n.name)) THEN s.chapter_order END) AS alias_order
  FROM names n LEFT JOIN syl s USING (exam_name, subject) GROUP BY ALL)
SELECT exam_name, subject, name, coalesce(exact_order, alias_order) AS chapter_order,
  CASE WHEN exact_order IS NOT NULL THEN 'exact' WHEN alias_order IS NOT NULL THEN 'alias' END AS kind FROM m""")
def _(v):
    names = R.normalize_requests(v.requests).filter("chapter_filter_mode <> 'all'").selectExpr(
        "exam_name", "subject", "chapter AS name")
    return Y.resolve_names(names, v.syllabus, fuzzy=False).select(
        "exam_name", "subject", "name", F.col("hit.ord").alias("chapter_order"), F.col("hit.kind").alias("kind"))


@query("fuzzy_chapter_resolution")
def _(v):
    names = R.normalize_requests(v.requests).selectExpr(
        "exam_name", "subject", "concat('Brnd', substring(chapter_to, 6), ' unit') AS name")
    return Y.resolve_names(names, v.syllabus).select(
        "exam_name", "subject", "name", F.col("hit.name").alias("chapter_name"), F.col("hit.kind").alias("kind"),
        F.round("hit.score", 6).alias("score"))


@query("chapter_ranges", """
SELECT request_id, array_to_string(chapters, ',') AS chapters, coalesce(excluded, '') AS excluded,
  CASE mode WHEN 'all' THEN concat('All ', total, ' chapters')
    WHEN 'exact' THEN concat('Chapter ', o1, ' of ', total, ': ''', n1, '''')
    WHEN 'upto' THEN concat('Chapters 1–', o1, ' of ', total, ' (up to ''', n1, ''')')
    WHEN 'from' THEN concat('Chapters ', o1, '–', total, ' of ', total, ' (from ''', n1, ''')')
    WHEN 'after' THEN concat('Chapters ', o1 + 1, '–', total, ' of ', total, ' (after ''', n1, ''', exclusive)')
    ELSE concat('Chapters ', lo, '–', hi, ' of ', total, ' (''', n1, ''' to ''', n2, ''')') END AS description,
  concat_ws('; ', CASE WHEN mode <> 'all' AND NOT exact1 THEN concat('Matched ''', name1, ''' via alias → ''', n1, '''') END,
    CASE WHEN exclude1 IS NOT NULL THEN concat('[exclude] Matched ''', exclude1, ''' via alias → ''', excluded, '''') END) AS warnings
FROM rreq""")
def _(v):
    return v.resolved.select(
        "request_id", F.array_join("resolved_chapters", ",").alias("chapters"),
        F.array_join("excluded_chapters", ",").alias("excluded"), F.col("range_description").alias("description"),
        F.array_join("resolver_warnings", "; ").alias("warnings"))


@query("chapter_exclusion", """
SELECT r.request_id, s.chapter_name AS chapter
FROM rreq r JOIN syl s ON s.exam_name = r.exam_name AND s.subject = r.subject
WHERE s.chapter_order BETWEEN r.lo AND r.hi AND s.chapter_name IS DISTINCT FROM r.excluded""")
def _(v):
    return v.resolved.select("request_id", F.explode("resolved_chapters").alias("chapter"))


@query("request_problems", """
SELECT request_id, problem FROM judged WHERE problem IS NOT NULL
UNION ALL SELECT request_id, unnest(e) FROM (SELECT request_id, list_filter([
  CASE WHEN question_count NOT BETWEEN 1 AND 200 THEN 'question_count must be between 1 and 200' END,
  CASE WHEN difficulty = 'brutal' THEN 'difficulty must be ''easy'', ''medium'', or ''hard'', got ''brutal''' END,
  CASE WHEN section_type = 'essay' THEN 'section_type must be ''mcq'' or ''integer'', got ''essay''' END,
  CASE WHEN difficulty IS NOT NULL AND dist_easy IS NOT NULL THEN
    'Provide either a single ''difficulty'' filter OR a ''difficulty_distribution'' breakdown, not both.' END],
  lambda x: x IS NOT NULL) AS e FROM nreq) AS n""")
def _(v):
    kind = F.regexp_extract("problem", r"^(SyllabusNotFound|ChapterNotFound|EmptyRange): ", 1)
    return drafting.request_problems(v.requests, v.syllabus, fuzzy=False).withColumn(
        "problem", F.coalesce(F.nullif(kind, F.lit("")), "problem"))


# --- Filters ---------------------------------------------------------------------------

@query("blueprint_filter", """
SELECT id, chapter, difficulty FROM q_parts WHERE status = 'active' AND exam_name = 'E1' AND subject = 'promo'
  AND chapter IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#11', 'Brand#12') AND chapter NOT IN ('Brand#2')
  AND section_type = 'mcq' AND has_diagram = false""")
def _(v):
    return v.q_parts.filter(S.blueprint_predicate(
        exam_name="E1", subject="promo", excluded_chapters=["Brand#2"], section_type="mcq", has_diagram=False,
        resolved_chapters=["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#11", "Brand#12"],
    )).select("id", "chapter", "difficulty")


@query("concept_filter_any", "SELECT id FROM q_parts WHERE list_has_any(concepts, ['ring', 'widget'])")
def _(v):
    return v.q_parts.filter(S.concept_predicate(["ring", "widget"])).select("id")


@query("concept_filter_all", "SELECT id FROM q_parts WHERE list_has_all(concepts, ['ring', 'small'])")
def _(v):
    return v.q_parts.filter(S.concept_predicate(["ring", "small"], "all")).select("id")


# --- Preview ------------------------------------------------------------------------------

@query("candidate_facets", """
SELECT request_id, 'total' AS facet, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM cand GROUP BY request_id
UNION ALL SELECT request_id, 'chapter', chapter, count(*) FROM cand WHERE chapter IS NOT NULL GROUP BY request_id, chapter
UNION ALL SELECT request_id, 'difficulty', difficulty, count(*) FROM cand WHERE difficulty IS NOT NULL GROUP BY request_id, difficulty
UNION ALL SELECT request_id, 'section_type', section_type, count(*) FROM cand GROUP BY request_id, section_type
UNION ALL SELECT request_id, 'question_type', question_type, count(*) FROM cand WHERE question_type IS NOT NULL
  GROUP BY request_id, question_type""")
def _(v):
    return drafting.preview(v.resolved, v.questions)[1]


@query("availability", """
SELECT r.request_id, count(c.id) AS total_available, count(c.id) >= r.question_count AS can_generate,
  greatest(0, r.question_count - count(c.id)) AS shortage
FROM rreq r LEFT JOIN cand c USING (request_id) GROUP BY r.request_id, r.question_count""")
def _(v):
    return drafting.preview(v.resolved, v.questions)[0].select(
        "request_id", "total_available", "can_generate", "shortage")


@query("preview_samples", """
SELECT request_id, CAST(rn AS INT) AS rank, id, question_number, chapter, difficulty, question_type,
  CASE WHEN raw_text <> '' THEN raw_text ELSE regexp_replace(stem_md, '\\$\\$?.*?\\$\\$?', '[formula]', 'g') END AS stem_preview
FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY question_number NULLS LAST, id) AS rn FROM cand) AS c
WHERE rn <= 5""")
def _(v):
    return drafting.preview(v.resolved, v.questions)[2]


# --- Selection ------------------------------------------------------------------------------

POOL = """
w AS (SELECT *, coalesce(difficulty, 'medium') AS tier, concat('{"exam_name":"', exam_name, '","subject":"', subject,
    '","chapter":', coalesce('"' || chapter || '"', 'null'), ',"difficulty":', coalesce('"' || difficulty || '"', 'null'),
    ',"question_type":', coalesce('"' || question_type || '"', 'null'), ',"section_type":"', section_type,
    '","has_formula":', CAST(has_formula AS VARCHAR), ',"has_diagram":', CAST(has_diagram AS VARCHAR), '}') AS cell
  FROM {source}),
place AS (SELECT *, row_number() OVER (PARTITION BY request_id, label, tier ORDER BY cell, md5(CAST(id AS VARCHAR)), id) - 1 AS at,
    count(*) OVER (PARTITION BY request_id, label, tier) AS n FROM w),
pool AS (SELECT request_id, label, tier, count(*) AS n FROM w GROUP BY ALL),
tgt0 AS (SELECT b.request_id, b.label, b.count, b.seed, s.tier, s.ord, CAST(round_even(s.frac * b.count, 0) AS BIGINT) AS t
  FROM asked b JOIN split s ON s.request_id = b.request_id AND s.label = b.label),
rest AS (SELECT request_id, label, any_value(count) AS count, any_value(seed) AS seed, any_value(count) - sum(t) AS d,
    bool_or(tier = 'medium') AS has_medium FROM tgt0 GROUP BY request_id, label),
tgt AS (SELECT t.request_id, t.label, t.count, t.seed, t.tier, t.ord, t.t + CASE WHEN t.tier = 'medium' THEN r.d ELSE 0 END AS t
    FROM tgt0 t JOIN rest r USING (request_id, label)
  UNION ALL SELECT request_id, label, count, seed, 'medium', 99, d FROM rest WHERE NOT has_medium AND d <> 0),
sized AS (SELECT t.*, CASE WHEN t.tier IN ('easy', 'medium', 'hard') THEN coalesce(p.n, 0) ELSE 0 END AS n
  FROM tgt t LEFT JOIN pool p USING (request_id, label, tier)),
s AS (SELECT *, CASE WHEN t >= 0 THEN least(t, n) ELSE greatest(0, n + t) END AS s FROM sized),
b AS (SELECT *, coalesce(sum(s) OVER (PARTITION BY request_id, label ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bs,
    coalesce(sum(n - s) OVER (PARTITION BY request_id, label ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bl,
    greatest(0, count - sum(s) OVER (PARTITION BY request_id, label)) AS short FROM s),
k AS (SELECT *, CAST(greatest(0, least(s, count - bs)) + greatest(0, least(n - s, short - bl)) AS BIGINT) AS k FROM b),
keyed AS (SELECT *, """ + SHUFFLE_KEYS + """ FROM (SELECT *, md5(concat_ws(':', seed, concat(label, ' ', tier))) AS d FROM k WHERE k > 0)),
stops AS (SELECT *, unnest(range(k)) AS i FROM keyed),
""" + shuffled_places("request_id, label, tier") + """,
chosen AS (SELECT g.request_id, g.label, p.id, p.chapter, p.question_number, p.section_type
  FROM g JOIN place p ON p.request_id = g.request_id AND p.label = g.label AND p.tier = g.tier AND p.at = g.at)
"""
REQUEST_SELECTION = """
WITH RECURSIVE mine AS (SELECT c.*, 'A' AS label FROM cand c),
ok AS (SELECT r.request_id, count(c.id) AS total FROM rreq r JOIN cand c USING (request_id) GROUP BY r.request_id, r.question_count
  HAVING count(c.id) >= r.question_count),
asked AS (SELECT r.request_id, 'A' AS label, r.question_count AS count, r.seed, r.dist_easy, ok.total FROM rreq r JOIN ok USING (request_id)),
share AS (SELECT request_id, coalesce(difficulty, 'medium') AS tier, count(*) AS n FROM cand GROUP BY ALL),
split AS (SELECT request_id, label, 'hard' AS tier, 1 AS ord, 1 / count AS frac FROM asked WHERE dist_easy IS NOT NULL
  UNION ALL SELECT request_id, label, 'easy', 2, (count - 1) / count FROM asked WHERE dist_easy IS NOT NULL
  UNION ALL SELECT a.request_id, a.label, s.tier, CASE s.tier WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 WHEN 'hard' THEN 3 ELSE 9 END,
    s.n / a.total FROM asked a JOIN share s USING (request_id) WHERE a.dist_easy IS NULL),
""" + POOL.replace("{source}", "mine") + """, final AS (
SELECT c.request_id, c.id, c.section_type, row_number() OVER (PARTITION BY c.request_id ORDER BY
    coalesce(nullif(list_position(r.chapters, c.chapter), 0), 10000), coalesce(nullif(c.question_number, 0), 9999), c.id) AS position
FROM chosen c JOIN rreq r USING (request_id))
"""


@query("request_selection", REQUEST_SELECTION + """
SELECT request_id, id, section_type, CAST(position AS INT) AS position FROM final""")
def _(v):
    return S.select_for_requests(v.resolved, v.questions).select("request_id", "id", "section_type", "position")


@query("draft_from_requests", REQUEST_SELECTION + """
SELECT request_id AS paper_id, id AS question_id, CAST(pos AS INT) AS position, CAST(pos AS INT) AS display_number,
  CASE WHEN section_type = 'mcq' THEN 'Section A' ELSE 'Section B' END AS paper_section, false AS locked
FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN section_type = 'mcq' THEN 0 ELSE 1 END, position) AS pos
      FROM final) AS f""")
def _(v):
    return drafting.draft_for_requests(v.resolved, v.questions)


@query("proportional_split", """
SELECT request_id, coalesce(difficulty, 'medium') AS tier, count(*) / sum(count(*)) OVER (PARTITION BY request_id) AS share
FROM cand GROUP BY request_id, coalesce(difficulty, 'medium')""")
def _(v):
    pools = S.prepare(S.with_spec(v.resolved), v.questions)
    shares = S.tier_counts(pools.cells).select("spec", F.explode(S.proportional_split(F.col("tiers"))).alias("t"))
    return pools.requests.select("request_id", "spec").join(shares, "spec").select(
        "request_id", F.col("t.tier").alias("tier"), F.col("t.frac").alias("share"))


BLUEPRINT_SELECTION = """
WITH RECURSIVE bp AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('E', c_custkey % 2) END AS exam_name,
    CASE c_custkey % 3 WHEN 0 THEN 'economy' WHEN 1 THEN 'small' ELSE 'promo' END AS subject,
    CASE WHEN c_custkey % 4 = 0 THEN CAST([] AS VARCHAR[])
      ELSE [concat('Brand#', 1 + c_custkey % 25), 'Brand#7', 'Brand#3', 'Brand#12'] END AS chapters,
    c_custkey % 7 AS a, c_custkey % 3 AS b, c_custkey * 17 AS seed FROM customer),
asked AS (SELECT request_id, 'A' AS label, a AS count, seed, 'mcq' AS st FROM bp
  UNION ALL SELECT request_id, 'B', b, seed, 'integer' FROM bp),
mine AS (SELECT b.request_id, k.label, q.* FROM bp b JOIN asked k USING (request_id)
  JOIN q_parts q ON q.subject = b.subject AND q.section_type = k.st AND q.status = 'active'
    AND (b.exam_name = '' OR q.exam_name = b.exam_name) AND (len(b.chapters) = 0 OR list_contains(b.chapters, q.chapter))),
split AS (SELECT request_id, label, unnest(['easy', 'hard']) AS tier, unnest([1, 2]) AS ord, unnest([0.5, 0.5]) AS frac FROM asked),
""" + POOL.replace("{source}", "mine") + """, final AS (
SELECT c.request_id, c.id, c.section_type, row_number() OVER (PARTITION BY c.request_id ORDER BY c.label,
    coalesce(nullif(list_position(b.chapters, c.chapter), 0), 10000), c.id) AS position
FROM chosen c JOIN bp b USING (request_id))
"""


def blueprints(v):
    return v.customer.selectExpr(
        "c_custkey AS request_id", "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('E', c_custkey % 2) END AS exam_name",
        "CASE c_custkey % 3 WHEN 0 THEN 'economy' WHEN 1 THEN 'small' ELSE 'promo' END AS subject",
        "CASE WHEN c_custkey % 4 = 0 THEN cast(array() AS array<string>) "
        "ELSE array(concat('Brand#', 1 + c_custkey % 25), 'Brand#7', 'Brand#3', 'Brand#12') END AS chapters",
        "cast(c_custkey % 7 AS int) AS section_a_count", "cast(c_custkey % 3 AS int) AS section_b_count",
        "array(named_struct('tier', 'easy', 'frac', 0.5D), named_struct('tier', 'hard', 'frac', 0.5D)) AS split",
        "c_custkey * 17 AS seed")


@query("blueprint_selection", BLUEPRINT_SELECTION + """
SELECT request_id, id, section_type, CAST(position AS INT) AS position FROM final""")
def _(v):
    return S.select_for_blueprints(blueprints(v), v.questions).select("request_id", "id", "section_type", "position")


@query("draft_from_blueprints", BLUEPRINT_SELECTION + """
SELECT request_id AS paper_id, id AS question_id, CAST(position AS INT) AS position,
  CASE WHEN section_type = 'mcq' THEN 'Section A' ELSE 'Section B' END AS paper_section FROM final""")
def _(v):
    chosen = S.select_for_blueprints(blueprints(v), v.questions)
    return P.draft_rows(chosen.withColumnRenamed("request_id", "paper_id")).select(
        "paper_id", "question_id", "position", "paper_section")


@query("draft_papers", REQUEST_SELECTION + """
SELECT r.request_id AS id, 'draft' AS status, r.exam_name, r.subject, r.question_count AS total_questions, r.question_count AS section_a_count,
  0 AS section_b_count, array_to_string(r.chapters, ',') AS chapters, r.seed
FROM rreq r WHERE r.request_id IN (SELECT request_id FROM final)""")
def _(v):
    rows = drafting.draft_for_requests(v.resolved, v.questions)
    return P.draft_papers(v.resolved, rows).select(
        "id", "status", "blueprint.exam_name", "blueprint.subject", "blueprint.total_questions", "blueprint.section_a_count",
        "blueprint.section_b_count", F.array_join("blueprint.chapters", ",").alias("chapters"), "blueprint.seed")
