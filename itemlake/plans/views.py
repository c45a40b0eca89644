"""The driver's tables in the roles of the engine, as SQL both Spark and DuckDB understand.

``{name}`` stands for a table or an earlier view. Backslashes are written ``chr(92)``, because
the two dialects disagree about them inside string literals.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from itemlake.session import cut_lineage

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS = {
    # Text-rich questions.
    "q_docs": """
SELECT d.doc_id AS id, d.doc_id % 50 AS ingestion_id,
  concat('E', d.doc_id % 3) AS exam_name, d.lang AS subject, d.source AS chapter,
  CASE WHEN d.doc_id % 13 = 0 THEN '' WHEN d.doc_id % 7 = 0 THEN NULL ELSE concat('t', d.doc_id % 20) END AS topic,
  CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE 'sub' END AS subtopic,
  CASE WHEN d.doc_id % 11 = 0 THEN NULL WHEN d.n_chars < 800 THEN 'easy'
       WHEN d.n_chars < 3000 THEN 'medium' ELSE 'hard' END AS difficulty,
  CASE WHEN l.quality = 1 THEN 'conceptual' WHEN l.quality = 0 THEN 'numerical' END AS question_type,
  CASE WHEN d.doc_id % 4 = 0 THEN 'integer' ELSE 'mcq' END AS section_type,
  CASE WHEN d.doc_id % 10 = 0 THEN 'archived' ELSE 'active' END AS status,
  contains(d.text, '$') AS has_formula, d.doc_id % 7 = 0 AS has_diagram,
  CAST(nullif(d.doc_id % 30, 0) AS INT) AS question_number,
  CASE WHEN d.doc_id % 9 = 4 THEN d.doc_id - 4 END AS parent_question_id,
  CASE WHEN d.doc_id % 9 = 4 THEN 'ai_regenerated' ELSE 'ingested' END AS generation_type,
  d.text AS stem_md, CASE WHEN d.doc_id % 6 = 0 THEN NULL ELSE d.text END AS raw_text,
  d.doc_id * 60 AS created_at
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    # Wide, short questions; the bank behind requests and papers.
    "q_parts": """
SELECT p_partkey AS id, p_partkey % 40 AS ingestion_id, concat('E', p_partkey % 2) AS exam_name,
  lower(p_type) AS subject, CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE p_brand END AS chapter,
  CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 97 = 0 THEN 'extreme'
       WHEN p_size < 17 THEN 'easy' WHEN p_size < 34 THEN 'medium' ELSE 'hard' END AS difficulty,
  CASE WHEN p_partkey % 3 = 0 THEN 'conceptual' WHEN p_partkey % 3 = 1 THEN 'numerical' END AS question_type,
  CASE WHEN p_partkey % 4 = 0 THEN 'integer' ELSE 'mcq' END AS section_type,
  CASE WHEN p_partkey % 10 = 0 THEN 'archived' ELSE 'active' END AS status,
  p_partkey % 5 = 0 AS has_formula, p_partkey % 7 = 0 AS has_diagram,
  split(p_name, ' ') AS concepts, CAST(p_partkey % 30 AS INT) AS question_number,
  concat('Part $', p_size, '$ named ', p_name) AS stem_md,
  CASE WHEN p_partkey % 6 = 0 THEN '' ELSE concat(p_name, ' costs ', p_size) END AS raw_text,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS STRING) WHEN p_partkey % 4 = 1 THEN 'A'
       WHEN p_partkey % 4 = 2 THEN 'C' ELSE 'E' END AS answer,
  concat('first ', p_size) AS opt_a, concat('second ', p_name) AS opt_b, concat('third ', p_brand) AS opt_c,
  CASE WHEN p_partkey % 9 = 0 THEN concat('fig', p_partkey, '.jpg') END AS figure,
  p_partkey * 60 AS created_at
FROM {part}""",
    "syl": """
SELECT exam_name, subject, chapter_name, replace(chapter_name, '#', ' ') AS alias,
  CAST(row_number() OVER (PARTITION BY exam_name, subject ORDER BY chapter_name) AS INT) AS chapter_order
FROM (SELECT DISTINCT concat('E', p_partkey % 2) AS exam_name, lower(p_type) AS subject, p_brand AS chapter_name
      FROM {part}) AS b""",
    "paps": """
SELECT o_orderkey AS id, concat('order ', o_orderpriority) AS prompt,
  CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'draft' END AS status,
  CASE WHEN o_orderkey % 6 = 0 THEN 'noted' END AS notes,
  o_orderdate AS created_at, o_custkey AS custkey
FROM {orders}""",
    "pq0": """
SELECT l_orderkey AS paper_id, l_partkey AS question_id,
  min(l_linenumber) AS line, min(l_returnflag) AS flag, min(l_linestatus) AS linestatus
FROM {lineitem} GROUP BY l_orderkey, l_partkey""",
    # One blueprint request per customer, every mode, filter and error kind.
    "reqs": """
SELECT c_custkey AS request_id,
  CASE c_custkey % 13 WHEN 12 THEN 'E9' ELSE concat('E', c_custkey % 2) END AS exam_name,
  CASE c_custkey % 6 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'STANDARD' WHEN 2 THEN 'SMALL'
    WHEN 3 THEN 'PROMO' WHEN 4 THEN 'MEDIUM' ELSE 'LARGE' END AS subject,
  CASE c_custkey % 7 WHEN 0 THEN 'all' WHEN 1 THEN 'exact' WHEN 2 THEN 'upto' WHEN 3 THEN 'from'
    WHEN 4 THEN 'after' WHEN 5 THEN 'between' ELSE 'upto' END AS mode,
  CASE WHEN c_custkey % 7 = 6 THEN 'none'
       WHEN c_custkey % 4 = 1 THEN concat(' brand ', 1 + c_custkey % 25)
       WHEN c_custkey % 41 = 0 THEN 'no such chapter'
       ELSE concat('Brand#', 1 + c_custkey % 25) END AS name1,
  concat('Brand#', 1 + (c_custkey * 7) % 25) AS name2,
  CASE WHEN c_custkey % 5 = 0 THEN concat('Brand ', 1 + (c_custkey * 3) % 25) END AS exclude1,
  CAST(CASE WHEN c_custkey % 29 = 0 THEN 0 WHEN c_custkey % 7 = 1 THEN 2 ELSE 3 + c_custkey % 40 END AS INT) AS question_count,
  CASE WHEN c_custkey % 8 = 0 THEN 'easy' WHEN c_custkey % 67 = 0 THEN 'brutal' END AS difficulty,
  CASE WHEN c_custkey % 9 = 0 THEN CAST(1 AS INT) END AS dist_easy,
  CASE WHEN c_custkey % 10 = 0 THEN 'conceptual' END AS question_type,
  CASE WHEN c_custkey % 11 = 0 THEN 'mcq' WHEN c_custkey % 71 = 0 THEN 'essay' END AS section_type,
  CASE WHEN c_custkey % 12 = 0 THEN false END AS has_formula,
  CASE WHEN c_custkey % 14 = 0 THEN true END AS has_diagram,
  CASE WHEN c_custkey % 15 = 0 THEN 'ring' END AS concept1,
  CASE WHEN c_custkey % 30 = 0 THEN 'all' ELSE 'any' END AS concept_mode,
  c_custkey * 31 % 1000 AS seed
FROM {customer}""",
    # Blocks of inline-answer papers.
    "blk_inline": """
SELECT user_id AS doc_id, event_id AS block_idx,
  CASE WHEN event_type = 'signup' THEN 'image'
       WHEN event_type = 'error' AND event_id % 6 = 4 THEN 'equation' ELSE 'text' END AS type,
  CASE event_type
    WHEN 'view' THEN concat(1 + event_id % 90, '. Find the value ', event_id, ' of $x_', event_id % 7, '$')
    WHEN 'click' THEN CASE WHEN event_id % 5 = 0 THEN 'only (1) one'
      WHEN event_id % 5 = 1 THEN concat('Choose (1) a', event_id % 9, ' (2) b (3) c (4) d')
      ELSE concat('(1) a', event_id % 9, ' (2) b', event_id % 4, ' (3) c (4) d') END
    WHEN 'purchase' THEN concat('Ans. (', 1 + event_id % 4, ')')
    WHEN 'error' THEN CASE event_id % 6 WHEN 0 THEN 'see the note'
      WHEN 1 THEN CASE WHEN event_id % 5 = 1 THEN 'JOIN LEADER COURSE now' ELSE 'see figure' END
      WHEN 2 THEN CASE WHEN event_id % 4 = 0 THEN 'PHYSICS SECTION-A' ELSE 'Chemistry Section B' END
      WHEN 3 THEN 'TEST PAPER WITH ANSWER KEY' WHEN 4 THEN 'E = mc^2' ELSE '   ' END
    END AS text,
  CASE WHEN event_type = 'error' AND event_id % 6 IN (2, 3) THEN 1 END AS text_level,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(event_id % 50 AS INT) END AS page_idx,
  CASE WHEN event_type = 'signup' THEN concat('images/', user_id, '/', event_id, '.jpg') END AS img_path,
  CAST(NULL AS STRING) AS html
FROM {events}""",
    # Blocks of full papers: numbered starts, options in all forms, noise, a key at the end.
    "blk_full": """
SELECT user_id AS doc_id, event_id AS block_idx,
  CASE WHEN event_type = 'signup' THEN 'image'
       WHEN event_type = 'purchase' AND event_id % 4 = 3 THEN 'equation' ELSE 'text' END AS type,
  CASE event_type
    WHEN 'view' THEN CASE WHEN event_id % 13 = 0 THEN concat('Q', 10 + event_id % 90, '. ')
      WHEN event_id % 3 = 0 THEN concat(1 + event_id % 120, ') Evaluate ', event_id, ' (1) u (2) v')
      ELSE concat('Q', 1 + event_id % 120, '. Evaluate ', event_id) END
    WHEN 'click' THEN concat('(1) a', event_id % 3, ' (2) b (3) c (4) d')
    WHEN 'purchase' THEN CASE event_id % 4 WHEN 0 THEN '(13) $p$ $q$' WHEN 1 THEN '(24) $r$  $s$'
      WHEN 2 THEN concat('where   k is ', event_id % 10)
      ELSE concat('$$', chr(92), 'begin{{array}}{{c}}{{{{ 1) e', event_id % 5, ' }}}} ', chr(92), chr(92),
                  ' {{{{ 3) f }}}}', chr(92), 'end{{array}}$$') END
    WHEN 'error' THEN CASE event_id % 6 WHEN 0 THEN 'MathonGo' WHEN 1 THEN '2025 (22 Jan Shift 1) JEE Main'
      WHEN 2 THEN 'SECTION-B' WHEN 3 THEN '12' WHEN 4 THEN 'given mathongo data' ELSE 'JEE Main Previous Year Paper' END
    END AS text,
  CAST(NULL AS INT) AS text_level, CAST(event_id % 50 AS INT) AS page_idx,
  CASE WHEN event_type = 'signup' THEN concat('images/', event_id, '.jpg') END AS img_path,
  CAST(NULL AS STRING) AS html
FROM {events}
UNION ALL
SELECT DISTINCT user_id, 1000000000000, 'text', 'ANSWER KEYS', CAST(NULL AS INT), 99,
  CAST(NULL AS STRING), CAST(NULL AS STRING)
FROM {events} WHERE user_id % 5 <> 0
UNION ALL
SELECT DISTINCT user_id, 1000000000001 + event_id % 120, CASE WHEN event_id % 120 % 2 = 0 THEN 'text' ELSE 'table' END,
  CASE WHEN event_id % 120 % 2 = 0 THEN concat(1 + event_id % 120, '.(', 1 + event_id % 120 % 5, ')') END,
  CAST(NULL AS INT), 99, CAST(NULL AS STRING),
  CASE WHEN event_id % 120 % 2 = 1 THEN concat('<td>', 1 + event_id % 120, '. ( ', 1 + event_id % 120 % 5, ' )</td>') END
FROM {events} WHERE user_id % 5 <> 0 AND event_id % 120 % 7 <> 0 AND event_type IN ('view', 'click')""",
    # Blocks of papers with a separate key.
    "blk_sep": """
SELECT user_id AS doc_id, event_id AS block_idx,
  CASE WHEN event_type = 'signup' THEN 'image' ELSE 'text' END AS type,
  CASE event_type
    WHEN 'view' THEN concat(1 + event_id % 90, '. Determine the quantity ', event_id)
    WHEN 'click' THEN concat('(1) a', event_id % 9, ' (2) b (3) c (4) d')
    WHEN 'purchase' THEN 'with the usual symbols' WHEN 'error' THEN 'figure below' END AS text,
  CAST(NULL AS INT) AS text_level, CAST(event_id % 50 AS INT) AS page_idx,
  CASE WHEN event_type = 'signup' THEN concat('images/', event_id, '.jpg') END AS img_path,
  CAST(NULL AS STRING) AS html
FROM {events}
UNION ALL
SELECT DISTINCT user_id, 1000000000000, 'text', 'Answer Key', CAST(NULL AS INT), 99,
  CAST(NULL AS STRING), CAST(NULL AS STRING)
FROM {events}
UNION ALL
SELECT DISTINCT user_id, 1000000000001 + event_id % 90, 'text',
  concat(1 + event_id % 90, '.(', 1 + event_id % 90 % 4, ') ', 1 + (event_id + 1) % 90, '.(', 4 - event_id % 90 % 4, ')'),
  CAST(NULL AS INT), 99, CAST(NULL AS STRING), CAST(NULL AS STRING)
FROM {events} WHERE event_id % 90 % 6 <> 0""",
    # Ingestion events.
    "ing": """
SELECT user_id AS ingestion_id, event_id AS seq, ts,
  CASE event_type WHEN 'signup' THEN 'UPLOADED' WHEN 'view' THEN 'MINERU_COMPLETE' WHEN 'click' THEN 'QUESTIONS_BUILT'
    WHEN 'purchase' THEN 'METADATA_COMPLETE' ELSE CASE WHEN event_id % 2 = 0 THEN 'FAILED' ELSE 'SAVED' END END AS status,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN concat('failed with ', props) END AS error
FROM {events}""",
    "ingestions": """
SELECT c_custkey AS id, concat(c_name, '.pdf') AS filename,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'SAVED' WHEN 'MACHINERY' THEN 'FAILED' WHEN 'BUILDING' THEN 'UPLOADED'
    ELSE 'QUESTIONS_BUILT' END AS status,
  CASE c_nationkey % 6 WHEN 0 THEN ' jee mains ' WHEN 1 THEN 'NEET UG 2025' WHEN 2 THEN 'JEE Main 2024 April'
    WHEN 3 THEN 'Olympiad' WHEN 4 THEN '  ' ELSE NULL END AS exam_raw,
  CASE c_nationkey % 5 WHEN 0 THEN 'Maths' WHEN 1 THEN ' PHY ' WHEN 2 THEN 'Zoology' WHEN 3 THEN '' ELSE NULL END AS subject_raw,
  CASE c_custkey % 6 WHEN 0 THEN 'inline_answer' WHEN 1 THEN 'full_paper' WHEN 2 THEN 'separate_answer_key'
    WHEN 3 THEN 'with_solution' WHEN 4 THEN 'columns' ELSE NULL END AS layout_type,
  CAST(floor(c_acctbal) AS INT) AS created_at
FROM {customer}""",
    # Rows whose text carries LaTeX, options and responses in many spellings.
    "latex": """
SELECT p_partkey AS id,
  concat('Let $$a_', p_size, '$$ and $b^2$ be ', chr(92), 'mathrm{{', p_name, '}} plus ', chr(92), 'alpha in {{', p_brand, '}}') AS mixed,
  concat('speed 3.', p_size, ' ', chr(92), 'text{{ m/s}}^2 near $x$ or ', chr(92), 'frac{{a}}{{b}} of ', p_name) AS bare,
  CASE p_partkey % 5
    WHEN 0 THEN concat('$$', chr(92), 'begin{{array}}{{c}}{{{{ 1) ', p_size, ' }}}} ', chr(92), chr(92), ' {{{{ 3) ', p_name, ' }}}}', chr(92), 'end{{array}}$$')
    WHEN 1 THEN concat('$$', chr(92), 'begin {{ array }} {{ cc }} {{ {{ ', chr(92), 'left( 2 ', chr(92), 'right) ', p_size, ' }} }} & {{ {{ ', chr(92), 'left( 4 ', chr(92), 'right) ', p_brand, ' }} }} ', chr(92), 'end {{ array }}$$')
    WHEN 2 THEN concat('$$', chr(92), 'begin{{array}}{{c}}{{{{ 1) alone }}}}', chr(92), 'end{{array}}$$')
    WHEN 3 THEN concat('( $', chr(92), 'begin{{array}}{{c}}{{{{ 2) ', p_size, ' }}}} ', chr(92), chr(92), ' {{{{ 4) ', p_name, ' }}}}', chr(92), 'end{{array}}$ )')
    ELSE 'x^2 = 4' END AS cells,
  CASE p_partkey % 4 WHEN 0 THEN concat('(13) $', p_size, '$ $', p_name, '$') WHEN 1 THEN concat('(24) left ', p_size, '  right')
    WHEN 2 THEN '(13) nothing' ELSE concat('(1) ', p_name) END AS merged,
  concat('```json ', chr(123), '"chapter": "', CASE p_partkey % 3 WHEN 0 THEN 'SHM' WHEN 1 THEN 'null' ELSE p_brand END,
    '", "topic": "', chr(92), 'theta ', p_name, '", "difficulty": "easy", "subject": "',
    CASE p_partkey % 4 WHEN 0 THEN 'Physics (mechanics)' WHEN 1 THEN 'Maths' WHEN 2 THEN 'History' ELSE 'none' END,
    '", "concepts": ["', p_type, '", ""], "has_formula": ', CASE p_partkey % 2 WHEN 0 THEN 'true' ELSE '"no"' END,
    ', "has_diagram": false', CASE WHEN p_partkey % 17 = 0 THEN '' ELSE chr(125) END, ' ```') AS response
FROM {part}""",
}


class Views:
    """Tables and views of one data folder as DataFrames."""

    SHORT = 4096

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in TABLES and name not in VIEWS):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        used = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", VIEWS[name])) & (set(TABLES) | set(VIEWS))
        return self.spark.sql(VIEWS[name], **{u: getattr(self, u) for u in used})

    @cached_property
    def syllabus(self) -> DataFrame:
        return self.syl.selectExpr("exam_name", "subject", "chapter_order", "chapter_name",
                                   "array(alias) AS chapter_aliases")

    @cached_property
    def questions(self) -> DataFrame:
        """``q_parts`` with options and images in the bank's types."""
        return self.q_parts.selectExpr(
            "*",
            "CASE WHEN section_type = 'mcq' THEN map('A', opt_a, 'B', opt_b, 'C', opt_c) "
            "ELSE cast(map() AS map<string,string>) END AS options",
            "CASE WHEN figure IS NULL THEN cast(array() AS array<struct<filename:string,position:string>>) "
            "ELSE array(named_struct('filename', figure, 'position', 'stem')) END AS images")

    @cached_property
    def papers(self) -> DataFrame:
        return self.paps.selectExpr(
            "id", "prompt", "status", "notes", "created_at",
            "named_struct('exam_name', concat('E', custkey % 2), 'subject', 'small', 'seed', id * 7) AS blueprint")

    @cached_property
    def paper_rows(self) -> DataFrame:
        """Paper rows with dense positions by line and part.

        Papers of at most ``SHORT`` lines are dealt whole, so one shuffle serves both grouping and positions; larger ones, and
        lines without a paper, number or question, are split by ``ordered_scan``.
        """
        from pyspark.sql import Window
        from pyspark.sql import functions as F

        from itemlake.operators.ordered import by_range, ordered_scan
        open_order = F.col("l_linenumber").isNull() | F.col("l_partkey").isNull()
        large = cut_lineage(self.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(open_order).alias("open")).filter(
            F.col("l_orderkey").isNull() | (F.col("n") > self.SHORT) | (F.col("open") > 0)).select("l_orderkey"))

        def grouped(lines: DataFrame) -> DataFrame:
            return self.spark.sql(VIEWS["pq0"], lineitem=lines.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"))

        short = self.lineitem.filter(F.col("l_orderkey").isNotNull()).join(large, "l_orderkey", "left_anti")
        order = Window.partitionBy("paper_id").orderBy("line", "question_id")
        placed = grouped(short.repartition("l_orderkey")).withColumn("__p", F.row_number().over(order) - 1)
        if not large.isEmpty():
            split = self.lineitem.join(large, self.lineitem["l_orderkey"].eqNullSafe(large["l_orderkey"]), "left_semi")
            placed = placed.unionByName(ordered_scan(grouped(split), ["paper_id"], ["line", "question_id"],
                                                     buckets=[F.col("line"), by_range("question_id")], position="__p"))
        return cut_lineage(placed.selectExpr(
            "paper_id", "question_id", "cast(__p + 1 AS int) AS position",
            "CASE flag WHEN 'A' THEN 'Section A' WHEN 'N' THEN 'Section B' END AS paper_section",
            "cast(__p + 1 AS int) AS display_number", "linestatus = 'F' AS locked"))

    @cached_property
    def full_blocks(self) -> DataFrame:
        return cut_lineage(self.blk_full)

    @cached_property
    def cleaned_blocks(self) -> DataFrame:
        from itemlake.operators.clean import clean_blocks
        return cut_lineage(clean_blocks(cut_lineage(self.blk_inline)))

    @cached_property
    def resolved(self) -> DataFrame:
        """Requests with concrete chapters, names matched exactly or by alias."""
        from itemlake.plans.drafting import resolve
        return resolve(self.requests, self.syllabus, fuzzy=False)

    @cached_property
    def requests(self) -> DataFrame:
        """``reqs`` in the shape of the request schema."""
        return self.reqs.selectExpr(
            "request_id", "exam_name", "subject", "mode AS chapter_filter_mode",
            "name1 AS chapter", "name1 AS chapter_upto", "name1 AS chapter_from", "name2 AS chapter_to",
            "name1 AS chapter_after",
            "CASE WHEN exclude1 IS NULL THEN cast(array() AS array<string>) ELSE array(exclude1) END AS exclude_chapters",
            "question_count", "difficulty",
            "CASE WHEN dist_easy IS NOT NULL THEN array(named_struct('tier', 'hard', 'n', 1), "
            "named_struct('tier', 'easy', 'n', question_count - 1)) END AS difficulty_distribution",
            "question_type", "section_type", "has_formula", "has_diagram",
            "CASE WHEN concept1 IS NULL THEN cast(array() AS array<string>) ELSE array(concept1, 'widget') END AS concepts",
            "concept_mode AS concept_match_mode", "seed")


EXTRA = {
    # DuckDB counterparts of the typed frames above.
    "pq": """
SELECT paper_id, question_id, CAST(pos AS INT) AS position,
  CASE flag WHEN 'A' THEN 'Section A' WHEN 'N' THEN 'Section B' END AS paper_section,
  CAST(pos AS INT) AS display_number, linestatus = 'F' AS locked
FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY line, question_id) AS pos FROM {pq0}) AS p""",
    "nreq": """
SELECT * EXCLUDE (subject, mode), lower(subject) AS subject,
  CASE WHEN mode <> 'all' AND lower(trim(name1)) IN ('none', 'null', '') THEN 'all' ELSE mode END AS mode
FROM {reqs}""",
    "vreq": """
SELECT * FROM {nreq} WHERE question_count BETWEEN 1 AND 200
  AND (difficulty IS NULL OR difficulty IN ('easy', 'medium', 'hard'))
  AND (section_type IS NULL OR section_type IN ('mcq', 'integer'))
  AND NOT (difficulty IS NOT NULL AND dist_easy IS NOT NULL)""",
    "hits": """
SELECT v.request_id, count(s.chapter_name) AS total,
  coalesce(min(CASE WHEN lower(s.chapter_name) = lower(trim(v.name1)) THEN s.chapter_order END),
           min(CASE WHEN lower(s.alias) = lower(trim(v.name1)) THEN s.chapter_order END)) AS o1,
  bool_or(lower(s.chapter_name) = lower(trim(v.name1))) AS exact1,
  min(CASE WHEN s.chapter_name = v.name2 THEN s.chapter_order END) AS o2,
  min(CASE WHEN s.alias = v.exclude1 THEN s.chapter_order END) AS ox
FROM {vreq} v LEFT JOIN {syl} s ON s.exam_name = v.exam_name AND s.subject = v.subject GROUP BY v.request_id""",
    "ranged": """
SELECT v.*, h.total, h.o1, h.o2, h.ox, h.exact1,
  CASE mode WHEN 'all' THEN 1 WHEN 'exact' THEN o1 WHEN 'upto' THEN 1 WHEN 'from' THEN o1 WHEN 'after' THEN o1 + 1
    ELSE least(o1, o2) END AS lo,
  CASE mode WHEN 'exact' THEN o1 WHEN 'upto' THEN o1 WHEN 'between' THEN greatest(o1, o2) ELSE 9999 END AS hi
FROM {vreq} v JOIN {hits} h USING (request_id)""",
    "listed": """
SELECT r.request_id, list(s.chapter_name ORDER BY s.chapter_order)
    FILTER (s.chapter_order BETWEEN r.lo AND r.hi AND s.chapter_order IS DISTINCT FROM r.ox) AS kept,
  count(*) FILTER (s.chapter_order BETWEEN r.lo AND r.hi) AS in_range,
  max(CASE WHEN s.chapter_order = r.o1 THEN s.chapter_name END) AS n1,
  max(CASE WHEN s.chapter_order = r.o2 THEN s.chapter_name END) AS n2,
  max(CASE WHEN s.chapter_order = r.ox THEN s.chapter_name END) AS excluded
FROM {ranged} r LEFT JOIN {syl} s ON s.exam_name = r.exam_name AND s.subject = r.subject GROUP BY r.request_id""",
    "judged": """
SELECT r.*, coalesce(l.kept, []) AS chapters, l.excluded, l.n1, l.n2,
  CASE WHEN r.total = 0 THEN 'SyllabusNotFound'
    WHEN r.mode <> 'all' AND r.o1 IS NULL OR r.mode = 'between' AND r.o2 IS NULL THEN 'ChapterNotFound'
    WHEN r.mode = 'after' AND l.in_range = 0 THEN 'EmptyRange'
    WHEN r.exclude1 IS NOT NULL AND r.ox IS NULL THEN 'ChapterNotFound'
    WHEN r.mode <> 'all' AND len(coalesce(l.kept, [])) = 0 THEN 'EmptyRange' END AS problem
FROM {ranged} r JOIN {listed} l USING (request_id)""",
    "rreq": "SELECT * FROM {judged} WHERE problem IS NULL",
    "cand": """
SELECT r.request_id, q.*
FROM {rreq} r JOIN {q_parts} q ON q.exam_name = r.exam_name AND q.subject = r.subject
WHERE q.status = 'active' AND (len(r.chapters) = 0 OR list_contains(r.chapters, q.chapter))
  AND (r.excluded IS NULL OR q.chapter <> r.excluded)
  AND (r.difficulty IS NULL OR q.difficulty = r.difficulty)
  AND (r.question_type IS NULL OR q.question_type = r.question_type)
  AND (r.section_type IS NULL OR q.section_type = r.section_type)
  AND (r.has_formula IS NULL OR q.has_formula = r.has_formula)
  AND (r.has_diagram IS NULL OR q.has_diagram = r.has_diagram)
  AND (r.concept1 IS NULL OR CASE WHEN r.concept_mode = 'all' THEN list_has_all(q.concepts, [r.concept1, 'widget'])
       ELSE list_has_any(q.concepts, [r.concept1, 'widget']) END)"""

}


def oracle(sql: str) -> str:
    """Put the views a statement uses in front of it as common table expressions."""
    texts = {**VIEWS, **EXTRA}
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed:
            return
        for other in re.findall(r"(?<!\{)\{(\w+)\}(?!\})", texts[name]):
            if other in texts:
                visit(other)
        needed.append(name)

    for name in texts:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    names = {n: n for n in [*TABLES, *texts]}
    ctes = [f"{n} AS ({texts[n].format(**names).strip()})" for n in needed]
    body = sql.strip()
    for opening in ("WITH RECURSIVE ", "WITH "):
        if ctes and body.startswith(opening):
            return opening + ",\n".join(ctes) + ",\n" + body.removeprefix(opening)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
