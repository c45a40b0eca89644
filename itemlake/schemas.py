"""Declared schemas. Nothing in the package infers a schema from data."""

from pyspark.sql import types as T

BLOCK_FIELDS = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("text_level", T.IntegerType()),
    T.StructField("page_idx", T.IntegerType()),
    T.StructField("img_path", T.StringType()),
    T.StructField("html", T.StringType()),
])
CONTENT_LIST = T.ArrayType(BLOCK_FIELDS)
BLOCKS = T.StructType(
    [T.StructField("doc_id", T.StringType()), T.StructField("block_idx", T.LongType())]
    + BLOCK_FIELDS.fields
)

SYLLABUS = T.StructType([
    T.StructField("exam_name", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("chapter_order", T.IntegerType()),
    T.StructField("chapter_name", T.StringType()),
    T.StructField("chapter_aliases", T.ArrayType(T.StringType())),
])
SYLLABUS_SEED = T.StructType([
    T.StructField("exam_name", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("chapters", T.ArrayType(T.StructType([
        T.StructField("chapter_name", T.StringType()),
        T.StructField("chapter_aliases", T.ArrayType(T.StringType())),
    ]))),
])

TIER_COUNT = T.StructType([
    T.StructField("tier", T.StringType()), T.StructField("n", T.IntegerType()),
])
REQUESTS = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("exam_name", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("chapter_filter_mode", T.StringType()),
    T.StructField("chapter", T.StringType()),
    T.StructField("chapter_upto", T.StringType()),
    T.StructField("chapter_from", T.StringType()),
    T.StructField("chapter_to", T.StringType()),
    T.StructField("chapter_after", T.StringType()),
    T.StructField("exclude_chapters", T.ArrayType(T.StringType())),
    T.StructField("question_count", T.IntegerType()),
    T.StructField("difficulty", T.StringType()),
    T.StructField("difficulty_distribution", T.ArrayType(TIER_COUNT)),
    T.StructField("question_type", T.StringType()),
    T.StructField("section_type", T.StringType()),
    T.StructField("has_formula", T.BooleanType()),
    T.StructField("has_diagram", T.BooleanType()),
    T.StructField("concepts", T.ArrayType(T.StringType())),
    T.StructField("concept_match_mode", T.StringType()),
    T.StructField("seed", T.LongType()),
])

IMAGE = T.StructType([
    T.StructField("filename", T.StringType()), T.StructField("position", T.StringType()),
])
QUESTION_COLUMNS = [
    "doc_id", "question_number", "stem_md", "options", "answer", "section_type",
    "section_label", "images", "source_page", "subject", "warnings",
]
BANK_COLUMNS = [
    "ingestion_id", "source_pdf", "source_page", "question_number", "stem_md", "options",
    "answer", "images", "section_type", "section_label", "exam_name", "subject", "chapter",
    "topic", "subtopic", "difficulty", "question_type", "concepts", "has_diagram",
    "has_formula", "llm_raw_response", "raw_text", "status", "generation_type",
    "parent_question_id",
]
LIST_COLUMNS = [
    "id", "question_number", "subject", "chapter", "topic", "difficulty", "question_type",
    "has_diagram", "has_formula", "section_type", "status", "generation_type",
    "parent_question_id",
]
PAPER_LIST_COLUMNS = ["id", "prompt", "status", "created_at"]
INGESTION_LIST_COLUMNS = [
    "id", "filename", "status", "exam_name", "subject", "layout_type", "questions_saved",
    "created_at",
]
