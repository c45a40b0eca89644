"""Files, sinks and streams."""

import json

from pyspark.sql import functions as F

from itemlake.operators import export
from itemlake.operators import layouts as L
from itemlake.operators.clean import clean_blocks
from itemlake.plans import drafting
from itemlake.plans.ingest import documents_to_bank, documents_to_questions, save_documents
from itemlake.sources import content, sinks
from itemlake.streaming.ingest import start_bank_ingestion, start_ingestion

OPT = "(1) a (2) b (3) c (4) d"


def write_docs(folder, names):
    for n, name in enumerate(names):
        blocks = []
        for q in range(1, 4):
            blocks += [{"type": "text", "text": f"{q}. question {n}", "page_idx": q}, {"type": "image", "img_path": f"images/{q}.jpg"},
                       {"type": "text", "text": OPT, "page_idx": q}, {"type": "text", "text": f"Ans. ({q})", "page_idx": q}]
        (folder / f"{name}_content_list.json").write_text(json.dumps(blocks))


def test_stream_equals_batch(spark, tmp_path):
    docs = tmp_path / "in"
    docs.mkdir()
    plan = lambda b: L.build_inline(clean_blocks(b)).select("doc_id", "question_number", "stem_md", "answer")
    write_docs(docs, ["one", "two"])
    args = (spark, str(docs), str(tmp_path / "out"), str(tmp_path / "cp"), plan, 1)
    start_ingestion(*args).awaitTermination()
    write_docs(docs, ["one", "two", "three"])  # a later run reads only what is new
    start_ingestion(*args).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    batch = plan(content.read_content_lists(spark, str(docs)))
    assert {r.doc_id for r in got.collect()} == {"one", "two", "three"}
    assert got.filter("doc_id = 'three'").count() == 3
    assert batch.filter("doc_id = 'three'").exceptAll(got.filter("doc_id = 'three'")).count() == 0


def test_documents_to_bank(spark, tmp_path):
    docs = tmp_path / "in"
    docs.mkdir()
    write_docs(docs, ["d1", "d2"])
    images = tmp_path / "images" / "d1"
    images.mkdir(parents=True)
    (images / "1.jpg").write_bytes(b"x")
    blocks = content.read_content_lists(spark, str(docs))
    uploads = spark.createDataFrame([("d1", "d1.pdf", "inline_answer", "JEE Main", "physics"), ("d2", "d2.pdf", "inline_answer", "NEET", "biology")],
                                    "id string, filename string, layout_type string, exam_name string, subject string")
    answers = spark.createDataFrame([("d1", 0, '{"chapter": "SHM", "subject": "chem", "difficulty": "easy", "concepts": ["k"]}'), ("d1", 0, "garbage"),
                                     ("d1", 4, "garbage")], "doc_id string, start_idx long, response string")
    bank = documents_to_bank(blocks, uploads, answers, content.read_image_listing(spark, str(tmp_path / "images")))
    rows = {(r.ingestion_id, r.question_number): r for r in bank.collect()}
    assert len(rows) == 6
    first = rows["d1", 1]
    assert (first.chapter, first.subject, first.has_diagram, first.raw_text) == ("Oscillations", "chemistry", True, "1. question 0 a b c d")
    assert rows["d1", 2].subject == "physics" and rows["d1", 2].images == [] and rows["d2", 3].exam_name == "NEET"
    assert len({r.id for r in rows.values()}) == 6 and first.created_at is not None
    path = str(tmp_path / "bank")
    sinks.append_questions(bank.drop("warnings"), path)
    assert spark.read.parquet(path).filter(F.col("exam_name") == "NEET").count() == 3


def test_repeated_numbers_stay_one_row_each_up_to_drafts(spark, tmp_path):
    docs = tmp_path / "in"
    docs.mkdir()
    blocks = [b for stem in ("first", "second") for b in (  # numbering starts again, as for the next subject
        {"type": "text", "text": f"1. {stem} question"}, {"type": "text", "text": OPT}, {"type": "text", "text": "Ans. (1)"})]
    (docs / "d_content_list.json").write_text(json.dumps(blocks))
    read = content.read_content_lists(spark, str(docs))
    uploads = spark.createDataFrame([("d", "d.pdf", "inline_answer", "JEE Main", "physics")],
                                    "id string, filename string, layout_type string, exam_name string, subject string")
    answers = spark.createDataFrame([("d", 0, '{"chapter": "A", "difficulty": "easy"}'), ("d", 3, '{"chapter": "B", "difficulty": "hard"}')],
                                    "doc_id string, start_idx long, response string")
    bank = documents_to_bank(read, uploads, answers)
    assert sorted((r.question_number, r.chapter, r.stem_md.split()[1]) for r in bank.collect()) == [(1, "A", "first"), (1, "B", "second")]
    ready = spark.createDataFrame([(7, "JEE Main", "physics", ["A", "B"], 2, 5)],
                                  "request_id long, exam_name string, subject string, resolved_chapters array<string>, question_count int, seed long")
    for name in ("difficulty", "question_type", "section_type"):
        ready = ready.withColumn(name, F.lit(None).cast("string"))
    ready = ready.withColumns({"has_formula": F.lit(None).cast("boolean"), "has_diagram": F.lit(None).cast("boolean"),
                               "excluded_chapters": F.array().cast("array<string>"), "concepts": F.array().cast("array<string>"),
                               "concept_match_mode": F.lit("any"),
                               "difficulty_distribution": F.array().cast("array<struct<tier:string,n:int>>")})
    drafts = drafting.draft_for_requests(ready, bank)
    assert {r.question_id for r in drafts.collect()} == {r.id for r in bank.collect()}


def test_unreadable_content_lists_are_told(spark, tmp_path):
    docs = tmp_path / "in" / "deep"
    docs.mkdir(parents=True)
    write_docs(docs, ["good"])
    for name, text in (("broken", '[{"type": "text", '), ("object", '{"type": "text", "text": "1. a"}'), ("blank", " "), ("none", "[]")):
        (docs / f"{name}_content_list.json").write_text(text)
    raw = content.raw_content_lists(spark, str(tmp_path / "in"))
    assert {r.doc_id for r in content.rejected_content_lists(raw).collect()} == {"deep/broken", "deep/object", "deep/blank"}
    assert {r.doc_id for r in content.parse_content_lists(raw).collect()} == {"deep/good"}
    start_ingestion(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: b).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == content.read_content_lists(spark, str(tmp_path / "in")).count() == 12


def test_markdown_files(spark, tmp_path):
    parts = spark.createDataFrame([(1, 0, "a\nb"), (2, 0, "c")], "paper_id long, part int, markdown string")
    sinks.write_markdown_files(parts, str(tmp_path / "md"))
    back = spark.read.text(str(tmp_path / "md"), wholetext=True)
    assert {(r.paper_id, r.value.strip()) for r in back.collect()} == {(1, "a\nb"), (2, "c")}


def test_document_warnings_stand_with_the_first_question(spark, tmp_path):
    docs = tmp_path / "in"
    docs.mkdir()
    blocks = [{"type": "text", "text": x} for x in ("Q1. Stem.", OPT, "Q2. Next.", OPT, "ANSWER KEYS", "1.(1) 2.(3) 12.(2) 3.(4)")]
    (docs / "d_content_list.json").write_text(json.dumps(blocks))
    read = content.read_content_lists(spark, str(docs))
    uploads = spark.createDataFrame([("d", "full_paper")], "doc_id string, layout_type string")
    rows = {r.question_number: r.warnings for r in documents_to_questions(read, uploads).collect()}
    assert rows[1] == [f"answer key contains Q{n} with no built question" for n in (3, 12)] and rows[2] == []


def test_equal_file_names_stay_two_documents(spark, tmp_path):
    for folder in ("a b+c", "d%20", "."):
        (tmp_path / "in" / folder).mkdir(parents=True, exist_ok=True)
        write_docs(tmp_path / "in" / folder, ["paper"])
    for root in (tmp_path / "in", f"file://{tmp_path}/in/"):
        counts = content.read_content_lists(spark, str(root)).groupBy("doc_id").count().collect()
        assert {r.doc_id: r["count"] for r in counts} == {"a b+c/paper": 12, "d%20/paper": 12, "paper": 12}
    (tmp_path / "images" / "a b+c" / "paper").mkdir(parents=True)
    (tmp_path / "images" / "a b+c" / "paper" / "1.jpg").write_bytes(b"x")
    assert [tuple(r) for r in content.read_image_listing(spark, str(tmp_path / "images")).collect()] == [("a b+c/paper", "1.jpg")]


def test_bank_from_stream_equals_batch_and_survives_replays(spark, tmp_path):
    docs, bank, once = tmp_path / "in", str(tmp_path / "bank"), str(tmp_path / "once")
    (docs / "x").mkdir(parents=True)
    write_docs(docs, ["d1"])
    write_docs(docs / "x", ["d1"])
    (docs / "bad_content_list.json").write_text("{")
    (docs / "stray_content_list.json").write_text("[]")
    uploads = spark.createDataFrame([(n, f"{n}.pdf", "inline_answer", "JEE Main", s) for n, s in (("d1", "physics"), ("x/d1", "biology"), ("bad", "physics"))],
                                    "id string, filename string, layout_type string, exam_name string, subject string")
    answers = spark.createDataFrame([("d1", 0, '{"chapter": "SHM", "difficulty": "easy"}')], "doc_id string, start_idx long, response string")
    start_bank_ingestion(spark, str(docs), bank, str(tmp_path / "cp"), uploads, answers, files_per_batch=1).awaitTermination()
    raw = content.raw_content_lists(spark, str(docs))
    save_documents(raw, uploads, answers, once, 0)
    rows = documents_to_bank(content.parse_content_lists(raw), uploads, answers)
    shown = [c for c in rows.columns if c != "created_at"]
    saved = lambda path: {str(r) for r in sinks.read_bank(spark, path, rows.schema).select(shown).collect()}
    states = lambda path: {tuple(r) for r in sinks.read_bank_documents(spark, path).drop("batch").collect()}
    want = saved(once)
    assert len(want) == 6 and saved(bank) == want == {str(r) for r in rows.select(shown).collect()}
    assert states(bank) == states(once) == {("d1", "completed", None), ("x/d1", "completed", None), ("bad", "failed", "no JSON array"),
                                            ("stray", "failed", "no ingestion of this name")}
    save_documents(raw, uploads, answers, once, 0)  # the same batch again, then a document that comes again with fewer questions
    assert saved(once) == want
    (docs / "d1_content_list.json").write_text("[]")
    save_documents(content.raw_content_lists(spark, str(docs)).filter("doc_id = 'd1'"), uploads, answers, once, 1)
    assert {r.ingestion_id for r in sinks.read_bank(spark, once, rows.schema).collect()} == {"x/d1"}


def test_packed_documents_span_files_and_share_them(spark, tmp_path):
    lines = [(1, i, f"line é {i}\nsecond") for i in range(2000)] + [(p, 1, f"paper {p}") for p in range(2, 40)] + [(2, 0, ""), (3, 0, None)]
    table = spark.createDataFrame(lines, "paper_id long, position long, markdown string").repartition(5)
    path = str(tmp_path / "packed")
    sinks.write_documents(table, path, size=8 << 10)
    want = {}
    for paper, _, text in sorted((x for x in lines if x[2] is not None), key=lambda x: x[:2]):
        want[paper] = f"{want[paper]}\n{text}" if paper in want else text
    assert {r.paper_id: r.markdown for r in sinks.read_documents(spark, path).collect()} == want
    assert {r.paper_id: r.markdown for r in export.documents(table, part=100).collect()} == want
    index = spark.read.parquet(f"{path}/index")
    assert index.filter("paper_id = 1").count() > 1 and index.groupBy("file").count().filter("count > 1").count() > 0
    asked = spark.createDataFrame([(1,), (7,), (7,), (99,)], "paper_id long")
    assert {r.paper_id: r.markdown for r in sinks.read_documents(spark, path, asked).collect()} == {p: want[p] for p in (1, 7)}
    sinks.write_documents(table.filter("paper_id < 0"), str(tmp_path / "none"))


def test_bank_files_are_in_number_order(spark, tmp_path):
    rows = spark.createDataFrame([("E", "s", f"d{d}", n, d * 10 + i) for d in range(4) for i, n in enumerate([9, None, 2, 5])],
                                 "exam_name string, subject string, ingestion_id string, question_number int, id long").repartition(4)
    told = spark.createDataFrame([(f"d{d}", "completed", None) for d in range(4)], "doc_id string, status string, reason string")
    sinks.save_bank_batch(rows, told, str(tmp_path), 0)
    back = spark.read.parquet(f"{tmp_path}/rows/batch=0").select("*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    seen = {}
    for r in back.orderBy("at").collect():
        seen.setdefault(r.ingestion_id, []).append(r.question_number)
    assert seen == {f"d{d}": [None, 2, 5, 9] for d in range(4)}


def test_packed_documents_carry_no_file_on(spark, tmp_path):
    from pyspark.sql import functions as F
    rows = spark.range(300).select((F.col("id") % 40).alias("paper_id"), F.col("id").alias("position"), F.concat(F.lit("é "), "id").alias("markdown"))
    sinks.write_documents(rows, str(tmp_path / "packed"), size=1 << 10)
    out = sinks.read_documents(spark, str(tmp_path / "packed"))
    want = {p: "\n".join(f"é {i}" for i in range(p, 300, 40)) for p in range(40)}
    assert {r.paper_id: r.markdown for r in out.collect()} == want
    # A row per paper that still holds its whole file was a copy of the file for each.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    exploded = plan[:plan.index("Generate explode")].splitlines()
    assert not any("content#" in line for line in exploded), plan
