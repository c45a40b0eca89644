"""Documents to bank rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlake.functions.metadata import metadata_columns, recover_json
from itemlake.operators import bank, clean, layouts
from itemlake.session import cut_lineage
from itemlake.sources import content, sinks


def normalized_metadata(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """``responses (doc_id, start_idx, response)`` as one metadata row per built question that has any.

    A question is named by its document and the block it starts at, as numbers may repeat. Of several
    responses the least readable one counts; a response that is no JSON gives empty metadata.
    """
    answer = F.struct(recover_json(F.col("response")).isNull().alias("broken"), "response")
    single = responses.groupBy("doc_id", "start_idx").agg(F.min(answer)["response"].alias("response"))
    images = questions.select("doc_id", "start_idx", F.size("images").alias("__images"))
    parsed = (single.join(images, ["doc_id", "start_idx"])
              .withColumn("__json", recover_json(F.col("response"))))
    fields = metadata_columns(F.col("__json"), F.col("__images"))
    return parsed.select("doc_id", "start_idx", *[c.alias(n) for n, c in fields.items()],
                         F.to_json("__json").alias("llm_raw_response"))


def documents_to_questions(blocks: DataFrame, documents: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Clean all blocks, then run the builder of every document's layout.

    The cleaned blocks feed several builders and their summaries, so they are written once, by
    layout, to the shared folder instead of being cleaned again for each. Warnings about a full paper
    as a whole stand with its first question.
    """
    cleaned = cut_lineage(layouts.with_layout(clean.clean_blocks(blocks), documents), "layout_type")
    papers = F.col("layout_type") == "full_paper"
    blocks_of_papers = cleaned.filter(papers).drop("layout_type")
    paper = layouts.read_full_paper(blocks_of_papers)
    builders = {**layouts.BUILDERS, "full_paper": lambda blocks, listed: layouts.build_full_paper(blocks, listed, paper)}
    questions = cut_lineage(layouts.build_questions(cleaned, files, builders))
    warnings = layouts.document_warnings(blocks_of_papers, questions.filter(papers), paper)
    return layouts.attach_document_warnings(questions, warnings)


def documents_to_bank(blocks: DataFrame, ingestions: DataFrame, responses: DataFrame,
                      files: DataFrame | None = None) -> DataFrame:
    """Everything from raw blocks to bank rows. ``ingestions`` carries id, layout, exam, subject."""
    documents = ingestions.select(F.col("id").alias("doc_id"), "layout_type")
    questions = cut_lineage(documents_to_questions(blocks, documents, files))
    return bank.bank_rows(questions, normalized_metadata(responses, questions), ingestions)


def document_states(raw: DataFrame, ingestions: DataFrame) -> DataFrame:
    """``(doc_id, status, reason)`` of the documents ``raw (doc_id, value)``: failed where the content list cannot be
    read or no ingestion names the document."""
    known = ingestions.select(F.col("id").alias("doc_id"), F.lit(True).alias("__known"))
    told = (raw.select("doc_id").distinct().join(content.rejected_content_lists(raw).distinct(), "doc_id", "left")
            .join(known.distinct(), "doc_id", "left"))
    reason = F.coalesce("reason", F.when(F.col("__known").isNull(), F.lit("no ingestion of this name")))
    return told.select("doc_id", F.when(reason.isNull(), F.lit("completed")).otherwise(F.lit("failed")).alias("status"), reason.alias("reason"))


def save_documents(raw: DataFrame, ingestions: DataFrame, responses: DataFrame, path: str, batch: int,
                   files: DataFrame | None = None) -> None:
    """Content lists ``raw (doc_id, value)`` into the bank at ``path`` as its batch ``batch``.

    The same step serves a run over a folder and each batch of a stream; it may be repeated.
    """
    raw = cut_lineage(raw.select("doc_id", "value"))
    own = raw.select(F.col("doc_id").alias("id")).distinct()
    rows = documents_to_bank(content.parse_content_lists(raw), ingestions.join(own, "id", "left_semi"), responses, files)
    sinks.save_bank_batch(rows, document_states(raw, ingestions), path, batch)
