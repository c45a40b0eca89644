"""Incremental ingestion: every batch of new files runs the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from itemlake.plans.ingest import save_documents
from itemlake.sources.content import parse_content_lists, stream_content_lists
from itemlake.sources.sinks import replace_batch

Plan = Callable[[DataFrame], DataFrame]


def start_ingestion(spark: SparkSession, folder: str, target: str, checkpoint: str, plan: Plan,
                    files_per_batch: int = 1000) -> StreamingQuery:
    """Read new content lists under ``folder``, run ``plan(blocks)`` and write the questions.

    Each batch writes its own directory, so a batch repeated after a failure replaces itself.
    The query ends when all files present have been read.
    """
    def process(raw: DataFrame, batch: int) -> None:
        replace_batch(plan(parse_content_lists(raw)), target, batch)

    return (stream_content_lists(spark, folder, files_per_batch).writeStream
            .foreachBatch(process).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def start_bank_ingestion(spark: SparkSession, folder: str, bank: str, checkpoint: str, ingestions: DataFrame, responses: DataFrame,
                         files: DataFrame | None = None, files_per_batch: int = 1000) -> StreamingQuery:
    """Read new content lists under ``folder`` into the partitioned bank at ``bank`` as the batch plan does.

    A repeated batch replaces itself; a file that comes again under its old name is not read twice by the stream.
    """
    def process(raw: DataFrame, batch: int) -> None:
        save_documents(raw, ingestions, responses, bank, batch, files)

    return (stream_content_lists(spark, folder, files_per_batch).writeStream
            .foreachBatch(process).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
