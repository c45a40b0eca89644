"""Status board over a stream of ingestion events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from itemlake.operators.ingestions import latest_status
from itemlake.sources.sinks import replace_batch

BOARD = "ingestion_id bigint, seq bigint, status string, failed_at_stage string, error_message string"


def start_status_board(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the board of ``events (ingestion_id, seq, status, error)`` under ``target``.

    The state store holds one row per ingestion: its newest status, the stage it had reached and its error. Each batch writes
    the whole board rows of the ingestions it touches, also where their events came late or over several batches.
    """
    return (latest_status(events).writeStream.outputMode("update")
            .foreachBatch(lambda rows, batch: replace_batch(rows, target, batch))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_status_board(written: DataFrame) -> DataFrame:
    """The board from the rows of all batches: of each ingestion those of the last batch that touched it."""
    columns = [c for c in written.columns if c not in ("ingestion_id", "batch")]
    last = written.groupBy("ingestion_id").agg(F.max_by(F.struct(*columns), "batch").alias("s"))
    return last.select("ingestion_id", *[F.col(f"s.{c}") for c in columns])
