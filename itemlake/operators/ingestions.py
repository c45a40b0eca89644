"""Ingestion records as an event history: state machine, status board, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlake import constants as C
from itemlake.functions.names import normalize_exam_name, normalize_subject
from itemlake.functions.text import error_text
from itemlake.operators.ordered import ordered_scan


def normalize_uploads(uploads: DataFrame) -> DataFrame:
    """Canonical exam and subject of upload forms; every upload starts as ``UPLOADED``."""
    return uploads.withColumns({
        "exam_name": normalize_exam_name(F.col("exam_name")),
        "subject": normalize_subject(F.col("subject")),
        "status": F.lit(C.STAGES[0])})


def transition_allowed(before: Column, after: Column) -> Column:
    """Next stage in order, ``FAILED`` from any other state, retry from ``FAILED`` to the start."""
    stages = F.array(*[F.lit(s) for s in C.STAGES])
    here, there = F.array_position(stages, before), F.array_position(stages, after)
    return F.coalesce(
        F.when(before.isNull(), after == C.STAGES[0])
        .when(before == C.FAILED, after == C.STAGES[0])
        .when(after == C.FAILED, F.lit(True))
        .otherwise((here > 0) & (there == here + 1)), F.lit(False))


def check_transitions(events: DataFrame) -> DataFrame:
    """``events (ingestion_id, seq, status, …)`` with the status before and whether the step is legal."""
    scanned = ordered_scan(events, ["ingestion_id"], ["seq"], prior={"before": F.col("status")})
    return scanned.withColumn("legal", transition_allowed(F.col("before"), F.col("status")))


def latest_status(events: DataFrame) -> DataFrame:
    """Newest status per ingestion.

    For a failed one the stage it failed at, which is the last stage it had reached, and the
    truncated error. Aggregated on the map side, so a busy ingestion costs one row per task.
    """
    stage = F.when(F.col("status") != C.FAILED, F.col("seq"))
    newest = events.groupBy("ingestion_id").agg(
        F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"),
        F.max_by("status", stage).alias("__reached"), F.max_by("error", "seq").alias("__error"))
    failed = F.col("status") == C.FAILED
    return newest.select(
        "ingestion_id", "seq", "status",
        F.when(failed, F.col("__reached")).alias("failed_at_stage"),
        F.when(failed, error_text(F.col("__error"))).alias("error_message"))


def retry(latest: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reset failed ingestions to ``UPLOADED`` with the error cleared; the others are rejected."""
    wanted = requested.select("ingestion_id").distinct()
    judged = wanted.join(latest.select("ingestion_id", "status"), "ingestion_id", "left").withColumn("reason", (
        F.when(F.col("status").isNull(), "Ingestion not found.")
        .when(F.col("status") != C.FAILED, F.concat(
            F.lit("Can only retry FAILED ingestions. Current: "), F.col("status")))))
    good = judged.filter(F.col("reason").isNull()).select("ingestion_id", F.lit(True).alias("__go"))
    none = F.lit(None).cast("string")
    reset = latest.join(good, "ingestion_id", "left").withColumns({
        "status": F.when(F.col("__go"), C.STAGES[0]).otherwise(F.col("status")),
        "failed_at_stage": F.when(F.col("__go"), none).otherwise(F.col("failed_at_stage")),
        "error_message": F.when(F.col("__go"), none).otherwise(F.col("error_message"))}).drop("__go")
    return reset, judged.filter(F.col("reason").isNotNull()).select("ingestion_id", "reason")
