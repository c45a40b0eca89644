"""The stream's status board against the batch board, over several batches and runs."""

from pyspark.sql import functions as F

from itemlake.operators.ingestions import latest_status
from itemlake.streaming.status import BOARD, read_status_board, start_status_board

EVENTS = "ingestion_id long, seq long, status string, error string"
BATCHES = [
    [(1, 1, "UPLOADED", None), (2, 1, "UPLOADED", None), (3, 4, "FAILED", "late"), (None, 1, "UPLOADED", None)],
    [(1, 2, "MINERU_COMPLETE", None), (2, 2, "FAILED", "x" * 3000), (3, 1, "UPLOADED", None)],
    [(1, 3, "FAILED", "no text"), (2, 3, "UPLOADED", None), (3, 3, "QUESTIONS_BUILT", None)],
    [(4, 1, "UPLOADED", None), (4, 1, "UPLOADED", None)],
]


def test_board_of_a_stream_equals_batch(spark, tmp_path):
    source, board, point = str(tmp_path / "in"), str(tmp_path / "board"), str(tmp_path / "cp")
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        if i != 1:  # the second and third part come in one run
            events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
            start_status_board(events, board, point).awaitTermination()
    got = read_status_board(spark.read.schema(f"{BOARD}, batch int").option("basePath", board).parquet(board))
    want = latest_status(spark.createDataFrame([r for b in BATCHES for r in b], EVENTS))
    assert got.columns == want.columns
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    rows = {r.ingestion_id: r for r in got.collect()}
    assert (rows[1].failed_at_stage, rows[1].error_message) == ("MINERU_COMPLETE", "no text")
    assert (rows[2].status, rows[2].error_message) == ("UPLOADED", None)  # a retry clears the error
    assert rows[3].failed_at_stage == "QUESTIONS_BUILT"  # told after the failure, of before it
    assert got.filter(F.col("ingestion_id").isNull()).count() == 1
