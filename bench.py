"""Wall time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Each query is written to
Spark's ``noop`` sink, so all its rows and columns are computed and none reach the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from itemlake.plans.queries import QUERIES  # noqa: E402
from itemlake.session import local_session  # noqa: E402

HEADLINE = [
    "browse_filter", "bank_statistics", "question_list_page", "metadata_patch", "search_text_of_documents",
    "strip_html_tags", "clean_blocks", "detect_inline_layout", "build_inline_questions",
    "build_separate_key_questions", "build_full_paper_questions", "builder_quality_report",
    "ingestion_transitions", "ingestion_status_board", "chapter_ranges", "candidate_facets",
    "request_selection", "draft_from_requests", "blueprint_selection", "paper_detail", "shuffle_papers",
    "remove_questions", "question_alternatives", "export_markdown", "answer_key",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, partitions=cores)
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before timing
    times: dict[str, float] = {}
    for name in [n for n in HEADLINE if len(sys.argv) < 2 or n in sys.argv[1:]]:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
