"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from vouchsafe.plans import catalog
from vouchsafe.session import local_session

HEADLINE = (
    "a4_dedupe_content", "b14_source_index", "b15_link_evidence", "c2_flatten_fields", "c13_valid_documents",
    "d8_summarize_attempts", "e2_guard_total", "e11_evaluate_guardrails", "e11_guardrail_summary", "f2_disputed_paths",
    "g6_reconcile_tasks", "h1_latest_extraction", "h3_search_documents", "i5_event_feed", "j10_evaluate_documents",
    "j16_run_report", "k1_export_positions",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
