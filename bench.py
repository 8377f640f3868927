"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR picks the data folder, BENCH_CPUS the local cores, BENCH_ALL=1 times the
whole catalogue.
"""

from __future__ import annotations

import json
import os
import sys
import time

from veridoc.plans import CATALOGUE, runner
from veridoc.session import build_session

HEADLINE = (
    "keyword_bm25_topk", "keyword_and_or_fallback", "index_terms", "vector_topk", "vector_topk_filtered", "hybrid_rrf",
    "rerank_merge", "retrieval_aggregate", "block_extract", "chunk_pack", "sentence_split", "chunk_ids", "search_normalise",
    "pii_scan", "pii_scrub_full", "leak_windows", "eligible_chunks", "register_dispositions", "three_way", "activation_check",
    "call_audit", "plan_totals", "plan_category_gaps", "plan_missing", "plan_warnings", "project_records", "schedule_overlap_clock",
    "timetable_conflicts", "narrowest_cover", "cross_version_conflicts", "row_slot_conflicts", "conflict_summary",
    "completion_audit", "citation_remap", "judge_audit", "nearest_miss", "coverage_d1_d2", "fact_anchor_support", "verdicts", "ingest_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = list(CATALOGUE) if os.environ.get("BENCH_ALL") else list(HEADLINE)
    names = sys.argv[1:] or names
    spark = build_session("bench")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the session outside the timings
    timings: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        runner(name)(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_wall_time", "value": round(sum(timings.values()), 3), "unit": "sec",
                "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
