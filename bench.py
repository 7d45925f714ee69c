"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from studyspark.plans.catalog import queries
from studyspark.session import local_session

HEADLINE = (
    "b1_clean_text", "b7_chunk", "b16_corpus_profile", "b13_propagate_topic", "b20_blocks", "c5_canonical", "d4_top_k_similar",
    "d5_similar_pairs", "e2_topic_nodes", "e21_prerequisites", "f1_related_concepts", "f5_neighbour_strength", "g10_generate_cards", "c6_fuzzy_merge",
    "g16_grade", "h2_sm2_replay", "h4_due_cards", "h6_study_stats", "h10_dashboard", "h13_integrity_audit", "i1_task_state",
    "i8_trace", "i9_dedupe_by_hash",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    known, times = queries(), {}
    wanted = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/orders.parquet").count()   # starts the executors
    for name in wanted:
        started = time.time()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder).removeprefix("sf")}))


if __name__ == "__main__":
    main()
