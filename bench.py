"""Time the headline queries and print one JSON line.

Every query runs once to warm up and once for the clock, into a sink that
discards the rows, so that all columns are computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loomdex.plans.given_tables import INPUT_PARTITIONS  # noqa: E402
from loomdex.plans.table_queries import QUERIES  # noqa: E402
from loomdex.session import local_session  # noqa: E402

HEADLINE = (
    "clean_corpus", "parse_report", "chunk_800", "chunk_300", "chunk_doc_stats",
    "chunk_overlap_check", "embed_hashed", "validate_input", "store_check", "upsert_chunks",
    "topk_cosine", "topk_lsh", "retrieve_all", "retrieve_300", "build_prompt",
    "citations", "answer_records", "hit_at_k", "answer_quality", "metrics_long",
    "retrieval_eval", "merge_results", "latency_events",
)


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    # the files of the small tables have one row group each
    spark.conf.set(INPUT_PARTITIONS, os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name in HEADLINE:
        run(spark, name, folder)
        seconds[name] = round(run(spark, name, folder), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
