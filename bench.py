"""Time the headline queries; prints one JSON line.

`BENCH_SF_DIR` names the data folder, `BENCH_CPUS` the cores. Every query runs once to warm
up and then `BENCH_RUNS` times (default 1); the best time counts. Results go to Spark's
no-op sink, so all columns of all rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from glossweave.workload import QUERIES

HEADLINE = [
    "norm_text", "text_tier", "trans_id", "tier1_dups", "paragraph_ids", "page_paragraphs",
    "extraction_stats", "md_blocks", "chapters", "char_batches", "fixed_batches",
    "tm_lookup", "tm_misses", "tm_upsert", "dup_fanout", "run_stats", "align_cascade",
    "align_rate", "bilingual_edition", "q_fidelity", "q_fluency", "q_consistency",
    "q_terminology", "q_overall", "segment_gate", "batch_prompt", "batch_parse",
    "status_stats", "token_summary", "backfill_failed", "stage_durations", "latest_log",
    "link_match_containment", "translate_books",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("glossweave-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        best = None
        for turn in range(runs + 1):
            begin = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - begin
            if turn > 0:
                best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
