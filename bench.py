"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from linkloom.plans.queries import QUERIES
from linkloom.session import build_session

HEADLINE = [
    "extract_links", "canonicalize_url", "domain_counts", "frontier_push", "frontier_upsert", "frontier_dump",
    "frontier_scan_status", "frontier_lookup", "fetch_snapshot", "dedup_against_seen", "session_dedup", "bloom_build", "bloom_might_contain",
    "bloom_dedup", "robots_allowed", "fetch_outcome", "crawl_reachable", "crawl_limits", "crawl_pages", "warc_roundtrip", "warc_record_format",
    "archive_line_range", "politeness_plan", "politeness_violations", "idle_sessions", "completion_events",
    "stats_tumbling", "latency_histogram", "crawl_stats", "log_events",
]


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
    }))


if __name__ == "__main__":
    main(sys.argv[1:] or HEADLINE)
