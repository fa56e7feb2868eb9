"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores, BENCH_QUERIES a comma-separated
choice. Every query runs once to warm up and is then timed with all of its rows produced.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from echofold.session import local_session  # noqa: E402
from verification.queries import REGISTRY  # noqa: E402

HEADLINE = [
    "lineitem_file_sets", "lineitem_top_files", "lineitem_file_samples", "lineitem_folder_fingerprints",
    "lineitem_folder_sets", "dup_file_sets", "total_wasted", "dup_file_locations", "top_dup_files",
    "folder_rollup", "folder_fingerprints", "top_dup_folders", "dup_folder_locations", "report_sets",
    "latest_runs_of_events", "scan_totals", "cleanup_counts", "hash_files", "merge_hashes", "inventory",
]


def produce(spark, sf_dir: str, name: str) -> float:
    start = time.time()
    REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES")
    spark = local_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    seconds = {}
    for name in chosen.split(",") if chosen else HEADLINE:
        produce(spark, sf_dir, name)
        seconds[name] = round(produce(spark, sf_dir, name), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline query time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name,
    }))


if __name__ == "__main__":
    main()
