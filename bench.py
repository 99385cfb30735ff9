"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from grainsieve.plans.queries import QUERIES  # noqa: E402
from grainsieve.session import local_session  # noqa: E402

HEADLINE = (
    "corpus_lines", "fingerprints", "inventory_summary", "inventory_detections", "inventory_identifiers",
    "rule_scan", "findings_enriched", "capture_filters", "suppressions", "proto_assignment",
    "taint_propagate", "taint_gate", "baseline_build", "baseline_kept", "framework_summary",
    "sarif_results", "findings_csv_rows", "package_resolution", "advisory_matches", "advisory_policy",
    "compromised_matches", "package_summary", "page_scripts", "script_manifest",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    QUERIES["report_totals"](spark, folder).collect()  # start the session's machinery once
    seconds = {}
    only = os.environ.get("BENCH_ONLY", "").split(",")
    for name in [n for n in HEADLINE if only == [""] or n in only]:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_wall_clock", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
