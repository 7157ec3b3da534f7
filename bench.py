"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local cores and
BENCH_QUERIES (optional) the queries to run, separated by commas, or ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spanledger.queries import QUERIES  # noqa: E402
from spanledger.session import local_session  # noqa: E402

HEADLINE = [
    "review_listing", "review_page", "session_snapshot", "latest_version_open", "batch_neighbours",
    "group_text", "issue_dedup_first", "category_groups", "bar_match", "bar_issues", "zone_consistency",
    "geometry_check", "header_carry", "rule_verdicts", "required_sections", "note_values", "duplicate_headers",
    "nearest_label", "points_in_box", "gap_groups", "ring_spacing", "header_columns", "zone_values",
    "form_expected", "lost_inputs", "traceable", "figure_numbers", "session_machine", "cost_rollup",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = HEADLINE if not chosen else list(QUERIES) if chosen == "all" else chosen.split(",")
    spark = local_session(cpus, app="bench", memory="12g")
    spark.read.parquet(f"{folder}/region.parquet").count()
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("/sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
