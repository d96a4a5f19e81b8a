"""Time the headline queries. Prints one JSON line.

Each query is built, run in full and its rows thrown away (noop sink). The first run of a query warms up
and is not counted; the best of BENCH_RUNS further runs is, so all figures are warm. BENCH_SF_DIR and
BENCH_CPUS set data and cores. Fixture rows are dealt over all cores.
"""

from __future__ import annotations

import json
import os
import re
import time

from flowlens.plans.catalogue import QUERIES
from flowlens.session import local_session

HEADLINE = [
    "top_flows", "top_categories", "top_users", "summary_panels", "summary_totals",
    "filter_time_preset", "filter_time_custom", "filter_external_only", "filter_ports", "search_cs",
    "search_ci", "search_indexed", "lookup_indexed", "union_sources", "filter_log_source", "filter_unified", "count_by_source",
    "facet_devices", "facets_url", "logs_page", "logs_page_deep", "log_display_rows",
    "url_display_rows", "flow_groups", "count_flow_groups", "subnet_rollup", "subnet_details",
    "subnet_page", "daily_category_actions", "rollup_url_hourly", "rollup_user_daily",
    "rollup_blocked_hourly", "rollup_merge", "uniq_approx", "parse_kv_typed", "parse_pan_traffic",
    "parse_pan_slim", "parse_pan_url", "csv_split_quoted", "url_decompose", "ingest_stats",
    "alert_rows", "load_verify", "sink_partitioned_append", "layout_clustered", "stream_ingest",
    "stream_rollup_hourly",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, shuffle_partitions=8, flowlens__fixture__tasks=cpus)
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        times: list[float] = []
        for _ in range(1 + runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:]), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries, warm",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf.group(1)) if sf else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
