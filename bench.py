"""Seconds per headline query on the given tables; prints one JSON line.

Each query runs once to warm up and then three times; the median counts. Results go to Spark's `noop`
sink, so all rows are computed and none are brought to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyrail.registry import QUERIES  # noqa: E402
from tallyrail.session import build_session  # noqa: E402

HEADLINE = (
    "two_rate_summary", "leg_mix_summary", "catalog_two_rate", "pair_legs_3key", "pair_legs_5key",
    "unanswered_requests", "slots_inbound", "slots_both", "throughput_strip", "rolling_strip",
    "inbound_health", "hourly_pivot", "billpay_report", "terminal_score", "layout_extract", "search_payload",
    "top_merchants", "top_categories", "region_rollup", "stream_slots",
)
RUNS = {"stream_slots": 1}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in HEADLINE:
        times = []
        runs = RUNS.get(name, 3)
        for _ in range(runs + (runs > 1)):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[-runs:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
