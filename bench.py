"""Headline queries, timed; prints one JSON line.

Every query is built and run to the end once to warm up, then timed: building
the plan, measuring group sizes and computing all rows count alike.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from laplake.plans import all_queries
from laplake.session import build_session

HEADLINE = (
    "lap_features", "feature_summary", "driver_summary", "fastest_laps", "lap_positions", "tyre_strategies",
    "position_pivot", "pit_stops_clean", "pit_identity", "pit_duration_join", "results_flatten", "race_headline",
    "lap_documents", "strategy_prompt", "vector_topk", "decode_lap_json", "write_features", "stream_features",
    "identity_cascade", "stream_dedup", "results_fallback", "results_drivers",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "laplake-bench", f"local[{cores}]", **{
            "spark.sql.shuffle.partitions": cores,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        })
    spark.sparkContext.setLogLevel("OFF")
    known = all_queries()
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")

    def run(name: str) -> float:
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(min(run(name) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
