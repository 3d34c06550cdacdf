"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the folder, BENCH_CPUS (default 8) the local cores. Every query is
built and run twice to warm up, then three times; the median counts. Building includes the size checks of joins.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from kerbline.session import build_session  # noqa: E402

HEADLINE = ("park_count_in_polygon", "park_events_at", "park_age_histogram", "park_events_by_date_index", "trips_in_zones",
            "trip_zone_stats", "rental_zone_stats", "rental_series_15m", "availability_by_operator",
            "available_vehicles_week", "report_indicators", "report_full", "municipality_at", "latest_positions",
            "movements", "acl_operators")
WARM_UPS, RUNS = 2, 3


def run(query, spark, folder: str) -> float:
    begin = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus), **{
        "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(WARM_UPS):
            run(QUERIES[name], spark, folder)
        seconds[name] = round(statistics.median(run(QUERIES[name], spark, folder) for _ in range(RUNS)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main()
