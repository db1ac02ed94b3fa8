"""Time the headline queries and print one JSON line."""

import json
import os
import time

from hourgrid.plans.catalog import QUERIES
from hourgrid.session import build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3
HEADLINE = (
    "bx_daily",
    "bx_daily_wide",
    "bx_hours",
    "bx_zone_pooled_wide",
    "bx_zone_of_means",
    "bx_monthly",
    "bx_annual",
    "price_statistics_wide",
    "price_statistics_market",
    "hourly_averages_wide",
    "percentile_nodes_wide",
    "peak_offpeak_by_node",
    "congestion_analysis",
    "price_spikes",
    "price_spikes_long",
    "month_hour_heatmap_wide",
    "node_daily_summary",
    "cheapest_hours",
    "price_histogram",
    "write_daily",
)


def seconds(spark, name):
    """Best of some runs; every row is produced, none is sent to the driver."""
    best = float("inf")
    for _ in range(RUNS):
        start = time.perf_counter()
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def main():
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        CPUS,
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "20g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: seconds(spark, name) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(FOLDER.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
