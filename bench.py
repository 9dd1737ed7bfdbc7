"""Time the headline queries; prints one JSON line.

Reads tables from $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].
Each query runs once to warm up on the small tables next to it, then once timed,
writing its complete result to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from seriesweave.catalog.queries import QUERIES
from seriesweave.plans.settings import RECOMMENDED

HEADLINE = (
    "missing_rows_hourly",
    "missing_rows_dense",
    "state_summary",
    "statistics_summary",
    "summary_diff",
    "state_outage_runs",
    "statistics_outage_runs",
    "state_resets_increasing",
    "state_resets_dense",
    "state_resets_total",
    "statistics_resets_increasing",
    "reset_report",
    "generate_increasing_hourly",
    "generate_increasing_short",
    "generate_total_hourly",
    "generate_measurement_hourly",
    "generate_increasing_dense",
    "generate_all_kinds",
    "generated_preview",
    "change_report",
    "change_report_condensed",
    "planned_changes_condensed",
    "generated_gaps",
    "generated_resets",
    "splice_result",
    "applied_changes_after_swap",
    "state_outage_runs_dense",
    "replacement_eligibility",
    "replace_series_result",
    "entity_attribute_diff",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(min(8, os.cpu_count() or 1)))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config(map=RECOMMENDED)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    small = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    warm_up = small if os.path.isdir(small) else sf_dir
    times: dict[str, float] = {}
    for name in HEADLINE:
        QUERIES[name](spark, warm_up).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
