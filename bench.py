"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fathomline.catalog import everything  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = (
    "seven_transforms", "segment_revenue", "cast_types", "parse_numeric", "datetime_parts", "bin_numeric",
    "filter_rows_number", "summarise_lineitem", "sort_rows", "climatology", "formula",
    "rule_first_match", "join_left", "join_full", "as_of", "within_intervals", "look_ahead",
    "drop_duplicates", "top_per_group", "rank_rows", "profile", "linear_trend", "correlation",
    "rolling_stats", "moving_average", "lag_column_global", "pivot_wider", "resample_day",
    "histogram", "box", "scorecard", "project", "data_quality", "distribution_by_group",
    "scan_grid", "curve_by_group", "nearest", "leave_one_out", "path_distance", "decisions",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = everything().queries
    wanted = sys.argv[1:] or HEADLINES
    spark.read.parquet(f"{FOLDER}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in wanted:
        began = time.perf_counter()
        known[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
