"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the tables and the cores. Each query runs to a sink that keeps nothing.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "join_aq_weather", "dedup_keep_last", "aqi_overall", "aqi_sub_indices_long",
    "category_distribution", "rolling_mean", "rolling_minmax", "ewma", "lags", "targets",
    "feature_build", "feature_build_time", "eda_describe", "eda_corr_matrix", "eda_histogram",
    "resample_daily", "seasonal_hour", "outlier_summary", "time_split", "regression_metrics",
    "upsert_features", "backfill_union", "ridge_fit", "forecast_series", "stream_join",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             # rows are few but wide windows are work: keep a task per core
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
             .config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from workload.spark_queries import QUERIES

    QUERIES["aqi_overall"](spark, folder).count()  # starts the session's classes
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": Path(folder).name}))


if __name__ == "__main__":
    main()
