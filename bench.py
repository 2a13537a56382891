"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from raretide.catalog import QUERIES

# name in the report -> registered query
HEADLINES = {
    "window_totals": "agg3_window_totals",
    "window_sizes": "agg5_fraud_count_distribution",
    "split_tables": "spl3_split_tables",
    "base_features": "agg6_base_features",
    "cluster_mix": "agg8_cluster_mix",
    "dense_series": "fe2_dense_series",
    "window_builder": "plan3_window_builder",
    "baseline_report": "plan5_baseline_report",
    "zip_regression": "mdl8_zip_regression",
    "stepwise_zip": "stp8_stepwise_zip",
    "residual_tests": "dia9_dagostino_pearson",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # the JVM and the file cache are warm
    seconds: dict[str, float | None] = {}
    for label, name in HEADLINES.items():
        start = time.perf_counter()
        try:
            QUERIES[name].plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[label] = round(time.perf_counter() - start, 3)
        except Exception as e:  # a failing query must not hide the others
            print(f"{label}: {type(e).__name__}: {str(e)[:300]}", file=sys.stderr)
            seconds[label] = None
    total = round(sum(s for s in seconds.values() if s is not None), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
