"""Benchmark of the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` (default 8). Every query is executed in full through
the ``noop`` sink (no rows are collected to the driver): one warm-up run, then
the median of ``$BENCH_REPEATS`` (default 5) timed runs. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "map_layer", "describe_quantity_by_flag", "histogram_extendedprice", "outliers_iqr", "profile",
    "reconcile_order_totals", "kpi_headline", "kpi_efficiency", "star_view", "stock_history",
    "segment_customers", "receipt", "trend", "parse_chat", "rebuild_multiline", "top_terms",
    "chunk_documents", "similar_top_k", "cooldown_alerts", "live_kpis", "normalize_text", "dead_links",
    "top_customers_per_nation", "related_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "5"))
    from pyspark.sql import SparkSession

    from tessera.session import SCALE_CONF, checkpoint_dir
    from tessera.plans.registry import load_all

    b = (SparkSession.builder.master(f"local[{cpus}]").appName("tessera-bench")
         .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
         .config("spark.sql.shuffle.partitions", str(max(8, cpus * 2)))
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false"))
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    qs = load_all()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in qs]
    times: dict[str, float] = {}
    for name in names:
        build = qs[name].build
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        runs = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "repeats": repeats}))
    spark.stop()


if __name__ == "__main__":
    main()
