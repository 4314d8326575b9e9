"""Headline queries, each timed to its last row; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = ["clean_calendar", "calendar_by_listing", "fact_calendar", "market_overview", "host_segmentation", "price_positioning",
            "seasonal_patterns", "supply_analysis", "review_velocity", "regulatory_compliance", "cross_city_comparison",
            "executive_kpis", "neighbourhood_metrics", "valuation_arbitrage", "host_concentration", "temporal_trends",
            "intervention_radar", "neighbourhood_interventions", "monthly_pricing", "weekday_pricing", "supply_concentration",
            "grouped_medians", "describe", "outliers_iqr", "validation_flags", "referential_integrity", "surrogate_keys",
            "tie_ranks", "rank_sum_test", "kruskal_wallis", "spearman_matrix", "bootstrap_mean", "feature_matrix", "stratified_split"]


def main() -> None:
    from pyspark.sql import SparkSession

    from checks.layers import wh
    from checks.registry import queries

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    registered, times = queries(), {}

    def timed(name, action):
        t0 = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - t0, 3)

    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    w = wh(spark, sf_dir)
    timed("build_silver", lambda: w.silver)
    timed("build_gold", lambda: w.gold)
    timed("build_star", lambda: w.star)
    for name in HEADLINE:
        if name in registered:
            timed(name, lambda: registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
