"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a10_channel_stats", "a25_pooled_within", "a26_dh_breaks", "a28_strata_efficiency", "w01_last_fast_change_year", "w03_ysfc",
    "a02_hls_annual_metrics", "a03_seasonal_metrics", "a15_global_covariance", "f25_build_feature", "f43_all_segment_metrics",
    "j08_mutual_knn_pairs", "j24_knn_regress", "j30_focal", "n03_reservoir", "p05_align_bilinear", "c1_ridge_fit", "c5_oof_linear", "m2_soft_neighbourhood_kl",
]


def main():
    from landstrata.plans.catalog import QUERIES
    from landstrata.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executors before the clock
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
