"""Benchmark: the sixteen business queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Steps: warm the JVM on the smallest table set ($BENCH_WARMUP_DIR, default the sibling
sf0.001 folder; nothing is shared with the measured run), then bind the retail model onto the
driver's tables and write the store-day layer ($BENCH_LAYER_RUNS independent builds, median:
"layer_build"), run every query once on the last build ("first_run") and time ``BENCH_RUNS``
further runs of each (median). Prints ONE JSON line; ``value`` = layer build + the sum of the
per-query medians (the end-to-end cost of answering all sixteen questions).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["q01_coverage", "q02_anomaly_flags", "q03_monthly_kpi", "q04_same_store_growth",
            "q05_seasonality", "q06_portfolio_roles", "q07_promo_dependency", "q08_concentration",
            "q09_cluster_index", "q10_store_scorecard", "q11_store_risk", "q12_store_archetypes",
            "q13_holiday_lift", "q14_event_lift", "q15_oil_regimes", "q16_network_anomalies"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from demandlens.plans.catalog import layer_for
    from demandlens.plans.queries import QUERIES
    from demandlens.session import get_session

    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", cpus * 2)),
                        extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "16g")})
    # JVM warm-up (JIT, codegen caches) on the smallest table set, a different folder so no
    # data or shuffle output is reused: the timings below are those of a running application.
    warm = os.environ.get("BENCH_WARMUP_DIR", os.path.join(os.path.dirname(sf_dir), "sf0.001"))
    warmed = bool(warm) and os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir)
    if warmed:
        wl = layer_for(spark, warm)
        for name in HEADLINE:
            QUERIES[name](wl).collect()
    else:
        spark.range(1000).selectExpr("sum(id)").collect()  # session start-up, not the layer
    from demandlens.plans.storeday import build_layer
    from demandlens.sources.tpch import bind_tpch

    builds = []
    for _ in range(int(os.environ.get("BENCH_LAYER_RUNS", "3"))):   # independent builds
        t0 = time.perf_counter()
        layer = build_layer(bind_tpch(spark, sf_dir), spark)
        layer.context.count()
        builds.append(time.perf_counter() - t0)
    build = statistics.median(builds)

    cold, times = {}, {}
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name](layer).collect()
        cold[name] = time.perf_counter() - t
    for name in HEADLINE:
        samples = []
        for _ in range(runs):
            t = time.perf_counter()
            QUERIES[name](layer).collect()
            samples.append(time.perf_counter() - t)
        times[name] = round(statistics.median(samples), 4)

    total = build + sum(times.values())
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({
        "metric": "layer_build_plus_16_queries",
        "value": round(total, 3),
        "unit": "sec",
        "queries": {"layer_build": round(build, 3), **times},
        "queries_total": round(sum(times.values()), 3),
        "first_run": {k: round(v, 3) for k, v in cold.items()},
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus,
        "runs": runs,
        "jvm_warmup": warm if warmed else None,
        "layer_builds": [round(b, 3) for b in builds],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
