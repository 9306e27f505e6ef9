"""Means of ratios do not depend on row order; distinct counts by bitmaps are exact."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from demandlens.functions.numeric import ratio_mean, ratio_sd
from demandlens.operators.aggregates import named_measures
from demandlens.operators.audit import coverage_audit, with_distinct_counts
from demandlens.operators.stats import sigma_band
from demandlens.plans.catalog import layer_for
from demandlens.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_ratio_means_are_bit_equal_over_repartitionings(spark):
    rng = random.Random(5)
    rows = [(i % 3, None if i % 17 == 0 else rng.uniform(0, 10 ** rng.randint(-6, 7))) for i in range(4000)]
    df = spark.createDataFrame(rows, "g int, sales_per_transaction double").cache()
    mean = named_measures()["avg_sales_per_transaction"]
    results = set()
    for seed in range(20):
        parts = df.orderBy(F.rand(seed)).repartition(1 + seed % 7, F.rand(seed + 50))
        got = parts.groupBy("g").agg(mean().alias("m"), ratio_sd("sales_per_transaction").alias("s")).orderBy("g").collect()
        results.add(tuple((r["m"].hex(), r["s"].hex()) for r in got))
    assert len(results) == 1
    for g, m in enumerate(float.fromhex(m) for m, _ in results.pop()):
        values = [v for k, v in rows if k == g and v is not None]
        assert abs(m - sum(values) / len(values)) < 1e-6 * max(1, abs(m))
    df.unpersist()


def test_means_of_nothing_and_of_equal_values(spark):
    df = spark.createDataFrame([(0.7,), (0.7,), (0.7,), (None,)], "x double")
    got = df.agg(ratio_mean("x").alias("m"), ratio_sd("x").alias("s")).first()
    assert got["m"] == 0.7 and 0 <= got["s"] < 1e-7
    none = df.filter("x > 1").agg(ratio_mean("x").alias("m"), ratio_sd("x").alias("s")).first()
    assert none["m"] is None and none["s"] is None
    band = sigma_band(df, ["x"]).collect()
    assert all(r["x"] is None or (r["x"] >= r["_avg_x"] and not r["x"] < r["_lo_x"]) for r in band)


def test_distinct_counts_of_nulls_large_and_negative_ids(spark):
    rng = random.Random(9)
    pool = [0, 1, -1, 32767, 32768, 32769, -32768, -32769, 2 ** 31, 2 ** 62, -2 ** 62, 2 ** 63 - 1] + \
           [rng.randint(-10 ** 12, 10 ** 12) for _ in range(40)]
    rows = [(rng.choice(pool + [None]), rng.choice([None, 5, 6, 70000]), rng.choice([None, 1, 2])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a long, b int, v int").repartition(5)
    got = with_distinct_counts(df, {"total": F.col("v"), "n": F.lit(1)}, {"x": "a", "y": "b"}).first()
    assert got["x"] == len({r[0] for r in rows} - {None}) and got["y"] == 3
    assert got["n"] == 3000 and got["total"] == sum(r[2] or 0 for r in rows)
    empty = with_distinct_counts(df.limit(0), {"n": F.lit(1)}, {"x": "a"}).first()
    assert empty["x"] == 0 and empty["n"] is None


def test_coverage_reads_each_row_once(spark):
    layer = layer_for(spark, SF)
    for name in ("q01_coverage", "q03_monthly_kpi"):
        assert "Expand" not in QUERIES[name](layer)._jdf.queryExecution().executedPlan().toString()
    none = coverage_audit(layer.context.limit(0)).first()
    assert none["store_day_rows"] == none["calendar_days"] == none["stores_covered"] == 0 and none["missing_oil_pct"] is None
