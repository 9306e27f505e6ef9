"""Segmented ordered scans against Spark's own windows, and the salted scope join: even tasks."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from demandlens.operators import scan
from demandlens.operators.events import applicable_events, attribute_events
from demandlens.operators.temporal import forward_fill, lags_positional, rolling_means
from demandlens.plans.storeday import oil_prices_filled

BASE = dt.date(2015, 1, 1)


def series(spark, n: int, seed: int, kind: str = "date", hot: float = 0.0):
    """(s, k, p): unique keys within a series, runs of NULL prices much longer than a segment."""
    r = random.Random(seed)
    rows, known = [], True
    for i in r.sample(range(3 * n), n):
        if r.random() < 0.02:
            known = not known
        k = {"date": BASE + dt.timedelta(days=i), "int": i, "text": f"{i:09d}"[2:] if n < 10 ** 6 else str(i),
             "ts": dt.datetime(2015, 1, 1) + dt.timedelta(seconds=977 * i)}[kind]
        rows.append((0 if r.random() < hot else r.randrange(4), k, i))
    rows.sort(key=lambda x: x[2])
    out, known = [], False
    for s, k, i in rows:                     # runs in key order
        if r.random() < 0.03:
            known = not known
        out.append((s, k, r.randrange(100) if known else None))
    r.shuffle(out)
    ddl = {"date": "date", "int": "int", "text": "string", "ts": "timestamp"}[kind]
    return spark.createDataFrame(out, f"s int, k {ddl}, p int").repartition(5)


def same(a, b) -> None:
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("kind, n, segments, by, hot", [
    ("date", 300, 32, (), 0), ("int", 40, 32, (), 0), ("text", 200, 7, (), 0), ("ts", 200, 9, (), 0), ("date", 1, 32, (), 0),
    ("date", 120, 1, (), 0), ("date", 0, 32, (), 0), ("date", 300, 16, ("s",), 0.7), ("int", 60, 40, ("s",), 0)])
def test_scans_equal_windows(spark, kind, n, segments, by, hot):
    df = series(spark, n, n + segments, kind, hot).cache()
    w = Window.partitionBy(*by).orderBy("k")
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    same(scan.fill(df, "p", "k", "f", by, segments), df.withColumn("f", F.last("p", True).over(to_here)))
    for back in (1, 3, 25):
        made = {"lagged": lambda w: F.lag("p", back).over(w),
                "total": lambda w: F.sum("p").over(w.rowsBetween(-back, 0)),
                "first": lambda w: F.first("k").over(w.rowsBetween(-back, -1))}
        same(scan.look_back(df, "k", back, made, by, segments), df.withColumns({c: f(w) for c, f in made.items()}))
    df.unpersist()


def test_null_keys_and_runs_of_null_over_every_edge(spark):
    """A NULL key sorts first; one value at the start is carried through all segments."""
    rows = [(None, 7)] + [(BASE + dt.timedelta(days=i), None) for i in range(200)]
    df = spark.createDataFrame(rows, "k date, p int")
    assert {r["f"] for r in scan.fill(df, "p", "k", "f").collect()} == {7}
    rows[0] = (None, None)
    df = spark.createDataFrame(rows[:150] + [(BASE + dt.timedelta(days=500), 3)], "k date, p int")
    got = scan.fill(df, "p", "k", "f").collect()
    assert [r["f"] for r in got if r["f"] is not None] == [3]
    counted = scan.look_back(df, "k", 2, {"n": lambda w: F.count(F.lit(1)).over(w.rowsBetween(-2, 0))})
    n = sorted((r["k"] is not None, r["k"] or BASE, r["n"]) for r in counted.collect())
    assert [x[2] for x in n] == [1, 2] + [3] * 149


def test_decimals_and_named_operators(spark):
    df = series(spark, 150, 5).withColumn("p", F.col("p").cast("decimal(12,2)"))
    w = Window.orderBy("k")
    same(forward_fill(df, "p", "k"), df.withColumn("p", F.last("p", True).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    same(forward_fill(df, "p", "k", ["s"], "f", segments=8), forward_fill(df, "p", "k", ["s"], "f"))
    mean = F.sum("p").over(w.rowsBetween(-2, 0)).cast("double") / F.count("p").over(w.rowsBetween(-2, 0))
    same(rolling_means(df, "p", "k", 3, "m"), df.withColumn("m", mean))
    same(lags_positional(df, "p", "k", 12, "l"), df.withColumn("l", F.lag("p", 12).over(w)))


def plan(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_no_task_holds_the_series(spark):
    """No row of the series meets a single-partition exchange; segments have even shares."""
    df = series(spark, 4000, 1)
    filled = scan.fill(df, "p", "k", "f")
    assert "SinglePartition" not in plan(filled) and "Join" not in plan(filled)
    assert "SinglePartition" not in plan(oil_prices_filled(df.select(F.col("k").alias("date"), F.col("p").alias("dcoilwtico"))))
    sizes = [r["count"] for r in scan.cut(df, "k").groupBy(scan.SEG).count().collect()]
    assert len(sizes) == scan.SEGMENTS and max(sizes) < 2 * 4000 / scan.SEGMENTS
    back = scan.look_back(df, "k", 5, {"l": lambda w: F.lag("p", 5).over(w)})
    # the one series of segments: a row a segment
    assert plan(back).count("SinglePartition") <= 1


def test_hot_date_is_dealt_evenly(spark):
    """Broadcasts and skew splitting off: the stores of one date are not one task."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false",
            "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in keys}
    hot, n = BASE + dt.timedelta(days=3), 4000
    targets = spark.range(n).select(
        F.when(F.col("id") % 10 < 9, F.lit(hot)).otherwise(F.lit(BASE)).alias("date"),
        F.col("id").cast("int").alias("store_nbr"), F.lit("Quito").alias("city"), F.lit("Pichincha").alias("state"))
    events = applicable_events(spark.createDataFrame(
        [(hot, "Holiday", "National", "Ecuador", "a", "false"), (hot, "Event", "Local", "Quito", "b", "false"),
         (BASE, "Event", "Local", "Guayaquil", "c", "false")],
        "date date, type string, locale string, locale_name string, description string, transferred string"))
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        def largest(salts: int) -> tuple[int, int]:
            got = attribute_events(events, targets, salts=salts)
            assert "BroadcastHashJoin" not in plan(got)
            sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("t")).count().collect()]
            return max(sizes), sum(sizes)

        plain, total = largest(1)
        assert total == 2 * n * 9 // 10 and plain >= total / 2       # a scope of the date is one task
        salted, total = largest(64)
        assert total == 2 * n * 9 // 10 and salted < 2 * total / 8
        same(attribute_events(events, targets), attribute_events(events, targets, salts=1))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
