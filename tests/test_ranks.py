"""Bucketed ranks equal Spark's windows at any size, and no task orders the whole table."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from demandlens.operators import ranking
from test_plans import _single_partition_rows

KINDS = {
    "unique": lambda r, i: Decimal(i * 7919 % 10_007) / 100,
    "ties": lambda r, i: Decimal(r.randint(0, 6)),
    "hot": lambda r, i: Decimal(5) if r.random() < 0.4 else Decimal(r.randint(0, 10 ** 6)) / 100,
    "nulls": lambda r, i: None if r.random() < 0.3 else Decimal(r.randint(0, 40)),
    "all_null": lambda r, i: None,
}


def make(spark, kind, n):
    r = random.Random(n)
    return spark.createDataFrame([(i, f"k{i % 7}{i:05d}", KINDS[kind](r, i)) for i in range(n)],
                                 "k int, name string, v decimal(14,2)").repartition(3)


@pytest.mark.parametrize("kind", sorted(KINDS))
@pytest.mark.parametrize("n", [0, 1, 2, 700])
def test_ranks_equal_windows(spark, kind, n):
    df = make(spark, kind, n).cache()
    up, down = F.col("v").asc_nulls_first(), F.col("v").desc_nulls_last()
    want = df.withColumns({
        "pr": F.percent_rank().over(Window.orderBy(up)), "dr": F.dense_rank().over(Window.orderBy(down)),
        "nt": F.ntile(4).over(Window.orderBy(down, "k")), "tn": F.ntile(3).over(Window.orderBy(up, "name"))})
    got = ranking.percent_ranks(df, "v", "pr")
    got = ranking.dense_ranks(got, "v", "dr", descending=True)
    got = ranking.ntiles(got, 4, "v", "k", "nt", descending=True)
    got = ranking.ntiles(got, 3, "v", "name", "tn")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    df.unpersist()


@pytest.mark.parametrize("kind", ["unique", "hot"])
def test_no_task_orders_the_table(spark, kind):
    df = make(spark, kind, 3000)
    bound = (2 * ranking.PIECES + 1) + ranking.PIECES * 2       # buckets, and key ranges of a hot value
    for ranked in (ranking.percent_ranks(df, "v", "o"), ranking.dense_ranks(df, "v", "o"),
                   ranking.ntiles(df, 4, "v", "k", "o")):
        rows = _single_partition_rows(ranked)
        assert all(n <= bound for n in rows), rows


@pytest.mark.parametrize("ranks", [1, 2, 3, 4])
def test_reads_do_not_grow_with_the_ranks(spark, tmp_path, monkeypatch, ranks):
    """The settled table is read three times: quantiles, bucket sizes, result."""
    make(spark, "ties", 500).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    jobs = []
    for name in ("_bounds", "_sizes"):
        monkeypatch.setattr(ranking, name, lambda *a, f=getattr(ranking, name): jobs.append(1) or f(*a))
    every = [ranking.Rank("v", {"pr": "percent"}), ranking.Rank("v", {"dr": "dense"}, True, False),
             ranking.Rank("v", {"nt": 4}, True, False, "k"), ranking.Rank("v", {"rn": "row", "n": "n"}, False, True, "name")]
    got = ranking.ranked(df, every[:ranks])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(jobs) == 2 and plan.count("] parquet") == 1 and "CartesianProduct" not in plan
    up, down = F.col("v").asc_nulls_first(), F.col("v").desc_nulls_last()
    want = df.withColumns(dict(list({
        "pr": F.percent_rank().over(Window.orderBy(up)), "dr": F.dense_rank().over(Window.orderBy(down)),
        "nt": F.ntile(4).over(Window.orderBy(down, "k")), "rn": F.row_number().over(Window.orderBy(up, "name"))}.items())[:ranks]))
    assert sorted(map(tuple, got.drop("n").collect())) == sorted(map(tuple, want.collect()))
    assert ranks < 4 or {r["n"] for r in got.collect()} == {500}


def test_equal_values_with_a_text_key_are_dealt(spark):
    """All values tie and the key is a text: no window holds the table."""
    df = spark.range(4000).select(F.format_string("%c%c%05d", (97 + F.col("id") % 23).cast("int"), (97 + F.col("id") % 7).cast("int"), "id")
                                  .alias("name"), F.lit(1.0).alias("v")).cache()
    rank = ranking.Rank("v", {"rn": "row"}, tie_break="name")
    tags = ranking._tags(df, 0, rank, ranking._bounds(df, ["v", "name"]))
    assert max(r["n"] for r in df.groupBy(tags["_s0"].alias("s")).agg(F.count("*").alias("n")).collect()) < 500
    got = [r["name"] for r in ranking.ranked(df, [rank]).orderBy("rn").collect()]
    assert got == sorted(got) and len(got) == 4000
    df.unpersist()


def test_double_values_meet_their_bounds(spark):
    df = spark.range(1000).select(F.col("id").cast("int").alias("k"), (F.col("id") / 7.0).alias("v"))
    got = {r["k"]: r["o"] for r in ranking.dense_ranks(df, "v", "o").collect()}
    assert got == {i: i + 1 for i in range(1000)}
    zeros = spark.createDataFrame([(0, 0.0), (1, -0.0), (2, 1.0), (3, -1.0)], "k int, v double")
    assert {r["k"]: r["o"] for r in ranking.dense_ranks(zeros, "v", "o").collect()} == {3: 1, 0: 2, 1: 2, 2: 3}
