"""The layer's folders: files by counted rows, one scan after any number of refreshes, changed
months found by fingerprints, facts read by month."""

from __future__ import annotations

import datetime as dt
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from demandlens.plans.manifest import changed_months, fingerprints
from demandlens.plans.storeday import build_layer, refresh_layer
from demandlens.sources.model import Model
from demandlens.sources.sink import deal, write_table

from conftest import make_model

HOT, COLD = dt.date(2016, 3, 1), dt.date(2016, 4, 1)


def _rows(months, stores, days, value=1):
    return [((m + dt.timedelta(days=d)).isoformat(), s, "A", value, 0) for m in months for s in stores for d in range(days)]


def _layer_model(spark, months, stores=range(1, 41), days=25):
    dimension = [(s, "Quito", "Pichincha", "A", 1) for s in stores]
    return make_model(spark, _rows(months, stores, days), stores=dimension, oil=[("2016-03-02", 40)],
                      holidays=[("2016-03-05", "Holiday", "National", "Everywhere", "Day", "False")])


def _files(df):
    return Counter(f.split("month_start=")[1].split("/")[0] for f in df.inputFiles())


def _same(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_deal_gives_tasks_by_rows():
    plan, tasks = deal({"a": 1000, "b": 100, "c": 40, "d": 60, "e": 0}, 100, 1)
    assert plan["a"] == (0, 10) and plan["b"] == (10, 1)
    assert plan["c"] == plan["d"] == (11, 1) and plan["e"] == (11, 1) and tasks == 12
    spread, tasks = deal({m: 10 for m in range(16)}, 1000, 8)          # small folders keep all cores busy
    assert tasks == 8 and Counter(t for t, _ in spread.values()) == {t: 2 for t in range(8)}
    assert deal({}, 100, 8) == ({}, 0)
    assert deal({None: 250, 1: 1}, 100, 1)[0][None] == (0, 3)


def test_a_month_of_ten_times_the_target_has_ten_files(spark):
    model = _layer_model(spark, [HOT], range(1, 41), 25)               # 1,000 store-days
    model.train = model.train.unionByName(_layer_model(spark, [COLD], range(1, 11), 10).train)   # 100
    layer = build_layer(model, spark, file_rows=100)
    files = _files(layer.context)
    assert files == {HOT.isoformat(): 10, COLD.isoformat(): 1}
    sizes = [r["n"] for r in layer.context.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 200                                            # no task is loaded with two shares
    assert _same(layer.context, build_layer(model, spark, layout="sorted").context)


def test_one_hot_store_does_not_load_one_writer(spark):
    model = _layer_model(spark, [HOT], [1], 31)
    layer = build_layer(model, spark, file_rows=4)
    assert _files(layer.context)[HOT.isoformat()] >= 6


def test_rebalanced_folders_follow_the_measured_size(spark):
    """A written fact month of ten times the rows gets several files, a small one one."""
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    df = spark.range(0, 220_000, numPartitions=40).select(
        F.when(F.col("id") % 11 < 10, F.lit(HOT)).otherwise(F.lit(COLD)).alias("month_start"), F.xxhash64("id").alias("v"))
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(256 << 10))
        files = _files(write_table(df, spark, "t", partition_col="month_start"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert files[COLD.isoformat()] == 1 and 5 <= files[HOT.isoformat()] <= 15


def _with(model, **changed):
    tables = {n: getattr(model, n) for n in ("stores", "train", "transactions", "holidays", "oil")}
    return Model(**(tables | changed), materialise=False)


def _scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_ten_refreshes_leave_one_scan(spark):
    months = [dt.date(2016, m, 1) for m in range(1, 12)]
    model = _layer_model(spark, months, range(1, 4), 5)
    layer = build_layer(model, spark)
    for k, m in enumerate(months[:10]):
        model = _with(model, train=model.train.withColumn("sales", F.when(
            F.trunc("date", "MM") == F.lit(m), F.col("sales") + F.lit(k + 1)).otherwise(F.col("sales")).cast("decimal(14,4)")))
        layer = refresh_layer(layer, model)                            # found without `since`
        assert [x for x, g in layer.manifest.months.items() if g == k + 1] == [m]
    assert _scans(layer.context) == 1
    assert _same(layer.context, build_layer(model, spark).context)
    one = layer.context.filter(F.col("month_start") == F.lit(months[3]))
    text = spark._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [" in text and "gen#" in text and one.count() == 15
    before = layer.context.collect()
    dead = layer.manifest.drop_dead(spark)
    assert len(dead) == 10 and layer.manifest.drop_dead(spark) == []
    assert sorted(layer.context.collect(), key=str) == sorted(before, key=str)


@pytest.mark.parametrize("change", ["event", "price", "transactions", "month lost", "new month", "nothing", "a row twice"])
def test_changes_are_found_without_since(spark, change):
    months = [dt.date(2016, m, 1) for m in (1, 2, 3)]
    old = _layer_model(spark, months, range(1, 4), 9)
    extra = _layer_model(spark, [dt.date(2016, 4, 1)], range(1, 4), 2)
    new, stale = {
        "event": (_with(old, holidays=old.holidays.withColumn("type", F.lit("Bridge"))), {3}),
        "price": (_with(old, oil=old.oil.withColumn("dcoilwtico", F.lit(None).cast("decimal(12,4)"))), {3}),
        "transactions": (_with(old, transactions=spark.createDataFrame(
            [(dt.date(2016, 2, 3), 1, 7)], old.transactions.schema)), {2}),
        "month lost": (_with(old, train=old.train.filter(F.month("date") != 2)), set()),
        "new month": (_with(old, train=old.train.unionByName(extra.train)), {4}),
        "nothing": (old, set()),
        "a row twice": (_with(old, train=old.train.unionByName(old.train.filter(F.col("id") == 1))), {1}),
    }[change]
    layer = refresh_layer(build_layer(old, spark), new)
    assert {m.month for m, g in layer.manifest.months.items() if g == 1} == stale
    assert _same(layer.context, build_layer(new, spark).context)


def test_refresh_reads_only_the_rebuilt_months_facts(spark):
    layer = build_layer(_layer_model(spark, [dt.date(2016, m, 1) for m in (1, 2, 3, 4)], range(1, 4), 5), spark)
    by_month = layer.model.train_by_month
    assert len(_files(by_month)) == 4 and layer.model.train.columns == by_month.columns[:-1]
    facts = layer.model.facts([dt.date(2016, 2, 1)])
    plan = spark._jvm.PythonSQLUtils.explainString(facts._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(month_start" in plan or "PartitionFilters: [(month_start" in plan
    assert facts.groupBy(F.input_file_name().alias("f")).count().count() == 1 and facts.count() == 15


def test_fingerprints_see_nulls_copies_and_no_order(spark):
    d = dt.date(2016, 1, 5)
    make = lambda rows: spark.createDataFrame([(d, *r) for r in rows], "date date, a int, b int")
    base = fingerprints({"t": make([(1, None), (2, 3), (2, 3)])})
    assert base == fingerprints({"t": make([(2, 3), (1, None), (2, 3)]).repartition(3)})
    for other in ([(None, 1), (2, 3), (2, 3)], [(1, None), (2, 3)], [(1, None), (1, None), (2, 3)]):
        assert changed_months(base, fingerprints({"t": make(other)})) == {d.replace(day=1)}
    assert fingerprints({"t": make([])}) == {}


def test_empty_and_undated_facts(spark):
    model = _layer_model(spark, [COLD], range(1, 4), 4)
    none = _with(model, train=model.train.limit(0))
    layer = build_layer(none, spark)
    assert layer.context.count() == 0 and layer.manifest.months == {}
    full = refresh_layer(layer, model)
    assert _same(full.context, build_layer(model, spark).context)
    assert refresh_layer(full, none).context.count() == 0
    undated = _with(model, train=model.train.withColumn("date", F.when(F.col("store_nbr") > 1, F.col("date"))))
    assert build_layer(undated, spark).context.count() == build_layer(undated, spark, layout="sorted").context.count()


def test_tracked_layer_sees_a_file_overwritten_in_place(spark, tmp_path):
    model = _layer_model(spark, [HOT, COLD], range(1, 4), 4)
    path = os.path.join(tmp_path, "train.parquet")
    model.train.write.parquet(path)
    read = lambda: _with(model, train=spark.read.parquet(path))
    layer = build_layer(read(), spark, track=True)
    rows = model.train.withColumn("sales", F.when(F.month("date") == 4, F.lit(9)).otherwise(F.col("sales")).cast("decimal(14,4)"))
    rows.write.mode("overwrite").parquet(path)
    fresh = refresh_layer(layer, read())
    assert {m for m, g in fresh.manifest.months.items() if g == 1} == {COLD}
    assert _same(fresh.context, build_layer(read(), spark).context)


def test_layer_is_dealt_while_narrow(spark, monkeypatch):
    """What follows from the calendar is not shuffled, facts that hardly share a store-day are not
    added up before their shuffle, and a task writes a bounded number of rows of small months."""
    from conftest import make_model
    from demandlens.plans import storeday
    from demandlens.sources import sink

    seen = []
    write = storeday.write_dealt
    monkeypatch.setattr(storeday, "write_dealt", lambda df, *a, **k: (seen.append((df, k["widen"](df))), write(df, *a, **k))[1])
    monkeypatch.setattr(sink, "TASK_ROWS", 3)
    rows = [(f"2017-{m:02d}-{d:02d}", s, "A", 1, 0) for m in (1, 2, 3, 4) for d in (1, 2) for s in (1, 2, 3)]
    many = [(d, s, f"F{i}", 1, 0) for d, s, *_ in rows for i in range(40)]
    holidays = [("2017-01-01", "Holiday", "National", "X", "d", "False")]
    L = storeday.build_layer(make_model(spark, rows, holidays=holidays, oil=[("2017-01-02", 50)]), spark)
    storeday.build_layer(make_model(spark, many, holidays=holidays), spark)
    (narrow, wide), (few, _) = seen
    assert not set(narrow.columns) & {"month_name", "weekday_name", "oil_price", "is_holiday", "event_description_list"}
    assert wide.columns == storeday.CONTEXT_COLUMNS
    plan = lambda df: df.select("*")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan(narrow) and "REPARTITION_BY_COL" not in plan(few)
    found = {(r["date"].isoformat(), r["store_nbr"]): (r["month_name"], r["is_holiday"], r["oil_price"]) for r in L.context.collect()}
    assert len(found) == len(rows) and len(L.context.inputFiles()) >= 4
    assert found["2017-01-01", 1][:2] == ("January", 1) and found["2017-01-02", 3] == ("January", 0, 50)
