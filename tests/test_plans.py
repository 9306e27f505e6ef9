"""Plan tests: the physical plans have the shape the design promises."""

from __future__ import annotations

import os

import pytest

from demandlens.plans.catalog import layer_for
from demandlens.plans.queries import QUERIES

SF = os.environ.get("DEMANDLENS_TEST_SF", "/root/testdata/sf0.001")


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def L(spark):
    if not os.path.exists(f"{SF}/lineitem.parquet"):
        pytest.skip("driver tables not present")
    return layer_for(spark, SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_products(L, name):
    plan = plan_text(QUERIES[name](L))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_layer_is_read_from_written_parquet(L):
    plan = plan_text(L.context)
    assert "FileScan parquet" in plan and "Exchange" not in plan


def test_store_risk_prunes_the_scan(L):
    df = QUERIES["q11_store_risk"](L)
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    pushed = [line for line in text.splitlines() if line.startswith("PushedFilters")]
    assert any("GreaterThanOrEqual(date," in p for p in pushed)
    # whole month folders are skipped, and what is left holds only the window's months
    assert "PartitionFilters: [isnotnull(month_start" in text
    first = L.last_date().replace(day=1)
    months = {r[0] for r in L.context.select("month_start").distinct().collect()}
    assert len(months) > 12 and sum(m >= first.replace(year=first.year - 1) for m in months) < len(months) / 2


def test_column_pruning_on_layer(L):
    plan = plan_text(QUERIES["q13_holiday_lift"](L))
    # the scan reads only the columns the query needs (the plan text is cut after ~100 chars)
    assert "ReadSchema: struct<total_sales:decimal(24,4),transactions:int,sales_per_transaction:double," \
           "is_holiday:int" in plan
    assert "ReadSchema: struct<date:" not in plan


def test_fact_path_single_scan(L):
    """Q9 reads the fact table once: both branches reuse the (store, family) aggregate."""
    df = QUERIES["q09_cluster_index"](L)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final
    assert final.count("train-") == 1


def test_layer_build_shuffles_fact_once_and_broadcasts_dimensions(spark, L):
    from demandlens.plans.storeday import (oil_prices_filled, store_day_context, store_day_enriched,
                                           store_day_metrics)
    m = L.model
    ctx = store_day_context(store_day_enriched(store_day_metrics(m.train, m.stores), m.transactions,
                                               oil_prices_filled(m.oil)), m.holidays)
    text = spark._jvm.PythonSQLUtils.explainString(ctx._jdf.queryExecution(), "formatted")
    assert text.count("hashpartitioning(date#") + text.count("hashpartitioning(store_nbr#") >= 1
    assert "SortMergeJoin" not in text and "CartesianProduct" not in text
    # stores, transactions (small here), oil calendar and the three event digests
    assert text.count("BroadcastHashJoin") >= 6
    # exactly one shuffle carries fact rows: the (date, store) aggregate
    fact_shuffles = [line for line in text.splitlines()
                     if "Arguments: hashpartitioning(" in line and "store_nbr" in line and "date" in line]
    assert len(fact_shuffles) == 1


def test_monthly_layout_prunes_folders_and_keeps_results(spark, L):
    import dataclasses
    from demandlens.plans.storeday import build_layer
    M, L = L, build_layer(L.model, spark, materialise=True, layout="sorted")
    assert M.context.columns == L.context.columns
    for name in ("q11_store_risk", "x3_comparable_ytd", "q13_holiday_lift", "q03_monthly_kpi"):
        a = sorted(map(tuple, QUERIES[name](L).collect()), key=str)
        b = sorted(map(tuple, QUERIES[name](M).collect()), key=str)
        assert a == b
    text = spark._jvm.PythonSQLUtils.explainString(QUERIES["q11_store_risk"](M)._jdf.queryExecution(),
                                                   "formatted")
    assert "PartitionFilters: [isnotnull(month_start" in text and "month_start#" in text
    assert dataclasses.is_dataclass(M)


def test_large_transactions_join_reuses_the_fact_partitioning(spark, L):
    """When transactions are too large to broadcast, the sort-merge join reuses the hash
    partitioning of the (date, store) aggregate: only the transactions side is shuffled."""
    from demandlens.plans.storeday import (oil_prices_filled, store_day_context, store_day_enriched,
                                           store_day_metrics)
    m = L.model

    def size(df):
        return sum(os.path.getsize(f.replace("file://", "").replace("file:", "")) for f in df.inputFiles())
    dims = max(size(m.stores), size(m.oil), size(m.holidays))
    tx = size(m.transactions)
    assert dims < tx
    limit = str((dims + tx) // 2)          # dimensions stay under it, transactions do not
    old = (spark.conf.get("spark.sql.autoBroadcastJoinThreshold"),
           spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold"))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", limit)
        ctx = store_day_context(store_day_enriched(store_day_metrics(m.train, m.stores), m.transactions,
                                                   oil_prices_filled(m.oil)), m.holidays)
        text = spark._jvm.PythonSQLUtils.explainString(ctx._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", old[1])
    tree = text.split("\n\n")[0]
    assert tree.count("SortMergeJoin") == 1 and "SortMergeJoin LeftOuter" in tree
    lines = tree.splitlines()
    i = next(k for k, ln in enumerate(lines) if "SortMergeJoin" in ln)
    # left (stream) side: down to the store broadcast join over the aggregate, no new Exchange
    j = next(k for k in range(i + 1, len(lines)) if "BroadcastHashJoin Inner" in lines[k])
    assert not any("Exchange" in ln for ln in lines[i + 1:j])
    # exactly two shuffles carry store-day rows: the aggregate and the transactions side
    assert sum(1 for ln in text.splitlines()
               if ln.startswith("Arguments: hashpartitioning(date#") and "store_nbr" in ln) == 2


def _same(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _model(m, **changed):
    from demandlens.sources.model import Model
    tables = {"stores": m.stores, "train": m.train, "transactions": m.transactions, "holidays": m.holidays, "oil": m.oil}
    return Model(**(tables | changed), materialise=False)


def _cases(m, last):
    from pyspark.sql import functions as F
    cut = last.replace(day=1).replace(year=last.year - 1)
    month = last.replace(day=1)
    early = m.holidays.agg(F.min("date")).first()[0]
    before = lambda df, d: df.filter(F.col("date") < d)
    return {
        "new months": (_model(m, train=before(m.train, cut), transactions=before(m.transactions, cut), oil=before(m.oil, cut)),
                       m, cut),
        "late rows of an old month": (_model(m, train=m.train.filter((F.col("date") < cut) | (F.col("store_nbr") % 2 == 0))),
                                      m, cut),
        "a month that lost all rows": (m, _model(m, train=before(m.train, month)), month),
        "a corrected event": (m, _model(m, holidays=m.holidays.withColumn(
            "type", F.when(F.col("date") == F.lit(early), F.lit("Event")).otherwise(F.col("type")))), month),
        "a corrected price": (_model(m, oil=m.oil.withColumn("dcoilwtico", F.when(
            F.col("date") > F.lit(cut), F.col("dcoilwtico")))), m, month),
        "another store dimension": (m, _model(m, stores=m.stores.withColumn("city", F.lit("Elsewhere"))), month),
    }


@pytest.mark.parametrize("case", ["new months", "late rows of an old month", "a month that lost all rows",
                                  "a corrected event", "a corrected price", "another store dimension"])
def test_refresh_equals_full_build(spark, L, case):
    from demandlens.plans.storeday import build_layer, refresh_layer
    old, new, since = _cases(L.model, L.last_date())[case]
    fresh = refresh_layer(build_layer(old, spark), new, since)
    full = build_layer(new, spark)
    assert _same(fresh.context, full.context)
    assert fresh.last_date() == full.last_date()


def test_refresh_refuses_a_flat_layer(spark, L):
    from demandlens.plans.storeday import build_layer, refresh_layer
    with pytest.raises(ValueError):
        refresh_layer(build_layer(L.model, spark, layout="sorted"), L.model, L.last_date())


def test_a_cluster_without_a_shared_folder_is_an_error():
    from demandlens.session import checkpoint_root

    class Fake:
        conf = {"spark.master": "spark://host:7077"}
        sparkContext = type("C", (), {"getCheckpointDir": staticmethod(lambda: None)})
    with pytest.raises(RuntimeError):
        checkpoint_root(Fake)
    Fake.conf = {"spark.master": "spark://host:7077", "spark.checkpoint.dir": "hdfs://shared/x/"}
    assert checkpoint_root(Fake) == "hdfs://shared/x"


def _single_partition_rows(df):
    """Row counts (AQE run-time statistics) of every shuffle into one partition."""
    import re
    df.collect()
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    tree, _, details = text.partition("\n\n")
    single = set(re.findall(r"\((\d+)\) Exchange\s*\nInput[^\n]*\nArguments: SinglePartition", details))
    rows = []
    lines = tree.splitlines()
    for k, ln in enumerate(lines[:-1]):
        m = re.search(r"ShuffleQueryStage \(\d+\), Statistics\(sizeInBytes=[^,]*, rowCount=([0-9.E+]+)\)", ln)
        n = re.search(r"Exchange \((\d+)\)", lines[k + 1])
        if m and n and n.group(1) in single:
            rows.append(float(m.group(1)))
    return rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_single_partition_shuffle_of_fact_sized_data(L, name):
    """Whatever reaches one partition is at most an entity table (dates, stores, family x
    month), never layer- or fact-sized."""
    from pyspark.sql import functions as F
    if name.startswith(("s_", "v")):
        return
    if not hasattr(L, "_entity_bound"):
        ctx, train = L.context, L.model.train
        calendar = ctx.select("date").distinct().count() + L.model.oil.count()   # spine + prices
        L._entity_bound = max(calendar, train.select("store_nbr").distinct().count(),
                              train.select("family", F.trunc("date", "MM")).distinct().count())
    assert L._entity_bound < L.context.count()
    for rows in _single_partition_rows(QUERIES[name](L)):
        assert rows <= 1.01 * L._entity_bound      # printed statistics keep 3 digits


def test_bound_facts_are_grouped_after_their_shuffle(spark):
    """The tasks that scan the raw tables hold no groups: facts and transactions are dealt first."""
    from demandlens.sources.tpch import bind_train, bind_transactions
    day = "TIMESTAMP'2017-01-01 00:00:00'"
    raw = {"lineitem": f"""VALUES (1, 1, 7, {day}, 10.0D, 'N', 0.08D), (1, 1, 7, {day}, 5.0D, 'R', 0.0D), (2, 1, 7, {day}, 1.5D, 'N', 0.0D),
                           (3, 2, NULL, {day}, 2.0D, 'N', 0.07D), (9, 9, 8, {day}, 1.0D, 'N', 0.0D)
                           AS t(l_orderkey, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_returnflag, l_discount)""",
           "part": "VALUES (1, 'A'), (2, 'B') AS t(p_partkey, p_brand)",
           "orders": "VALUES (1, 'O'), (2, 'F'), (3, 'P') AS t(o_orderkey, o_orderstatus)"}
    read = lambda name: spark.sql("SELECT * FROM " + raw[name])
    train, transactions = bind_train(read), bind_transactions(read)
    assert sorted((r["store_nbr"] or 0, r["family"], float(r["sales"]), r["onpromotion"]) for r in train.collect()) == [
        (0, "B", 2.0, 1), (7, "A", 11.5, 1)]
    assert [(r["store_nbr"], r["transactions"]) for r in transactions.collect()] == [(7, 2)]
    for df in (train, transactions):
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" not in plan[plan.index("REPARTITION_BY_NUM"):]
