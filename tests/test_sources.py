"""The retail connector reads the published file layout with declared schemas, and the
model built from it runs through the layer and the queries."""

from __future__ import annotations

import csv
import os
import tempfile
from decimal import Decimal

from demandlens.plans import queries as Q
from demandlens.plans.storeday import build_layer
from demandlens.sources import load_model

FILES = {
    "stores": (["store_nbr", "city", "state", "type", "cluster"],
               [[1, "Quito", "Pichincha", "D", 13], [2, "Guayaquil", "Guayas", "B", 6]]),
    "train": (["id", "date", "store_nbr", "family", "sales", "onpromotion"],
              [[0, "2017-08-14", 1, "GROCERY I", "120.5", 3], [1, "2017-08-14", 1, "BEVERAGES", "0.0", 0],
               [2, "2017-08-14", 2, "GROCERY I", "77.125", 0], [3, "2017-08-15", 1, "GROCERY I", "99.0", 1],
               [4, "2017-08-15", 2, "GROCERY I", "10.0", 0]]),
    "transactions": (["date", "store_nbr", "transactions"], [["2017-08-14", 1, 20], ["2017-08-15", 2, 4]]),
    "holidays_events": (["date", "type", "locale", "locale_name", "description", "transferred"],
                        [["2017-08-15", "Holiday", "Local", "Quito", "Fundacion de Quito", "False"],
                         ["2017-08-14", "Holiday", "National", "Ecuador", "Primer Grito", "True"]]),
    "oil": (["date", "dcoilwtico"], [["2017-08-14", "47.59"], ["2017-08-15", ""]]),
}


def write_csvs() -> str:
    d = tempfile.mkdtemp(prefix="demandlens-retail-")
    for name, (header, rows) in FILES.items():
        with open(os.path.join(d, f"{name}.csv"), "w", newline="") as fh:
            w = csv.writer(fh)
            w.writerow(header)
            w.writerows(rows)
    return d


def test_retail_csv_connector(spark):
    model = load_model(spark, write_csvs(), binding="retail", fmt="csv")
    assert model.train.schema["sales"].dataType.simpleString() == "decimal(14,4)"
    assert model.train.count() == 5 and model.stores.count() == 2
    assert model.oil.filter("dcoilwtico IS NULL").count() == 1
    L = build_layer(model, spark, materialise=False)
    ctx = {(r["date"].isoformat(), r["store_nbr"]): r for r in L.context.collect()}
    quito = ctx[("2017-08-15", 1)]
    assert (quito["holiday_scope"], quito["is_holiday"], quito["event_description_list"]) == \
        ("Local", 1, "Fundacion de Quito")
    assert ctx[("2017-08-14", 1)]["is_special_day"] == 0            # transferred away
    assert ctx[("2017-08-14", 1)]["total_sales"] == Decimal("120.5000")
    assert float(ctx[("2017-08-14", 1)]["promo_family_mix_pct"]) == 50.0
    q13 = {r["day_group"]: r["store_days"] for r in Q.q13_holiday_lift(L).collect()}
    assert q13 == {"Non-Holiday": 3, "Local Holiday": 1}
    cc = {(r["table_name"], r["rule"]): r["violations"] for r in Q.constraint_report(L).collect()}
    assert all(v == 0 for v in cc.values())


def test_registered_views_answer_sql(spark):
    from demandlens.plans.catalog import layer_for, register_views
    L = layer_for(spark, "/root/testdata/sf0.001")
    names = register_views(L)
    assert "vw_store_day_context" in names
    n = spark.sql("SELECT count(*) AS n FROM vw_store_day_context WHERE is_holiday = 1").first()["n"]
    assert n == L.context.filter("is_holiday = 1").count()
    m = spark.sql("SELECT count(*) AS n FROM vw_store_holiday_map h JOIN vw_store_day_context c "
                  "USING (date, store_nbr)").first()["n"]
    assert m > 0


def test_command_line_writes_results(spark):
    import tempfile
    from demandlens.__main__ import main
    out = tempfile.mkdtemp(prefix="demandlens-cli-")
    assert main(["--input", "/root/testdata/sf0.001", "--binding", "tpch", "--queries",
                 "q13_holiday_lift,q08_concentration", "--out", out]) == 0
    assert spark.read.parquet(f"{out}/q13_holiday_lift").count() == 5
    assert spark.read.parquet(f"{out}/q08_concentration").count() == 2


def test_parquet_inputs_are_not_copied(spark):
    import tempfile as tf
    from demandlens.plans.storeday import build_layer as build
    csv_model = load_model(spark, write_csvs(), binding="retail", fmt="csv")
    assert csv_model.materialise
    pq = tf.mkdtemp(prefix="demandlens-retail-pq-")
    for name in ("stores", "train", "transactions", "holidays_events", "oil"):
        csv_model.table(name).write.parquet(f"{pq}/{name}.parquet")
    pq_model = load_model(spark, pq, binding="retail", fmt="parquet")
    assert not pq_model.materialise
    L = build(pq_model, spark)
    assert all(pq in f for f in L.model.train.inputFiles())          # read in place
    assert L.context.count() == 4


def test_cluster_sizing():
    from demandlens.session import cluster_conf
    c = cluster_conf(4000)
    assert int(c["spark.sql.shuffle.partitions"]) == 16000
    assert int(c["spark.sql.files.maxPartitionBytes"]) == 256 * 1024 * 1024
    assert int(cluster_conf(8)["spark.sql.shuffle.partitions"]) == 400      # floor for small clusters


def test_constraints_read_each_table_once(spark, tmp_path):
    """One scan a table and two groupings, with every kind of violation counted."""
    from conftest import make_model
    from demandlens.operators.audit import check_constraints
    from demandlens.plans.storeday import materialise_model

    day = "2017-01-01"
    model = make_model(
        spark, [(day, 1, "A", 1, 0), (day, 1, "A", 2, 0), (day, 1, "B", 1, 0), (day, 9, "A", 1, 0), (day, 9, "B", 1, 0)],
        transactions=[(day, 1, 5), (day, 1, 6), (day, 8, 7)], oil=[(day, 1), (day, 2), ("2017-01-02", None)],
        holidays=[(day, "Holiday", "National", "X", "d", "False")] * 3)
    found = check_constraints(materialise_model(model, spark))
    bad = {(r["table_name"], r["rule"]): r["violations"] for r in found.collect()}
    assert {k: v for k, v in bad.items() if v} == {
        ("train", "unique(date,store_nbr,family)"): 1, ("transactions", "unique(date,store_nbr)"): 1, ("oil", "unique(date)"): 1,
        ("holidays_events", "duplicate rows"): 2, ("train", "store_nbr -> stores.store_nbr"): 2,
        ("transactions", "store_nbr -> stores.store_nbr"): 1}
    plan = found.select("*")._jdf.queryExecution().executedPlan().toString()          # not executed yet
    assert plan.count("FileScan parquet") == 5 and plan.count("Exchange hashpartitioning") == 2
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_constraint_keys_are_grouped_after_their_shuffle(spark):
    """No groups before the shuffle, keys of unlike parts stay apart, NULL keys group, and a NULL child
    key has no parent."""
    from conftest import STORES
    from demandlens.operators.audit import check_constraints
    from demandlens.sources.model import Model

    day = "DATE'2017-01-01'"
    table = lambda columns, *rows: spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({columns})")
    model = Model(
        stores=table("store_nbr, city, state, type, cluster", *[str(s) for s in STORES], "(NULL, 'c', 's', 'A', 1)"),
        train=table("date, store_nbr, family, sales, onpromotion", f"({day}, 1, NULL, 1.0, 0)", f"({day}, 1, NULL, 1.0, 0)",
                    f"({day}, 2, '-', 1.0, 0)", f"({day}, 2, NULL, 1.0, 0)", f"({day}, NULL, 'A', NULL, 0)", f"({day}, 9, '', 1.0, 0)"),
        transactions=table("date, store_nbr, transactions", f"({day}, 1, 1)", f"({day}, 11, 1)", f"({day}, NULL, NULL)"),
        holidays=table("date, type, locale, locale_name, description, transferred", f"({day}, 'a', 'bc', 'd', 'e', NULL)",
                       f"({day}, 'ab', 'c', 'd', 'e', NULL)", f"({day}, 'ab', 'c', 'd', 'e', NULL)"),
        oil=table("date, dcoilwtico", f"({day}, 1.0)", "(NULL, 1.0)", "(NULL, 2.0)"))
    found = check_constraints(model)
    bad = {(r["table_name"], r["rule"]): r["violations"] for r in found.collect()}
    assert {k: v for k, v in bad.items() if v} == {
        ("train", "unique(date,store_nbr,family)"): 1, ("oil", "unique(date)"): 1, ("holidays_events", "duplicate rows"): 1,
        ("train", "store_nbr -> stores.store_nbr"): 2, ("transactions", "store_nbr -> stores.store_nbr"): 2,
        ("stores", "not_null(store_nbr)"): 1, ("train", "not_null(store_nbr)"): 1, ("train", "not_null(family)"): 3,
        ("train", "not_null(sales)"): 1, ("transactions", "not_null(store_nbr)"): 1, ("transactions", "not_null(transactions)"): 1,
        ("holidays_events", "not_null(transferred)"): 3, ("oil", "not_null(date)"): 2}
    plan = found.select("*")._jdf.queryExecution().executedPlan().toString()
    first = plan[plan.rindex("Exchange hashpartitioning"):]               # the lowest exchange and what is under it
    assert "REPARTITION_BY_NUM" in first.splitlines()[0] and "HashAggregate" not in first
