"""Properties of the operators (blueprint section 5.3) on the driver's smallest tables, and
brute-force checks of the custom operators on random inputs."""

from __future__ import annotations

import datetime as dt
import os
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from demandlens.operators.events import SCOPES, applicable_events, collapse_events
from demandlens.operators.temporal import asof_fill, forward_fill
from demandlens.plans.catalog import layer_for
from demandlens.plans.queries import QUERIES
from demandlens.plans.storeday import store_day_metrics

SF = os.environ.get("DEMANDLENS_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def L(spark):
    if not os.path.exists(f"{SF}/lineitem.parquet"):
        pytest.skip("driver tables not present")
    return layer_for(spark, SF)


def test_no_fan_out(L):
    assert L.context.count() == store_day_metrics(L.model.train, L.model.stores).count()
    assert L.context.select("date", "store_nbr").distinct().count() == L.context.count()


def test_shares_sum_to_100(L):
    rows = QUERIES["q09_cluster_index"](L).collect()
    per_cluster = defaultdict(float)
    for r in rows:
        per_cluster[r["cluster"]] += r["cluster_share_pct"]
    for total in per_cluster.values():
        assert abs(total - 100) <= 0.005 * len(rows)
    fam = QUERIES["q06_portfolio_roles"](L).collect()
    assert abs(sum(r["revenue_share_pct"] for r in fam) - 100) <= 0.005 * len(fam)


def test_hhi_bounds(L):
    for r in QUERIES["q08_concentration"](L).collect():
        n = r["entity_count"]
        assert 1 / n - 1e-4 <= r["hhi"] <= 1.0
        assert r["top_1_share_pct"] <= r["top_20pct_share_pct"] <= 100.0


def test_quartile_sizes(L):
    rows = QUERIES["q12_store_archetypes"](L).collect()
    for col in ("revenue_quartile", "basket_quartile"):
        sizes = [sum(1 for r in rows if r[col] == q) for q in (1, 2, 3, 4)]
        assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


def test_day_groups_partition_store_days(L):
    rows = QUERIES["q13_holiday_lift"](L).collect()
    assert sum(r["store_days"] for r in rows) == L.context.count()


def test_invariant_to_shuffle_partitions(spark, L):
    names = ["q03_monthly_kpi", "q10_store_scorecard", "q14_event_lift", "q16_network_anomalies"]
    before = {n: sorted(map(tuple, QUERIES[n](L).collect()), key=str) for n in names}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        after = {n: sorted(map(tuple, QUERIES[n](L).collect()), key=str) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert before == after


# ---------------------------------------------------------------- brute force on random inputs
SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])
BASE = dt.date(2016, 1, 1)


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.integers(1, 99)), min_size=1, max_size=12),
       st.lists(st.integers(0, 20), min_size=1, max_size=8))
def test_fills_match_brute_force(spark, prices, spine_days):
    oil = [(BASE + dt.timedelta(days=2 * i), p) for i, p in enumerate(prices)]
    df = spark.createDataFrame(oil, "date date, p int")
    ff = {r["date"]: r["f"] for r in forward_fill(df, "p", "date", out="f").select("date", "f").collect()}
    last, want = None, {}
    for d, p in oil:
        last = p if p is not None else last
        want[d] = last
    assert ff == want
    # idempotent
    again = forward_fill(forward_fill(df, "p", "date", out="f").select("date", F.col("f").alias("p")),
                         "p", "date", out="f")
    assert {r["date"]: r["f"] for r in again.collect()} == want
    spine = spark.createDataFrame([(BASE + dt.timedelta(days=d),) for d in spine_days], "date date")
    got = {r["date"]: r["a"] for r in asof_fill(df, spine, "date", "p", out="a").collect()}
    for d in {BASE + dt.timedelta(days=x) for x in spine_days}:
        known = [p for od, p in oil if od <= d and p is not None]
        assert got[d] == (known[-1] if known else None)


STORES = [(1, "Quito", "Pichincha"), (2, "Quito", "Pichincha"), (3, "Guayaquil", "Guayas"),
          (4, "Cuenca", "Azuay")]
EVENT = st.tuples(st.integers(0, 3), st.sampled_from(["Holiday", "Event", "Transfer", "Work Day"]),
                  st.sampled_from([("National", "Ecuador"), ("Regional", "Pichincha"),
                                   ("Regional", "Guayas"), ("Local", "Quito"), ("Local", "Cuenca")]),
                  st.sampled_from(["a", "b", "c"]), st.sampled_from(["True", "False"]))


@SETTINGS
@given(st.lists(EVENT, max_size=10))
def test_collapse_matches_brute_force(spark, events):
    hol = [(BASE + dt.timedelta(days=d), ty, loc, name, desc, tr) for d, ty, (loc, name), desc, tr in events]
    hdf = spark.createDataFrame(hol, "date date, type string, locale string, locale_name string, "
                                     "description string, transferred string")
    targets = spark.createDataFrame([(BASE + dt.timedelta(days=d), s, c, stt) for d in range(4)
                                     for s, c, stt in STORES],
                                    "date date, store_nbr int, city string, state string")
    got = {(r["date"], r["store_nbr"]): (r["is_special_day"], r["is_holiday"], r["holiday_scope"],
                                         r["event_type_list"], r["event_description_list"])
           for r in collapse_events(targets, applicable_events(hdf), SCOPES).collect()}
    assert len(got) == 4 * len(STORES)
    kept = {"Holiday", "Additional", "Bridge", "Event", "Transfer"}
    for d in range(4):
        day = BASE + dt.timedelta(days=d)
        for s, city, state in STORES:
            hits = [(loc, ty, desc) for dd, ty, loc, name, desc, tr in hol
                    if dd == day and ty in kept and tr.lower() != "true"
                    and (loc == "National" or (loc == "Regional" and name == state)
                         or (loc == "Local" and name == city))]
            if not hits:
                want = (0, 0, "None", "None", "None")
            else:
                scopes = {h[0] for h in hits}
                want = (1, int(any(h[1] == "Holiday" for h in hits)),
                        "Mixed" if len(scopes) > 1 else scopes.pop(),
                        ", ".join(sorted({h[1] for h in hits})), " | ".join(sorted({h[2] for h in hits})))
            assert got[(day, s)] == want


@SETTINGS
@given(st.lists(EVENT, max_size=10))
def test_attribution_matches_brute_force(spark, events):
    from demandlens.operators.events import attribute_events
    hol = [(BASE + dt.timedelta(days=d), ty, loc, name, desc, tr) for d, ty, (loc, name), desc, tr in events]
    hdf = spark.createDataFrame(hol, "date date, type string, locale string, locale_name string, "
                                     "description string, transferred string")
    targets = spark.createDataFrame([(BASE + dt.timedelta(days=d), s, c, stt) for d in range(4)
                                     for s, c, stt in STORES],
                                    "date date, store_nbr int, city string, state string")
    got = sorted((r["date"], r["store_nbr"], r["holiday_scope"], r["event_type"], r["description"])
                 for r in attribute_events(applicable_events(hdf), targets).collect())
    kept = {"Holiday", "Additional", "Bridge", "Event", "Transfer"}
    want = sorted((dd, s, loc, ty, desc)
                  for dd, ty, loc, name, desc, tr in hol if ty in kept and tr.lower() != "true"
                  for d in range(4) if BASE + dt.timedelta(days=d) == dd
                  for s, city, state in STORES
                  if loc == "National" or (loc == "Regional" and name == state)
                  or (loc == "Local" and name == city))
    assert got == want                 # duplicates of a calendar row are kept, as the source counts them


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.integers(0, 5)), min_size=1, max_size=25))
def test_partitioned_ranks_match_windows(spark, values):
    from pyspark.sql import Window
    from demandlens.operators.ranking import dense_ranks, ntiles, percent_ranks
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v int")
    got_d = {r["k"]: r["d"] for r in dense_ranks(df, "v", "d", descending=True).collect()}
    got_p = {r["k"]: r["p"] for r in percent_ranks(df, "v", "p").collect()}
    got_n = {r["k"]: r["n"] for r in ntiles(df, 4, "v", "k", "n", descending=True).collect()}
    ref = df.select("k",
                    F.dense_rank().over(Window.orderBy(F.col("v").desc())).alias("d"),
                    F.percent_rank().over(Window.orderBy(F.col("v").asc_nulls_first())).alias("p"),
                    F.ntile(4).over(Window.orderBy(F.col("v").desc(), F.col("k").asc())).alias("n")).collect()
    assert got_d == {r["k"]: r["d"] for r in ref}
    assert got_p == {r["k"]: r["p"] for r in ref}
    assert got_n == {r["k"]: r["n"] for r in ref}


def test_fills_per_series(spark):
    rows = [("a", dt.date(2016, 1, 1), 10), ("a", dt.date(2016, 1, 3), None), ("b", dt.date(2016, 1, 2), None),
            ("b", dt.date(2016, 1, 3), 7), ("b", dt.date(2016, 1, 5), None)]
    df = spark.createDataFrame(rows, "s string, date date, p int")
    ff = {(r["s"], r["date"].day): r["f"] for r in forward_fill(df, "p", "date", ["s"], out="f").collect()}
    assert ff == {("a", 1): 10, ("a", 3): 10, ("b", 2): None, ("b", 3): 7, ("b", 5): 7}
    spine = spark.createDataFrame([(s, dt.date(2016, 1, d)) for s in "ab" for d in (1, 2, 4, 6)], "s string, date date")
    got = {(r["s"], r["date"].day): r["a"] for r in asof_fill(df, spine, "date", "p", out="a", partition_by=["s"]).collect()}
    assert got == {("a", 1): 10, ("a", 2): 10, ("a", 4): 10, ("a", 6): 10,
                   ("b", 1): None, ("b", 2): None, ("b", 4): 7, ("b", 6): 7}
