"""Micro fixtures with hand-computed answers, one per trap of the semantics ledger."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandlens.plans import queries as Q
from demandlens.plans.storeday import build_layer
from conftest import D, make_model

DAYS = ["2017-08-10", "2017-08-11", "2017-08-12", "2017-08-13", "2017-08-14", "2017-08-15"]


def layer(spark, model):
    return build_layer(model, spark, materialise=False)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# ---------------------------------------------------------------- F1 oil fill (T1, T2)
@pytest.fixture(scope="module")
def oil_layer(spark):
    train = [(d, 1, "A", 10, 0) for d in DAYS]
    oil = [("2017-08-10", None), ("2017-08-11", 50), ("2017-08-14", None), ("2017-08-15", 52)]
    return layer(spark, make_model(spark, train, oil=oil))


def test_f1_forward_fill_only_existing_rows(oil_layer):
    filled = dict(rows(Q.v2_oil_prices_filled(oil_layer), "date", "oil_price_filled"))
    assert filled == {D("2017-08-10"): None, D("2017-08-11"): 50.0,
                      D("2017-08-14"): 50.0, D("2017-08-15"): 52.0}


def test_f1_weekends_stay_missing(oil_layer):
    got = {r[0]: (r[1], r[2]) for r in rows(oil_layer.context, "date", "oil_price", "missing_oil_flag")}
    assert got[D("2017-08-12")] == (None, 1) and got[D("2017-08-13")] == (None, 1)
    assert got[D("2017-08-10")] == (None, 1)
    assert float(got[D("2017-08-14")][0]) == 50.0 and got[D("2017-08-14")][1] == 0


def test_f1_asof_fill_fills_the_spine(oil_layer):
    got = dict(rows(Q.asof_oil_fill(oil_layer), "date", "oil_price_asof"))
    assert got[D("2017-08-12")] == 50.0 and got[D("2017-08-13")] == 50.0
    assert got[D("2017-08-10")] is None and got[D("2017-08-15")] == 52.0


# ---------------------------------------------------------------- F2-F8 event attribution
EV_DAYS = [f"2016-03-0{i}" for i in range(1, 9)]
HOLIDAYS = [
    ("2016-03-01", "Holiday", "Local", "Quito", "Quito Day", "False"),            # F2
    ("2016-03-02", "Holiday", "Regional", "Guayas", "Guayas Day", "False"),       # F3
    ("2016-03-03", "Holiday", "National", "Ecuador", "Moved Day", "True"),        # F4
    ("2016-03-04", "Transfer", "National", "Ecuador", "Moved Day", "False"),      # F4
    ("2016-03-05", "Work Day", "National", "Ecuador", "Make-up", "False"),        # F5
    ("2016-03-06", "Event", "National", "Ecuador", "Fair", "False"),              # F6
    ("2016-03-06", "Holiday", "Local", "Quito", "Quito Fest", "False"),           # F6
    ("2016-03-07", "Holiday", "National", "Ecuador", "B Day", "False"),           # F7
    ("2016-03-07", "Holiday", "National", "Ecuador", "A Day", "False"),           # F7
    ("2016-03-08", "Holiday", "National", "Ecuador", "Dup Day", "False"),         # F8
    ("2016-03-08", "Holiday", "National", "Ecuador", "Dup Day", "False"),         # F8
]


@pytest.fixture(scope="module")
def ev_layer(spark):
    train = [(d, s, "A", 100, 0) for d in EV_DAYS for s in (1, 2, 3)]
    tx = [(d, s, 10) for d in EV_DAYS for s in (1, 2, 3)]
    return layer(spark, make_model(spark, train, transactions=tx, holidays=HOLIDAYS))


def ctx_of(L, day):
    return {r["store_nbr"]: r for r in L.context.filter(F.col("date") == D(day)).collect()}


def map_of(L, day):
    return sorted(rows(Q.v4_store_holiday_map(L).filter(F.col("date") == D(day)),
                       "store_nbr", "holiday_scope", "event_type", "description"))


def test_f2_local_scope(ev_layer):
    assert map_of(ev_layer, "2016-03-01") == [(1, "Local", "Holiday", "Quito Day"),
                                              (2, "Local", "Holiday", "Quito Day")]


def test_f3_regional_scope(ev_layer):
    assert map_of(ev_layer, "2016-03-02") == [(3, "Regional", "Holiday", "Guayas Day")]


def test_f4_transferred_and_transfer_day(ev_layer):
    assert map_of(ev_layer, "2016-03-03") == []
    c = ctx_of(ev_layer, "2016-03-04")
    assert all(c[s]["is_special_day"] == 1 and c[s]["is_holiday"] == 0
               and c[s]["holiday_scope"] == "National" for s in (1, 2, 3))


def test_f5_work_day_dropped(ev_layer):
    assert map_of(ev_layer, "2016-03-05") == []
    assert all(r["is_special_day"] == 0 and r["holiday_scope"] == "None"
               for r in ctx_of(ev_layer, "2016-03-05").values())


def test_f6_mixed_scope(ev_layer):
    c = ctx_of(ev_layer, "2016-03-06")
    for s in (1, 2):
        assert (c[s]["holiday_scope"], c[s]["is_holiday"], c[s]["event_type_list"],
                c[s]["event_description_list"]) == ("Mixed", 1, "Event, Holiday", "Fair | Quito Fest")
    assert (c[3]["holiday_scope"], c[3]["is_holiday"], c[3]["event_type_list"]) == ("National", 0, "Event")


def test_f7_two_events_one_row(ev_layer):
    c = ctx_of(ev_layer, "2016-03-07")
    assert len(c) == 3
    assert all(r["event_description_list"] == "A Day | B Day" and r["holiday_scope"] == "National"
               for r in c.values())


def test_f7_f8_event_lift_counts(ev_layer):
    ep = {r["description"]: r["affected_store_days"]
          for r in Q.q14_event_lift(ev_layer, min_days=1).collect()}
    assert ep["A Day"] == 3 and ep["B Day"] == 3
    assert ep["Dup Day"] == 6          # T15: duplicate calendar rows count twice
    assert "Make-up" not in ep and ep["Moved Day"] == 3


def test_f8_duplicates_do_not_fan_out(ev_layer):
    assert ev_layer.context.count() == 3 * len(EV_DAYS)
    c = ctx_of(ev_layer, "2016-03-08")
    assert all(r["event_description_list"] == "Dup Day" for r in c.values())
    cc = {(r["table_name"], r["rule"]): r["violations"] for r in Q.constraint_report(ev_layer).collect()}
    assert cc[("holidays_events", "duplicate rows")] == 1


def test_q13_day_groups_sum_to_store_days(ev_layer):
    q = Q.q13_holiday_lift(ev_layer).collect()
    assert sum(r["store_days"] for r in q) == ev_layer.context.count()
    base = [r for r in q if r["day_group"] == "Non-Holiday"][0]
    assert base["revenue_lift_pct"] == 0.0


def test_q16_event_context_lists_mapped_events(ev_layer):
    # Constant network revenue: sd = 0, z NULL, no rows and no error (F18).
    assert Q.q16_network_anomalies(ev_layer).count() == 0


# ---------------------------------------------------------------- F9, F10, F20 store-day columns
@pytest.fixture(scope="module")
def sd_layer(spark):
    train = [("2017-08-13", 1, "A", 100, 0),                                     # F9
             ("2017-08-14", 2, "A", 0, 3), ("2017-08-14", 2, "B", 0, 0),        # F10
             ("2017-08-14", 2, "C", 0, 0), ("2017-08-14", 2, "D", 0, 0)]
    tx = [("2017-08-14", 2, 5)]
    return layer(spark, make_model(spark, train, transactions=tx))


def test_f9_missing_transactions(sd_layer):
    r = ctx_of(sd_layer, "2017-08-13")[1]
    assert (r["transactions"], r["missing_transactions_flag"], r["sales_per_transaction"]) == (0, 1, None)
    q2 = Q.q02_anomaly_flags(sd_layer).first()
    assert q2["sales_without_transactions_store_days"] == 1
    assert q2["unscorable_basket_quality_store_days"] == 1
    assert q2["traffic_without_sales_store_days"] == 1


def test_f10_promo_mix(sd_layer):
    r = ctx_of(sd_layer, "2017-08-14")[2]
    assert float(r["promo_family_mix_pct"]) == 25.0 and r["family_rows"] == 4
    assert Q.q01_coverage(sd_layer).first()["zero_sales_store_days"] == 1


def test_f20_calendar_parts(sd_layer):
    sun, mon = ctx_of(sd_layer, "2017-08-13")[1], ctx_of(sd_layer, "2017-08-14")[2]
    assert (sun["weekday_num"], sun["is_weekend"], sun["weekday_name"]) == (6, 1, "Sunday")
    assert (mon["weekday_num"], mon["is_weekend"], mon["weekday_name"]) == (0, 0, "Monday")
    assert (sun["month_name"], sun["month_start"]) == ("August", dt.date(2017, 8, 1))
    assert Q.q03_monthly_kpi(sd_layer).first()["month"] == "2017-08"


# ---------------------------------------------------------------- F11, F12 monthly trend
def test_f11_rolling_and_mom(spark):
    train = [("2015-01-05", 1, "A", 10, 0), ("2015-02-05", 1, "A", 20, 0), ("2015-03-05", 1, "A", 40, 0)]
    q = Q.q03_monthly_kpi(layer(spark, make_model(spark, train))).collect()
    assert [r["rolling_3m_revenue"] for r in q] == [10.0, 15.0, 23.33]
    assert [r["mom_growth_pct"] for r in q] == [None, 100.0, 100.0]


def test_f12_positional_vs_calendar_yoy(spark):
    months = [f"2015-{m:02d}-05" for m in range(1, 13) if m != 6] + ["2016-01-05", "2016-02-05"]
    train = [(d, 1, "A", 100 + i, 0) for i, d in enumerate(months)]
    L = layer(spark, make_model(spark, train))
    pos = {r["month"]: r["yoy_growth_pct"] for r in Q.q03_monthly_kpi(L).collect()}
    cal = {r["month"]: r["yoy_growth_pct"] for r in Q.monthly_growth_calendar(L).collect()}
    # 2016-02 is the 13th row: positional lag 12 lands on 2015-01 (value 100)
    assert pos["2016-02"] == round(100 * (112 - 100) / 100, 2)
    assert cal["2016-02"] == round(100 * (112 - 101) / 101, 2)
    assert pos["2016-01"] is None and cal["2016-01"] == round(100 * (111 - 100) / 100, 2)


# ---------------------------------------------------------------- F13 same-store growth
def test_f13_same_store(spark):
    train = [("2015-03-05", 1, "A", 100, 0), ("2016-03-05", 1, "A", 110, 0),
             ("2016-03-05", 3, "A", 50, 0), ("2015-03-06", 2, "A", 0, 0), ("2016-03-06", 2, "A", 30, 0)]
    L = layer(spark, make_model(spark, train))
    r = Q.q04_same_store_growth(L).first()
    assert (r["month"], r["comparable_stores"], r["current_revenue"], r["prior_year_revenue"]) == \
        ("2016-03", 2, 140.0, 100.0)
    a = Q.q04_same_store_growth_active(L).first()
    assert (a["comparable_stores"], a["current_revenue"]) == (1, 110.0)


# ---------------------------------------------------------------- F14 concentration
def test_f14_concentration(spark):
    train = [("2016-01-01", 1, "X", 60, 0), ("2016-01-01", 1, "Y", 30, 0), ("2016-01-01", 1, "Z", 10, 0)]
    q = {r["entity_type"]: r for r in Q.q08_concentration(layer(spark, make_model(spark, train))).collect()}
    f = q["Product Family Mix"]
    assert (f["entity_count"], f["hhi"], f["top_1_share_pct"], f["top_20pct_share_pct"]) == (3, 0.46, 60.0, 60.0)
    assert q["Store Network"]["hhi"] == 1.0


# ---------------------------------------------------------------- F15 NTILE sizes
def test_f15_ntile_sizes(spark):
    stores = [(i, "C", "S", "A", 1) for i in range(1, 7)]
    train = [("2016-01-01", i, "A", 10 * i, 0) for i in range(1, 7)]
    q = Q.q12_store_archetypes(layer(spark, make_model(spark, train, stores=stores))).collect()
    sizes = [sum(1 for r in q if r["revenue_quartile"] == k) for k in (1, 2, 3, 4)]
    assert sizes == [2, 2, 1, 1]
    assert {r["store_nbr"] for r in q if r["revenue_quartile"] == 1} == {5, 6}


# ---------------------------------------------------------------- F16 promotion
def test_f16_never_promoted(spark):
    train = [("2016-01-01", 1, "A", 10, 0), ("2016-01-02", 1, "A", 20, 0),
             ("2016-01-01", 1, "B", 10, 0), ("2016-01-02", 1, "B", 30, 2)]
    q = {r["family"]: r for r in Q.q07_promo_dependency(layer(spark, make_model(spark, train))).collect()}
    a = q["A"]
    assert (a["avg_sales_when_promoted"], a["promo_uplift_pct"], a["promo_profile"]) == \
        (None, None, "Low Promo Sensitivity")
    b = q["B"]
    assert (b["promo_row_pct"], b["promo_uplift_pct"], b["promo_profile"]) == \
        (50.0, 200.0, "High Dependency / High Response")


# ---------------------------------------------------------------- F17 risk window
def test_f17_store_without_prior_revenue_excluded(spark):
    end = dt.date(2017, 8, 15)
    train = []
    for s, prior, recent in [(1, 100, 120), (2, 100, 80), (3, 0, 500)]:
        train += [(end - dt.timedelta(days=100), s, "A", prior, 0), (end - dt.timedelta(days=5), s, "A", recent, 0)]
    q = Q.q11_store_risk(layer(spark, make_model(spark, train))).collect()
    assert {r["store_nbr"] for r in q} == {1, 2}
    g = {r["store_nbr"]: r["revenue_growth_pct"] for r in q}
    assert g == {1: 20.0, 2: -20.0}


# ---------------------------------------------------------------- F19 constant oil
def test_f19_constant_oil_correlation_null(spark):
    train = [(f"2016-{m:02d}-04", 1, "A", 100 * m, 0) for m in range(1, 6)]
    oil = [(f"2016-{m:02d}-04", 40) for m in range(1, 6)]
    q = Q.q15_oil_regimes(layer(spark, make_model(spark, train, oil=oil))).collect()
    assert q and all(r["revenue_oil_correlation"] is None for r in q)
    assert sum(r["months_compared"] for r in q[:1]) == 5


def test_oil_correlation_perfect(spark):
    train = [(f"2016-{m:02d}-04", 1, "A", 100 * m, 0) for m in range(1, 6)]
    oil = [(f"2016-{m:02d}-04", 40 + m) for m in range(1, 6)]
    q = Q.q15_oil_regimes(layer(spark, make_model(spark, train, oil=oil))).collect()
    assert all(r["revenue_oil_correlation"] == 1.0 for r in q)
    assert [r["oil_price_quartile"] for r in q] == [1, 2, 3, 4]


# ---------------------------------------------------------------- F21 cluster index bounds
def test_f21_index_bounds(spark):
    train = [("2016-01-01", 1, "X", 24, 0), ("2016-01-01", 1, "Y", 76, 0),
             ("2016-01-01", 3, "X", 16, 0), ("2016-01-01", 3, "Y", 84, 0)]
    q = {(r["cluster"], r["family"]): r for r in Q.q09_cluster_index(layer(spark, make_model(spark, train))).collect()}
    assert (q[(1, "X")]["sales_index"], q[(1, "X")]["cluster_positioning"]) == (1.2, "Over-Indexed")
    assert (q[(2, "X")]["sales_index"], q[(2, "X")]["cluster_positioning"]) == (0.8, "Under-Indexed")
    assert q[(1, "Y")]["cluster_positioning"] == "In-Line"


# ---------------------------------------------------------------- F22, F23 contract and empty calendar
def test_f22_constraints(spark):
    train = [("2016-01-01", 1, "A", 10, 0), ("2016-01-01", 1, "A", 12, 0), ("2016-01-01", 99, "A", 5, 0)]
    L = layer(spark, make_model(spark, train))
    cc = {(r["table_name"], r["rule"]): r["violations"] for r in Q.constraint_report(L).collect()}
    assert cc[("train", "unique(date,store_nbr,family)")] == 1
    assert cc[("train", "store_nbr -> stores.store_nbr")] == 1
    assert cc[("stores", "unique(store_nbr)")] == 0
    assert {r["store_nbr"] for r in L.context.collect()} == {1}


def test_f23_empty_calendar(spark):
    train = [(d, s, "A", 10, 0) for d in DAYS for s in (1, 3)]
    L = layer(spark, make_model(spark, train))
    got = {(r["is_special_day"], r["is_holiday"], r["holiday_scope"], r["event_type_list"],
            r["event_description_list"]) for r in L.context.collect()}
    assert got == {(0, 0, "None", "None", "None")}


# ---------------------------------------------------------------- T11, T4, T10 options
def test_t11_collation_for_locale_names(spark):
    train = [("2016-03-01", s, "A", 100, 0) for s in (1, 2, 3)]
    hol = [("2016-03-01", "Holiday", "Local", "QUITO", "Quito Day", "False")]
    model = make_model(spark, train, holidays=hol)
    binary = build_layer(model, spark, materialise=False)
    assert {r["store_nbr"]: r["is_special_day"] for r in binary.context.collect()} == {1: 0, 2: 0, 3: 0}
    ci = build_layer(model, spark, materialise=False, collation="UNICODE_CI_AI")
    assert {r["store_nbr"]: r["is_special_day"] for r in ci.context.collect()} == {1: 1, 2: 1, 3: 0}
    assert sorted(rows(Q.v4_store_holiday_map(ci), "store_nbr", "description")) == \
        [(1, "Quito Day"), (2, "Quito Day")]
    assert Q.q14_event_lift(ci, min_days=1).first()["affected_store_days"] == 2


def test_t4_baseline_choice(spark):
    # a Transfer day (special, not a holiday) with higher sales sits in the Non-Holiday group
    days = ["2016-03-01", "2016-03-02", "2016-03-03"]
    train = [(d, 1, "A", 200 if d == "2016-03-02" else 100, 0) for d in days]
    hol = [("2016-03-02", "Transfer", "National", "Ecuador", "Moved", "False")]
    L = layer(spark, make_model(spark, train, holidays=hol))
    default = {r["day_group"]: r for r in Q.q13_holiday_lift(L).collect()}
    assert default["Non-Holiday"]["revenue_lift_pct"] == 0.0
    special = {r["day_group"]: r for r in Q.q13_holiday_lift(L, baseline="non_special").collect()}
    assert special["Non-Holiday"]["revenue_lift_pct"] == round(100 * (400 / 3 - 100) / 100, 2)


def test_t10_complete_months_only(spark):
    train = [("2017-07-10", 1, "A", 100, 0), ("2017-07-31", 1, "A", 50, 0), ("2017-08-15", 1, "A", 70, 0)]
    L = layer(spark, make_model(spark, train))
    assert [r["month"] for r in Q.q03_monthly_kpi(L).collect()] == ["2017-07", "2017-08"]
    assert [r["month"] for r in Q.q03_monthly_kpi(L, complete_months_only=True).collect()] == ["2017-07"]
    fam = Q.q06_portfolio_roles(L, complete_months_only=True).first()
    assert fam["total_revenue"] == 150.0


def test_events_reaching_any_store(spark):
    from demandlens.operators.events import applicable_events, applicable_to_any
    hol = spark.createDataFrame(
        [(D("2016-01-01"), "Holiday", "National", "Ecuador", "N", "False"),
         (D("2016-01-02"), "Holiday", "Regional", "Guayas", "R1", "False"),
         (D("2016-01-02"), "Holiday", "Regional", "Azuay", "R2", "False"),
         (D("2016-01-03"), "Holiday", "Local", "Quito", "L1", "False"),
         (D("2016-01-03"), "Holiday", "Local", "Loja", "L2", "False")],
        "date date, type string, locale string, locale_name string, description string, transferred string")
    stores = spark.createDataFrame([(1, "Quito", "Pichincha"), (3, "Guayaquil", "Guayas")],
                                   "store_nbr int, city string, state string")
    got = {r["description"] for r in applicable_to_any(applicable_events(hol), stores).collect()}
    assert got == {"N", "R1", "L1"}
    none = applicable_to_any(applicable_events(hol), stores.limit(0)).count()
    assert none == 0


@pytest.mark.parametrize("with_rows", [False, True])
def test_every_query_runs_on_degenerate_input(spark, with_rows):
    """Empty tables, or a single store-day with no transactions, oil or events: every query
    runs (no division, cast or NULL error) and the aggregates stay well-defined."""
    train = [("2016-01-04", 1, "A", 0, 0)] if with_rows else []
    L = layer(spark, make_model(spark, train))
    for name, q in Q.QUERIES.items():
        rows = q(L).collect()
        if name in ("q01_coverage", "q02_anomaly_flags", "x1_coverage_span"):
            assert len(rows) == 1
    if with_rows:
        assert Q.q13_holiday_lift(L).first()["revenue_lift_pct"] is None    # 0 / 0 baseline
