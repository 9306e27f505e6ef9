"""The sixteen business queries (Q1-Q16), the headline checks (X1-X5) and stand-alone
operator outputs, composed from the library operators over a materialised ``Layer``.

Output money is rounded exactly (decimal) and handed out as DOUBLE; ratios follow the
numeric contract in ``functions.numeric``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_label, month_start
from ..functions.numeric import (count_where, dbl, exact_mean, money_out, pct_change, ratio_mean, rnd,
                                 safe_div)
from ..operators.aggregates import (named_measures, conditional_uplift, period_kpi, regime_bins,
                                    scorecard, seasonality_matrix)
from ..operators.audit import check_constraints, contradiction_audit, coverage_audit
from ..operators.classify import classify, rank_of
from ..operators.events import (DESCRIPTION_SEPARATOR, MIXED_SCOPE, applicable_to_any,
                                distinct_list, lift_vs_baseline, top_events)
from ..operators.stats import (affinity_index, coefficient_of_variation, concentration,
                               dense_rank_desc, quantile_segments, rank_percentiles, settled,
                               share_of_total, sigma_band, top_n_share, with_dense_ranks_desc,
                               with_share_of_total, zscore_outliers)
from ..operators.temporal import (asof_fill, lag_positional, period_growth, rolling_mean,
                                  same_period_prior_year, trailing_compare, window_bounds)
from .storeday import (ENRICHED_COLUMNS, METRIC_COLUMNS, Layer, oil_prices_filled,
                       store_holiday_map)

# ---------------------------------------------------------------- fixed labels (reference)
PORTFOLIO_ROLES = ["Core Growth Driver", "Stable Cash Generator", "Volatile Growth Bet",
                   "Monitor / Niche"]
PROMO_PROFILES = ["High Dependency / High Response", "High Dependency / Low Response",
                  "Selective Promo Opportunity", "Low Promo Sensitivity"]
POSITIONING = ["Over-Indexed", "Under-Indexed", "In-Line"]
RISK_TIERS = ["High Risk Outlier (All Metrics Down)", "Traffic Risk Outlier",
              "Basket Risk Outlier", "Healthy Above Average", "Watchlist"]
# Order of the risk report: LIKE '%High Risk%', '%Traffic Risk%', '%Basket Risk%', 'Watchlist', rest.
RISK_ORDER = ["High Risk Outlier (All Metrics Down)", "Traffic Risk Outlier",
              "Basket Risk Outlier", "Watchlist"]
ARCHETYPES = ["Scale + Basket Leader", "Traffic-Led Scale Store", "Premium Basket Store",
              "Turnaround Candidate", "Middle Portfolio Store"]
DAY_GROUP_ORDER = ["Non-Holiday", "National Holiday", "Regional Holiday", "Local Holiday"]
NON_HOLIDAY = "Non-Holiday"
MIXED_DAY_GROUP = "Mixed-Scope Holiday"
OUTLIER_TYPES = ["High Revenue Outlier", "Low Revenue Outlier"]
NO_EVENT_CONTEXT = "No mapped event context"
CONCENTRATION_LABELS = ("Store Network", "Product Family Mix")


def _first(df: DataFrame, expr):
    """One scalar to the driver (e.g. the last date), used as a literal so the filter
    reaches the Parquet scan for row-group skipping."""
    return df.agg(expr.alias("v")).first()["v"]


def _money_view(df: DataFrame, cols) -> DataFrame:
    """Hand out exact decimal columns of a view as DOUBLE."""
    decimals = {"total_sales", "oil_price", "promo_family_mix_pct", "oil_price_filled"}
    return df.select([F.col(c).cast("double").alias(c) if c in decimals else F.col(c) for c in cols])


# ---------------------------------------------------------------- views V1-V5 and sources
def v1_store_day_metrics(L: Layer) -> DataFrame:
    return _money_view(L.context, METRIC_COLUMNS)


def v2_oil_prices_filled(L: Layer) -> DataFrame:
    return _money_view(oil_prices_filled(L.model.oil), ["date", "oil_price_filled"])


def v3_store_day_enriched(L: Layer) -> DataFrame:
    return _money_view(L.context, ENRICHED_COLUMNS)


def v4_store_holiday_map(L: Layer) -> DataFrame:
    return store_holiday_map(L.context.select("date", "store_nbr", "state", "city"), L.model.holidays,
                             L.collation)


def v5_store_day_context(L: Layer) -> DataFrame:
    return _money_view(L.context, L.context.columns)


def source_table(name: str):
    def q(L: Layer) -> DataFrame:
        df = L.model.table(name)
        return df.select([F.col(f.name).cast("double").alias(f.name)
                          if f.dataType.typeName() == "decimal" else F.col(f.name)
                          for f in df.schema.fields])
    q.__name__ = f"s_{name}"
    return q


# ---------------------------------------------------------------- section 1: readiness
def q01_coverage(L: Layer) -> DataFrame:
    return coverage_audit(L.context)


def q02_anomaly_flags(L: Layer) -> DataFrame:
    return contradiction_audit(L.context)


# ---------------------------------------------------------------- section 2: KPI & trend
def _through_complete_month(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Rows up to the end of the last complete calendar month (the data may stop mid-month,
    as the source's does: T10)."""
    last = _first(df, F.max(date_col))
    if last is None:
        return df
    end = F.lit(last)
    complete_end = F.when(F.last_day(end) == end, end).otherwise(F.date_sub(F.trunc(end, "MM"), 1))
    return df.filter(F.col(date_col) <= complete_end)


def q03_monthly_kpi(L: Layer, complete_months_only: bool = False) -> DataFrame:
    ctx = _through_complete_month(L.context) if complete_months_only else L.context
    m = period_kpi(ctx, ["month_start"],
                   ["revenue", "transactions", "avg_store_day_revenue", "active_stores",
                    "avg_promo_family_mix_pct"], prefix="_")
    m = m.withColumns({"_mom": pct_change(F.col("_revenue"), lag_positional("_revenue", "month_start", 1)),
                       "_yoy": pct_change(F.col("_revenue"), lag_positional("_revenue", "month_start", 12))})
    # positional lags (T8); period_growth(mode="calendar") is the calendar variant
    return (m.select(
        month_label("month_start").alias("month"),
        money_out("_revenue").alias("revenue"),
        F.col("_transactions").alias("transactions"),
        rnd(safe_div("_revenue", "_transactions"), 2).alias("avg_basket_value"),
        rnd("_avg_store_day_revenue", 2).alias("avg_store_day_revenue"),
        F.col("_active_stores").alias("active_stores"),
        rnd("_avg_promo_family_mix_pct", 2).alias("avg_promo_family_mix_pct"),
        rnd(rolling_mean("_revenue", "month_start", 3), 2).alias("rolling_3m_revenue"),
        rnd("_mom", 2).alias("mom_growth_pct"),
        rnd("_yoy", 2).alias("yoy_growth_pct"))
        .orderBy("month"))


def _same_store(L: Layer, require_active: str | None) -> DataFrame:
    monthly_store = period_kpi(L.context, ["month_start", "store_nbr"], ["revenue", "transactions"])
    pairs = same_period_prior_year(monthly_store, "store_nbr", "month_start",
                                   ["revenue", "transactions"], require_active=require_active)
    c = pairs.groupBy("month_start").agg(
        F.count(F.lit(1)).alias("comparable_stores"),
        F.sum("cur_revenue").alias("_cr"), F.sum("prev_revenue").alias("_pr"),
        F.sum("cur_transactions").alias("_ct"), F.sum("prev_transactions").alias("_pt"))
    return (c.select(
        month_label("month_start").alias("month"),
        "comparable_stores",
        money_out("_cr").alias("current_revenue"),
        money_out("_pr").alias("prior_year_revenue"),
        rnd(pct_change("_cr", "_pr"), 2).alias("same_store_sales_growth_pct"),
        rnd(pct_change("_ct", "_pt"), 2).alias("same_store_transaction_growth_pct"),
        rnd(pct_change(safe_div("_cr", "_ct"), safe_div("_pr", "_pt")), 2)
         .alias("same_store_basket_growth_pct"))
        .orderBy("month"))


def q04_same_store_growth(L: Layer) -> DataFrame:
    return _same_store(L, None)


def q04_same_store_growth_active(L: Layer) -> DataFrame:
    """Variant: a store is comparable only when it had revenue > 0 in both months."""
    return _same_store(L, "revenue")


def q05_seasonality(L: Layer) -> DataFrame:
    g = seasonality_matrix(L.context, prefix="_")
    return (g.orderBy("month_num", "weekday_num")
            .select("month_num", "month_name",
                    (F.col("weekday_num") + 1).alias("weekday_order_monday_start"),
                    "weekday_name",
                    rnd("_avg_store_day_revenue", 2).alias("avg_store_day_revenue"),
                    rnd("_avg_transactions", 2).alias("avg_transactions"),
                    rnd("_avg_sales_per_transaction", 2).alias("avg_sales_per_transaction")))


# ---------------------------------------------------------------- section 3: portfolio
def q06_portfolio_roles(L: Layer, recent_months: int = 6, complete_months_only: bool = False) -> DataFrame:
    train = _through_complete_month(L.train) if complete_months_only else L.train
    fm = train.groupBy(month_start("date").alias("month_start"), "family").agg(
        F.sum("sales").alias("monthly_revenue"))
    # latest month: a scalar; the layer knows the facts' last date unless they are cut
    last = train.agg(F.max("date")).scalar()
    fm = fm.withColumn("_max", F.trunc(last, "MM"))
    recent, prior = trailing_compare("monthly_revenue", "month_start", F.col("_max"),
                                     recent_months, "month")
    fam = fm.groupBy("family").agg(
        F.sum("monthly_revenue").alias("_total"),
        rnd(coefficient_of_variation("monthly_revenue"), 3).alias("revenue_cv"),
        recent.alias("_recent"), prior.alias("_prior"))
    fam = fam.withColumn("recent_6m_growth_pct", rnd(pct_change("_recent", "_prior"), 2))
    fam = settled(fam)
    fam = with_share_of_total(fam, "_total", "_share")
    fam = rank_percentiles(fam, {"_rev_pr": "_total", "_cv_pr": "revenue_cv",
                                 "_g_pr": "recent_6m_growth_pct"})   # rounded inputs (T7)
    rp, cp, gp = F.col("_rev_pr"), F.col("_cv_pr"), F.col("_g_pr")
    role = classify([((rp >= 0.80) & (cp <= 0.50) & (gp >= 0.80), PORTFOLIO_ROLES[0]),
                     ((rp >= 0.80) & (cp <= 0.30), PORTFOLIO_ROLES[1]),
                     ((cp >= 0.80) & (gp >= 0.80), PORTFOLIO_ROLES[2])], PORTFOLIO_ROLES[3])
    return (fam.select("family", money_out("_total").alias("total_revenue"),
                       rnd("_share", 2).alias("revenue_share_pct"),
                       "revenue_cv", "recent_6m_growth_pct", role.alias("portfolio_role"))
            .orderBy(F.col("revenue_share_pct").desc(), F.col("recent_6m_growth_pct").desc(), "family"))


def q07_promo_dependency(L: Layer, threshold: float = 25.0) -> DataFrame:
    promoted = F.coalesce(F.col("onpromotion"), F.lit(0)) > 0
    fp = conditional_uplift(L.train, "family", promoted, "sales")
    uplift = pct_change("avg_sales_when_promoted", "avg_sales_without_promo")   # of rounded means
    dep = F.col("promo_row_pct") >= threshold
    resp = uplift >= threshold
    profile = classify([(dep & resp, PROMO_PROFILES[0]), (dep, PROMO_PROFILES[1]),
                        (resp, PROMO_PROFILES[2])], PROMO_PROFILES[3])
    return (fp.select("family", money_out("_total").alias("total_revenue"), "promo_row_pct",
                      "avg_sales_when_promoted", "avg_sales_without_promo",
                      rnd(uplift, 2).alias("promo_uplift_pct"), profile.alias("promo_profile"),
                      F.col("_total"))
            .orderBy(F.col("promo_uplift_pct").desc(), F.col("_total").desc(), "family")
            .drop("_total"))


def _store_family_revenue(L: Layer) -> DataFrame:
    """(store, family) revenue: the one pass over the fact table that the store-level and
    family-level totals both re-aggregate (the shared exchange is reused)."""
    return L.train.groupBy("store_nbr", "family").agg(F.sum("sales").alias("revenue"))


def _store_revenue(L: Layer) -> DataFrame:
    return _store_family_revenue(L).groupBy("store_nbr").agg(F.sum("revenue").alias("revenue"))


def _family_revenue(L: Layer) -> DataFrame:
    return _store_family_revenue(L).groupBy("family").agg(F.sum("revenue").alias("revenue"))


def q08_concentration(L: Layer, top_frac: float = 0.20) -> DataFrame:
    # both entity tables come from one pass over the facts and are written once, as one table
    key = F.explode(F.array(*[F.struct(F.lit(label).alias("kind"), F.col(c).cast("string").alias("key"))
                              for label, c in zip(CONCENTRATION_LABELS, ("store_nbr", "family"))]))
    entities = settled(_store_family_revenue(L).select(key.alias("e"), "revenue")
                       .groupBy("e.kind", "e.key").agg(F.sum("revenue").alias("revenue")))
    stores, families = (concentration(entities.filter(F.col("kind") == label), "revenue", label, "key", top_frac)
                        for label in CONCENTRATION_LABELS)
    return (stores.unionByName(families)
            .orderBy(rank_of(F.col("entity_type"), list(CONCENTRATION_LABELS))))


def q09_cluster_index(L: Layer, over: float = 1.20, under: float = 0.80) -> DataFrame:
    # One pass over the fact table: the (store, family) aggregate feeds both branches and
    # its exchange is reused. The store join is null-safe so the optimizer infers no extra
    # IsNotNull filter on one branch only (store keys are NOT NULL by contract), which would
    # make the two aggregates differ and read the fact table twice.
    sf = _store_family_revenue(L)
    st = L.stores.select(F.col("store_nbr").alias("_st"), "cluster")
    cf = (sf.join(st, sf["store_nbr"].eqNullSafe(st["_st"]))
          .groupBy("cluster", "family").agg(F.sum("revenue").alias("revenue"))
          .withColumn("_cs", share_of_total("revenue", ["cluster"])))
    ns = with_share_of_total(sf.groupBy("family").agg(F.sum("revenue").alias("_fam_total")),
                             "_fam_total", "_ns")
    j = cf.join(ns, "family")
    idx = affinity_index(F.col("_cs"), F.col("_ns"))
    pos = classify([(idx >= over, POSITIONING[0]), (idx <= under, POSITIONING[1])], POSITIONING[2])
    return (j.select("cluster", "family", rnd("_cs", 2).alias("cluster_share_pct"),
                     rnd("_ns", 2).alias("network_share_pct"),
                     rnd(idx, 2).alias("sales_index"), pos.alias("cluster_positioning"))
            .orderBy("cluster", F.col("sales_index").desc(), "family"))


# ---------------------------------------------------------------- section 4: stores
def q10_store_scorecard(L: Layer) -> DataFrame:
    s = settled(scorecard(L.context))
    s = with_dense_ranks_desc(s, {"revenue_rank": "_revenue", "basket_rank": "_sales_per_transaction"})   # unrounded
    return (s.select(
        "store_nbr", "city", "state", "store_type", "cluster",
        money_out("_revenue").alias("total_revenue"),
        rnd("_avg_store_day_revenue", 2).alias("avg_store_day_revenue"),
        F.col("_transactions").alias("total_transactions"),
        rnd("_sales_per_transaction", 2).alias("sales_per_transaction"),
        rnd("_avg_promo_family_mix_pct", 2).alias("avg_promo_family_mix_pct"),
        rnd("_special_day_sales_share_pct", 2).alias("special_day_sales_share_pct"),
        "revenue_rank", "basket_rank")
        .orderBy("revenue_rank", "basket_rank", "store_nbr"))


def q11_store_risk(L: Layer, days: int = 90, k: float = 1.0) -> DataFrame:
    c = L.context
    last = F.lit(L.last_date())            # a literal, so the window filter reaches the scan
    _, _, plo, _ = window_bounds(last, days, "day")
    # Only the two windows matter: a store without prior-window revenue is dropped anyway.
    # The month bound is implied by the date bound; it lets a month-partitioned layer skip
    # whole folders.
    win = c.filter((F.col("date") >= plo) & (F.col("month_start") >= F.trunc(plo, "MM")))
    r_rev, p_rev = trailing_compare("total_sales", "date", last, days)
    r_tx, p_tx = trailing_compare("transactions", "date", last, days)
    r_spt, p_spt = trailing_compare("sales_per_transaction", "date", last, days, how="mean")
    sw = win.groupBy("store_nbr").agg(
        F.max("city").alias("city"), F.max("state").alias("state"),
        r_rev.alias("_r_rev"), p_rev.alias("_p_rev"), r_tx.alias("_r_tx"), p_tx.alias("_p_tx"),
        r_spt.alias("_r_spt"), p_spt.alias("_p_spt"))
    sg = sw.filter(F.col("_p_rev") > 0).withColumns({
        "revenue_growth_pct": rnd(pct_change("_r_rev", "_p_rev"), 2),
        "transaction_growth_pct": rnd(pct_change("_r_tx", "_p_tx"), 2),
        "basket_growth_pct": rnd(pct_change("_r_spt", "_p_spt"), 2)})
    cols = ["revenue_growth_pct", "transaction_growth_pct", "basket_growth_pct"]
    # network mean and mean - k*sd of the rounded growths (T7), over stores
    b = sigma_band(sg, cols, k)
    rev_lo, tx_lo, bk_lo = [F.col(c) < F.col("_lo_" + c) for c in cols]
    healthy = ((F.col("revenue_growth_pct") >= F.col("_avg_revenue_growth_pct"))
               & (F.col("transaction_growth_pct") >= F.col("_avg_transaction_growth_pct")))
    tier = classify([(rev_lo & tx_lo & bk_lo, RISK_TIERS[0]), (rev_lo & tx_lo, RISK_TIERS[1]),
                     (rev_lo & bk_lo, RISK_TIERS[2]), (healthy, RISK_TIERS[3])], RISK_TIERS[4])
    out = b.select("store_nbr", "city", "state",
                   dbl("_r_rev").alias("recent_90d_revenue"), dbl("_p_rev").alias("prior_90d_revenue"),
                   *cols, tier.alias("risk_tier"))
    return out.orderBy(rank_of(F.col("risk_tier"), RISK_ORDER), "revenue_growth_pct", "store_nbr")


def q12_store_archetypes(L: Layer) -> DataFrame:
    s = period_kpi(L.context, ["store_nbr", "city", "state", "cluster"], ["revenue", "transactions"],
                   prefix="_")
    s = settled(s.withColumn("_spt", safe_div("_revenue", "_transactions")))
    s = quantile_segments(s, 4, {"revenue_quartile": ("_revenue", True),
                                 "basket_quartile": ("_spt", True)}, "store_nbr")
    r, b = F.col("revenue_quartile"), F.col("basket_quartile")
    arche = classify([((r == 1) & (b == 1), ARCHETYPES[0]), ((r == 1) & (b >= 2), ARCHETYPES[1]),
                      (r.isin(2, 3) & (b == 1), ARCHETYPES[2]), ((r == 4) & (b == 4), ARCHETYPES[3])],
                     ARCHETYPES[4])
    return (s.select("store_nbr", "city", "state", "cluster",
                     money_out("_revenue").alias("total_revenue"),
                     rnd("_spt", 2).alias("sales_per_transaction"),
                     "revenue_quartile", "basket_quartile", arche.alias("store_archetype"), "_revenue")
            .orderBy("revenue_quartile", "basket_quartile", F.col("_revenue").desc(), "store_nbr")
            .drop("_revenue"))


# ---------------------------------------------------------------- section 5: calendar & macro
DAY_MEANS = ["avg_store_day_revenue", "avg_transactions", "avg_sales_per_transaction"]


def _lift_cols():
    return [
        rnd(pct_change("_avg_store_day_revenue", "_base__avg_store_day_revenue"), 2).alias("revenue_lift_pct"),
        rnd(pct_change("_avg_transactions", "_base__avg_transactions"), 2).alias("transaction_lift_pct"),
        rnd(pct_change("_avg_sales_per_transaction", "_base__avg_sales_per_transaction"), 2)
         .alias("basket_lift_pct")]


def _scalar_baseline(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Attach the day means of ``rows`` (one global aggregate, a scalar subquery) as the
    _base__* columns of ``df``."""
    b = period_kpi(rows, [], DAY_MEANS).select(F.struct(*DAY_MEANS).alias("b")).scalar()
    return df.withColumns({"_base__" + m: b.getField(m) for m in DAY_MEANS})


def q13_holiday_lift(L: Layer, baseline: str = "non_holiday") -> DataFrame:
    """Lift of each day group over a baseline: ``non_holiday`` (default, as the source: the
    'Non-Holiday' group, which still holds Transfer/Bridge/Additional/Event days) or
    ``non_special`` (store-days with no applicable event at all, as the event ranking uses)."""
    group = (F.when(F.col("is_holiday") == 0, F.lit(NON_HOLIDAY))
             .when(F.col("holiday_scope") == MIXED_SCOPE, F.lit(MIXED_DAY_GROUP))
             .otherwise(F.concat(F.col("holiday_scope"), F.lit(" Holiday"))))
    g = period_kpi(L.context.withColumn("day_group", group), ["day_group"],
                   ["store_days"] + DAY_MEANS, prefix="_")
    if baseline == "non_holiday":
        lifted = lift_vs_baseline(g, F.col("day_group") == NON_HOLIDAY, ["_" + m for m in DAY_MEANS])
    elif baseline == "non_special":
        lifted = _scalar_baseline(g, L.context.filter(F.col("is_special_day") == 0))
    else:
        raise ValueError(baseline)
    return (lifted.select(
        "day_group", F.col("_store_days").alias("store_days"),
        rnd("_avg_store_day_revenue", 2).alias("avg_store_day_revenue"),
        rnd("_avg_transactions", 2).alias("avg_transactions"),
        rnd("_avg_sales_per_transaction", 2).alias("avg_sales_per_transaction"),
        rnd(F.col("_avg_store_day_revenue") - F.col("_base__avg_store_day_revenue"), 2)
         .alias("revenue_delta_vs_non_holiday"),
        *_lift_cols())
        .orderBy(rank_of(F.col("day_group"), DAY_GROUP_ORDER)))


def q14_event_lift(L: Layer, min_days: int = 20, k: int = 25) -> DataFrame:
    c = L.context
    targets = c.select("date", "store_nbr", "state", "city", "total_sales", "transactions",
                       "sales_per_transaction")
    means = named_measures()
    ep = top_events(L.events, targets, [means[m]().alias("_" + m) for m in DAY_MEANS], min_days,
                    collation=L.collation)
    # Baseline over ordinary store-days: one global aggregate, used as a scalar subquery.
    ep = _scalar_baseline(ep, c.filter(F.col("is_special_day") == 0))
    out = ep.select("holiday_scope", "event_type", "description", "affected_store_days",
                    rnd("_avg_store_day_revenue", 2).alias("avg_store_day_revenue"), *_lift_cols())
    return (out.orderBy(F.col("revenue_lift_pct").desc(), F.col("affected_store_days").desc(),
                        "holiday_scope", "event_type", "description")
            .limit(k))                                      # top-k report: the limit is the feature


def q15_oil_regimes(L: Layer, n: int = 4) -> DataFrame:
    mm = (period_kpi(L.context, ["month_start"], ["revenue", "transactions", "avg_oil_price"], prefix="_")
          .filter(F.col("_avg_oil_price").isNotNull()))
    r = regime_bins(mm, "_avg_oil_price", "_revenue", n, "month_start")
    return (r.groupBy(F.col("_bin").alias("oil_price_quartile")).agg(
        rnd(F.min("_avg_oil_price"), 2).alias("min_avg_oil_price"),
        rnd(F.max("_avg_oil_price"), 2).alias("max_avg_oil_price"),
        rnd(exact_mean("_revenue"), 2).alias("avg_monthly_revenue"),
        rnd(ratio_mean(safe_div("_revenue", "_transactions")), 2).alias("avg_basket_value"),
        F.max("_n").alias("months_compared"),
        rnd(F.max("_corr"), 4).alias("revenue_oil_correlation"))
        .orderBy("oil_price_quartile"))


def q16_network_anomalies(L: Layer, threshold: float = 2.0) -> DataFrame:
    dn = period_kpi(L.context, ["date"], ["revenue", "transactions", "avg_promo_family_mix_pct",
                                          "has_special_day"], prefix="_")
    scored = zscore_outliers(dn, "_revenue", threshold, out="_z")   # dates: calendar-sized
    ctx_events = (applicable_to_any(L.events, L.stores, collation=L.collation).groupBy("date")
                  .agg(distinct_list(F.col("description"), DESCRIPTION_SEPARATOR).alias("_ctx")))
    j = scored.join(ctx_events, "date", "left")
    z = F.col("_z")
    return (j.select(
        "date", money_out("_revenue").alias("network_revenue"),
        F.col("_transactions").alias("network_transactions"),
        rnd(safe_div("_revenue", "_transactions"), 2).alias("basket_value"),
        rnd("_avg_promo_family_mix_pct", 2).alias("avg_promo_family_mix_pct"),
        rnd(z, 2).alias("z_score"),
        F.when(z >= threshold, F.lit(OUTLIER_TYPES[0])).otherwise(F.lit(OUTLIER_TYPES[1])).alias("outlier_type"),
        F.col("_has_special_day").alias("has_special_day"),
        F.coalesce(F.col("_ctx"), F.lit(NO_EVENT_CONTEXT)).alias("event_context"), "_z")
        .orderBy(F.abs(F.col("_z")).desc(), "date")
        .drop("_z"))


# ---------------------------------------------------------------- headline checks X1-X5
def x1_coverage_span(L: Layer) -> DataFrame:
    # distinct counts over the (store, family) aggregate: no fact row is expanded
    sf = L.train.groupBy("store_nbr", "family").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("fact_rows"))
    return sf.agg(
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"),
        F.count_distinct("store_nbr").alias("stores"), F.count_distinct("family").alias("families"),
        F.coalesce(F.sum("fact_rows"), F.lit(0)).alias("fact_rows"))


def x2_top_n_share(L: Layer, top_families: int = 5, top_stores: int = 10) -> DataFrame:
    s = top_n_share(_store_revenue(L), "revenue", top_stores, "store_nbr").select(
        F.lit(CONCENTRATION_LABELS[0]).alias("entity_type"), "*")
    f = top_n_share(_family_revenue(L), "revenue", top_families, "family").select(
        F.lit(CONCENTRATION_LABELS[1]).alias("entity_type"), "*")
    return s.unionByName(f).orderBy(rank_of(F.col("entity_type"), list(CONCENTRATION_LABELS)))


def x3_comparable_ytd(L: Layer) -> DataFrame:
    """Year-to-date revenue of the last year against the same span a year earlier, over
    stores trading in both spans."""
    c = L.context
    last = L.last_date()
    end = F.lit(last)
    y = F.year(end)
    cur_lo, prev_lo, prev_hi = F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y - 1, F.lit(1), F.lit(1)), F.add_months(end, -12)
    in_cur = F.col("date").between(cur_lo, end)
    in_prev = F.col("date").between(prev_lo, prev_hi)
    per_store = (c.filter((F.col("date") >= prev_lo) & (F.col("month_start") >= prev_lo))
                 .groupBy("store_nbr").agg(
                     F.sum(F.when(in_cur, F.col("total_sales"))).alias("_cur"),
                     F.sum(F.when(in_prev, F.col("total_sales"))).alias("_prev"),
                     count_where(in_cur).alias("_n_cur"), count_where(in_prev).alias("_n_prev"))
                 .filter((F.col("_n_cur") > 0) & (F.col("_n_prev") > 0)))
    return per_store.agg(
        F.year(F.lit(last)).alias("current_year"), F.lit(last).alias("through_date"),
        F.count(F.lit(1)).alias("comparable_stores"),
        money_out(F.sum("_cur")).alias("current_ytd_revenue"),
        money_out(F.sum("_prev")).alias("prior_ytd_revenue"),
        rnd(pct_change(F.sum("_cur"), F.sum("_prev")), 2).alias("ytd_growth_pct"))


def x4_holiday_vs_non_holiday(L: Layer) -> DataFrame:
    group = F.when(F.col("is_holiday") == 1, F.lit("Holiday")).otherwise(F.lit(NON_HOLIDAY))
    g = period_kpi(L.context.withColumn("day_group", group), ["day_group"],
                   ["store_days"] + DAY_MEANS, prefix="_")
    lifted = lift_vs_baseline(g, F.col("day_group") == NON_HOLIDAY, ["_" + m for m in DAY_MEANS])
    return (lifted.select("day_group", F.col("_store_days").alias("store_days"),
                          rnd("_avg_store_day_revenue", 2).alias("avg_store_day_revenue"), *_lift_cols())
            .orderBy(F.col("day_group").desc()))


def x5_weekday_strength(L: Layer) -> DataFrame:
    g = seasonality_matrix(L.context, ("weekday_num", "weekday_name"), prefix="_")
    avg = F.col("_avg_store_day_revenue")
    strongest = F.rank().over(Window.orderBy(avg.desc())) == 1       # 7 rows
    weakest = F.rank().over(Window.orderBy(avg.asc())) == 1
    role = classify([(strongest, "Strongest"), (weakest, "Weakest")], "Middle")
    return (g.select("weekday_num", "weekday_name", F.col("_store_days").alias("store_days"),
                     rnd(avg, 2).alias("avg_store_day_revenue"),
                     dense_rank_desc("_avg_store_day_revenue").alias("strength_rank"),
                     role.alias("weekday_role"))
            .orderBy("weekday_num"))


# ---------------------------------------------------------------- stand-alone operators
def asof_oil_fill(L: Layer) -> DataFrame:
    """Oil price as of every calendar day of the store-day layer (weekends included)."""
    spine = L.context.select("date").distinct()
    filled = asof_fill(L.model.oil.select("date", "dcoilwtico"), spine, "date", "dcoilwtico",
                       out="oil_price_asof")
    return filled.select("date", dbl("oil_price_asof").alias("oil_price_asof"))


def monthly_growth_calendar(L: Layer) -> DataFrame:
    """Monthly revenue with growth against the calendar month 1 and 12 months earlier (NULL
    when that month is absent), instead of the positional previous rows."""
    m = period_kpi(L.context, ["month_start"], ["revenue"], prefix="_")
    g = period_growth(m, "_revenue", "month_start", 1, "_mom", mode="calendar")
    g = g.join(period_growth(m, "_revenue", "month_start", 12, "_yoy", mode="calendar")
               .select(F.col("month_start").alias("_ms"), "_yoy"),
               g["month_start"].eqNullSafe(F.col("_ms"))).drop("_ms")
    return (g.select(month_label("month_start").alias("month"), money_out("_revenue").alias("revenue"),
                     rnd("_mom", 2).alias("mom_growth_pct"), rnd("_yoy", 2).alias("yoy_growth_pct"))
            .orderBy("month"))


def constraint_report(L: Layer) -> DataFrame:
    return check_constraints(L.model)


QUERIES = {
    "s_stores": source_table("stores"),
    "s_train": source_table("train"),
    "s_transactions": source_table("transactions"),
    "s_holidays_events": source_table("holidays_events"),
    "s_oil": source_table("oil"),
    "v1_store_day_metrics": v1_store_day_metrics,
    "v2_oil_prices_filled": v2_oil_prices_filled,
    "v3_store_day_enriched": v3_store_day_enriched,
    "v4_store_holiday_map": v4_store_holiday_map,
    "v5_store_day_context": v5_store_day_context,
    "q01_coverage": q01_coverage,
    "q02_anomaly_flags": q02_anomaly_flags,
    "q03_monthly_kpi": q03_monthly_kpi,
    "q04_same_store_growth": q04_same_store_growth,
    "q05_seasonality": q05_seasonality,
    "q06_portfolio_roles": q06_portfolio_roles,
    "q07_promo_dependency": q07_promo_dependency,
    "q08_concentration": q08_concentration,
    "q09_cluster_index": q09_cluster_index,
    "q10_store_scorecard": q10_store_scorecard,
    "q11_store_risk": q11_store_risk,
    "q12_store_archetypes": q12_store_archetypes,
    "q13_holiday_lift": q13_holiday_lift,
    "q14_event_lift": q14_event_lift,
    "q15_oil_regimes": q15_oil_regimes,
    "q16_network_anomalies": q16_network_anomalies,
    "x1_coverage_span": x1_coverage_span,
    "x2_top_n_share": x2_top_n_share,
    "x3_comparable_ytd": x3_comparable_ytd,
    "x4_holiday_vs_non_holiday": x4_holiday_vs_non_holiday,
    "x5_weekday_strength": x5_weekday_strength,
    "asof_oil_fill": asof_oil_fill,
    "monthly_growth_calendar": monthly_growth_calendar,
    "q04_same_store_growth_active": q04_same_store_growth_active,
    "check_constraints": constraint_report,
}
