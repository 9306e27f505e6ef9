"""Grouped measures over the store-day layer or the fact table: the roll-up to the
entity-day grain, period KPIs, the seasonality matrix, store scorecards, conditional
(promotion) uplift and regime bins. All are partial + final hash aggregates; the means are
exact sums over counts (see ``functions.numeric``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_where, exact_mean, flag, pct_of, ratio_mean, rnd, safe_div
from .stats import over_all, pearson, quantile_segment


def entity_day_rollup(fact: DataFrame, keys=("date", "store_nbr"), value: str = "sales",
                      promo: str = "onpromotion") -> DataFrame:
    """Fact grain -> entity-day grain: total_sales (exact), total_items_on_promo,
    promoted_family_count (rows with promo > 0) and family_rows."""
    p = F.coalesce(F.col(promo), F.lit(0))
    return fact.groupBy(*keys).agg(
        F.sum(value).alias("total_sales"),
        F.sum(p).cast("bigint").alias("total_items_on_promo"),
        count_where(p > 0).alias("promoted_family_count"),
        F.count(F.lit(1)).alias("family_rows"))


# Named measures of the store-day layer, computed per group.
def named_measures() -> dict:
    return {
        "revenue": lambda: F.sum("total_sales"),
        "transactions": lambda: F.sum("transactions"),
        "store_days": lambda: F.count(F.lit(1)),
        "avg_store_day_revenue": lambda: exact_mean("total_sales"),
        "avg_transactions": lambda: exact_mean("transactions"),
        "avg_sales_per_transaction": lambda: ratio_mean("sales_per_transaction"),
        "active_stores": lambda: F.count_distinct(F.when(F.col("total_sales") > 0, F.col("store_nbr"))),
        "avg_promo_family_mix_pct": lambda: exact_mean("promo_family_mix_pct"),
        "avg_oil_price": lambda: exact_mean("oil_price"),
        "special_day_revenue": lambda: F.sum(F.when(F.col("is_special_day") == 1, F.col("total_sales"))
                                             .otherwise(F.lit(0))),
        "has_special_day": lambda: F.max("is_special_day"),
    }


def period_kpi(ctx: DataFrame, keys, measures, prefix: str = "") -> DataFrame:
    """Group the store-day layer by ``keys`` and compute the named ``measures`` (unrounded;
    money sums stay exact decimals)."""
    m = named_measures()
    return ctx.groupBy(*keys).agg(*[m[name]().alias(prefix + name) for name in measures])


def seasonality_matrix(ctx: DataFrame, keys=("month_num", "month_name", "weekday_num", "weekday_name"),
                       prefix: str = "") -> DataFrame:
    """Mean store-day revenue, transactions (missing counted as 0) and basket value
    (NULL skipped) per calendar cell."""
    return period_kpi(ctx, keys, ["store_days", "avg_store_day_revenue", "avg_transactions",
                                  "avg_sales_per_transaction"], prefix)


def scorecard(ctx: DataFrame, keys=("store_nbr", "city", "state", "store_type", "cluster"),
              prefix: str = "_") -> DataFrame:
    """Per-store totals and productivity: revenue (exact), mean store-day revenue,
    transactions, sales per transaction (sum over sum), mean promo mix and the share of
    revenue made on special days (all unrounded)."""
    s = period_kpi(ctx, keys, ["revenue", "avg_store_day_revenue", "transactions",
                               "avg_promo_family_mix_pct", "special_day_revenue"], prefix)
    return (s.withColumn(prefix + "sales_per_transaction", safe_div(prefix + "revenue", prefix + "transactions"))
             .withColumn(prefix + "special_day_sales_share_pct",
                         pct_of(prefix + "special_day_revenue", prefix + "revenue")))


def conditional_uplift(fact: DataFrame, key: str, condition: Column, value: str) -> DataFrame:
    """Per ``key``: total, share of rows meeting ``condition`` (percent, rounded to 2 like the
    source), and the mean ``value`` with and without it (NULL when no such rows)."""
    return fact.groupBy(key).agg(
        F.sum(value).alias("_total"),
        rnd(F.lit(100.0) * F.sum(flag(condition)) / F.count(F.lit(1)), 2).alias("promo_row_pct"),
        rnd(exact_mean(F.when(condition, F.col(value))), 2).alias("avg_sales_when_promoted"),
        rnd(exact_mean(F.when(~condition, F.col(value))), 2).alias("avg_sales_without_promo"))


def regime_bins(periods: DataFrame, x: str, y: str, n: int, tie_break: str) -> DataFrame:
    """Bin the periods into ``n`` quantiles of ``x`` (NTILE, ``tie_break`` decides equal x)
    and attach the Pearson correlation of x and y over all periods (_corr) and the number of
    periods (_n). ``periods`` is calendar-sized (one row per month)."""
    allp = over_all()
    return (periods.withColumn("_bin", quantile_segment(n, F.col(x).asc(), F.col(tie_break).asc()))
            .withColumn("_n", F.count(F.lit(1)).over(allp))
            .withColumn("_corr", pearson(x, y, over=allp)))
