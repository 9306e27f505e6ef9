"""DuckDB twins of every registered query, for the side-by-side correctness gate.

Each SQL string starts with the binding of the retail model onto the driver's tables (the
derivation fixed in FIXTURES.md) and the analytical layer, formulated independently of the
Spark plans: the oil fill is an ASOF join onto the last known price, the event map is one
join under the three scope rules, the event collapse uses list functions, baselines come
from windows or scalar subqueries. The numeric contract is the one of the library:

* sums stay exact decimals; ratios are DOUBLE, computed in the same order (``PCT``, ``DIV``,
  ``MEAN``);
* ``R`` rounds a DOUBLE by snapping it to DECIMAL(38,6) and rounding half away from zero
  in decimal, as ``functions.numeric.rnd`` does;
* orders that may meet NULLs say NULLS FIRST / LAST explicitly.

Fixed values: the label texts, event types, scope names, separators and thresholds that
appear inside these SQL strings are the fixed values declared together in
``plans/queries.py`` (labels) and ``operators/events.py`` (calendar rules); the binding's
calendar rows are the fixed values of ``sources/tpch.py``.
"""

from __future__ import annotations


def R(expr: str, n: int = 2) -> str:
    """Round a DOUBLE expression: snap to 6 decimals, then round in decimal."""
    return f"CAST(ROUND(CAST(({expr}) AS DECIMAL(38,6)), {n}) AS DOUBLE)"


def D(expr: str) -> str:
    return f"CAST(({expr}) AS DOUBLE)"


def PCT(cur: str, prev: str) -> str:
    """100 * (cur - prev) / prev, unrounded; the difference is exact before it is DOUBLE."""
    return f"CAST(100 AS DOUBLE) * CAST(({cur}) - ({prev}) AS DOUBLE) / NULLIF(CAST(({prev}) AS DOUBLE), 0)"


def MEAN(expr: str, where: str = "") -> str:
    """Exact sum over non-NULL count, as DOUBLE (optionally over the rows meeting ``where``)."""
    f = f" FILTER (WHERE {where})" if where else ""
    return f"CAST(sum({expr}){f} AS DOUBLE) / NULLIF(count({expr}){f}, 0)"


def DIV(a: str, b: str) -> str:
    return f"CAST(({a}) AS DOUBLE) / NULLIF(CAST(({b}) AS DOUBLE), 0)"


def MONEY(expr: str) -> str:
    return f"CAST(round({expr}, 2) AS DOUBLE)"


BINDING = """
stores AS (
  SELECT s_suppkey AS store_nbr, n_name AS city, r_name AS state,
         chr(CAST(65 + s_suppkey % 5 AS INT)) AS type, CAST(s_suppkey % 17 + 1 AS INT) AS cluster
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
train AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS store_nbr, p_brand AS family,
         CAST(SUM(CASE WHEN l_returnflag = 'R' THEN CAST(0 AS DECIMAL(14,4))
                       ELSE CAST(l_extendedprice AS DECIMAL(14,4)) END) AS DECIMAL(14,4)) AS sales,
         CAST(SUM(CASE WHEN l_discount >= 0.07 THEN 1 ELSE 0 END) AS INT) AS onpromotion
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY CAST(l_shipdate AS DATE), l_suppkey, p_brand),
transactions AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS store_nbr,
         CAST(COUNT(DISTINCT l_orderkey) AS INT) AS transactions
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE o_orderstatus <> 'P'
  GROUP BY CAST(l_shipdate AS DATE), l_suppkey),
oil AS (
  SELECT d AS date,
         CASE WHEN day(d) = 15 THEN NULL
              ELSE CAST(ROUND(CAST(SUM(p) AS DOUBLE) / COUNT(*) / 4000, 4) AS DECIMAL(12,4)) END AS dcoilwtico
  FROM (SELECT CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(14,4)) AS p FROM orders) o
  WHERE isodow(d) <= 5
  GROUP BY d),
yrs AS (SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS y FROM lineitem),
fixed_days(m, dd, ty, de, tr) AS (VALUES
  (1, 1, 'Holiday', 'New Year', 'False'), (5, 1, 'Holiday', 'Labour Day', 'False'),
  (12, 25, 'Holiday', 'Christmas', 'False'), (12, 26, 'Bridge', 'Christmas bridge', 'False'),
  (11, 24, 'Event', 'Black Friday', 'False'), (1, 8, 'Work Day', 'Make-up day', 'False'),
  (8, 10, 'Holiday', 'Independence Day', 'True'),
  (8, 11, 'Transfer', 'Independence Day (observed)', 'False')),
holidays_events AS (
  SELECT make_date(y, m, dd) AS date, ty AS type, 'National' AS locale, 'Everywhere' AS locale_name,
         de AS description, tr AS transferred FROM yrs CROSS JOIN fixed_days
  UNION ALL
  SELECT make_date(y, 2 + r_regionkey, 15), 'Holiday', 'Regional', r_name, 'Founding of ' || r_name, 'False'
  FROM yrs CROSS JOIN region
  UNION ALL
  SELECT make_date(y, 1 + n_nationkey % 12, 1 + n_nationkey % 25), 'Holiday', 'Local', n_name,
         'Foundation of ' || n_name, 'False' FROM yrs CROSS JOIN nation
  UNION ALL
  SELECT make_date(y, 5, 1), 'Event', 'Local', n_name, 'Parade in ' || n_name, 'False'
  FROM yrs CROSS JOIN nation WHERE n_nationkey % 5 = 0)"""


LAYER = """
sd_metrics AS (
  SELECT d.date,
         CAST(date_trunc('month', d.date) AS DATE) AS month_start,
         CAST(year(d.date) AS INTEGER) AS year_num,
         CAST(month(d.date) AS INTEGER) AS month_num,
         monthname(d.date) AS month_name,
         CAST(isodow(d.date) - 1 AS INTEGER) AS weekday_num,
         dayname(d.date) AS weekday_name,
         CAST(isodow(d.date) >= 6 AS INTEGER) AS is_weekend,
         d.store_nbr, s.city, s.state, s.type AS store_type, s.cluster,
         d.total_sales, d.total_items_on_promo, d.promoted_family_count, d.family_rows
  FROM (SELECT date, store_nbr, sum(sales) AS total_sales,
               CAST(sum(COALESCE(onpromotion, 0)) AS BIGINT) AS total_items_on_promo,
               count(*) FILTER (WHERE COALESCE(onpromotion, 0) > 0) AS promoted_family_count,
               count(*) AS family_rows
        FROM train GROUP BY date, store_nbr) d
  JOIN stores s ON s.store_nbr = d.store_nbr),
oil_filled AS (
  SELECT o.date, k.price AS oil_price_filled
  FROM oil o
  ASOF LEFT JOIN (SELECT date AS known, dcoilwtico AS price FROM oil WHERE dcoilwtico IS NOT NULL) k
    ON o.date >= k.known),
sd_enriched AS (
  SELECT m.*,
         COALESCE(t.transactions, 0) AS transactions,
         CAST(t.transactions IS NULL AS INTEGER) AS missing_transactions_flag,
         f.oil_price_filled AS oil_price,
         CAST(f.oil_price_filled IS NULL AS INTEGER) AS missing_oil_flag,
         CAST(CAST((20000 * m.promoted_family_count + m.family_rows) // NULLIF(2 * m.family_rows, 0) AS DOUBLE) / 100
              AS DECIMAL(5,2)) AS promo_family_mix_pct,
         CASE WHEN t.transactions > 0 THEN CAST(m.total_sales AS DOUBLE) / t.transactions END
           AS sales_per_transaction
  FROM sd_metrics m
  LEFT JOIN transactions t ON t.date = m.date AND t.store_nbr = m.store_nbr
  LEFT JOIN oil_filled f ON f.date = m.date),
live_events AS (
  SELECT * FROM holidays_events
  WHERE type IN ('Holiday', 'Additional', 'Bridge', 'Event', 'Transfer')
    AND lower(COALESCE(transferred, 'false')) <> 'true'),
event_map AS (
  SELECT e.date, s.store_nbr, e.locale AS holiday_scope, e.type AS event_type, e.description
  FROM live_events e JOIN stores s
    ON e.locale = 'National'
    OR (e.locale = 'Regional' AND s.state = e.locale_name)
    OR (e.locale = 'Local' AND s.city = e.locale_name)),
event_digest AS (
  SELECT date, store_nbr,
         CAST(bool_or(event_type = 'Holiday') AS INTEGER) AS is_holiday,
         CASE WHEN min(holiday_scope) = max(holiday_scope) THEN min(holiday_scope) ELSE 'Mixed' END AS holiday_scope,
         array_to_string(list_sort(list_distinct(list(event_type))), ', ') AS event_type_list,
         array_to_string(list_sort(list_distinct(list(description))), ' | ') AS event_description_list
  FROM event_map GROUP BY date, store_nbr),
sd_ctx AS (
  SELECT e.*,
         CAST(g.date IS NOT NULL AS INTEGER) AS is_special_day,
         COALESCE(g.is_holiday, 0) AS is_holiday,
         COALESCE(g.holiday_scope, 'None') AS holiday_scope,
         COALESCE(g.event_type_list, 'None') AS event_type_list,
         COALESCE(g.event_description_list, 'None') AS event_description_list
  FROM sd_enriched e LEFT JOIN event_digest g ON g.date = e.date AND g.store_nbr = e.store_nbr)"""


def with_base(body: str, extra_ctes: str = "") -> str:
    ctes = BINDING + "," + LAYER
    if extra_ctes:
        ctes += "," + extra_ctes
    return "WITH" + ctes + "\n" + body


METRIC_COLS = ("date, month_start, year_num, month_num, month_name, weekday_num, weekday_name, "
               "is_weekend, store_nbr, city, state, store_type, cluster, "
               "CAST(total_sales AS DOUBLE) AS total_sales, total_items_on_promo, "
               "promoted_family_count, family_rows")
ENRICHED_COLS = (METRIC_COLS + ", transactions, missing_transactions_flag, "
                 "CAST(oil_price AS DOUBLE) AS oil_price, missing_oil_flag, "
                 "CAST(promo_family_mix_pct AS DOUBLE) AS promo_family_mix_pct, sales_per_transaction")
CONTEXT_COLS = (ENRICHED_COLS + ", is_special_day, is_holiday, holiday_scope, event_type_list, "
                "event_description_list")
LIFTS = (f"{R(PCT('m_rev', 'b_rev'))} AS revenue_lift_pct, "
         f"{R(PCT('m_tx', 'b_tx'))} AS transaction_lift_pct, "
         f"{R(PCT('m_b', 'b_b'))} AS basket_lift_pct")
DAY_MEANS = (f"{MEAN('total_sales')} AS m_rev, {MEAN('transactions')} AS m_tx, "
             f"avg(sales_per_transaction) AS m_b")


def _source(name: str, cols: str) -> str:
    return with_base(f"SELECT {cols} FROM {name}")


def _same_store(active: bool) -> str:
    both = "AND now.rev > 0 AND ago.rev > 0" if active else ""
    return with_base(f"""
SELECT strftime(month_start, '%Y-%m') AS month,
       count(*) AS comparable_stores,
       {MONEY('sum(rev_now)')} AS current_revenue,
       {MONEY('sum(rev_ago)')} AS prior_year_revenue,
       {R(PCT('sum(rev_now)', 'sum(rev_ago)'))} AS same_store_sales_growth_pct,
       {R(PCT('sum(tx_now)', 'sum(tx_ago)'))} AS same_store_transaction_growth_pct,
       {R(PCT(DIV('sum(rev_now)', 'sum(tx_now)'), DIV('sum(rev_ago)', 'sum(tx_ago)')))} AS same_store_basket_growth_pct
FROM matched GROUP BY month_start ORDER BY month_start""", f"""
store_month AS (
  SELECT store_nbr, month_start, sum(total_sales) AS rev, CAST(sum(transactions) AS BIGINT) AS tx
  FROM sd_ctx GROUP BY store_nbr, month_start),
matched AS (
  SELECT now.month_start, now.rev AS rev_now, ago.rev AS rev_ago, now.tx AS tx_now, ago.tx AS tx_ago
  FROM store_month now JOIN store_month ago
    ON ago.store_nbr = now.store_nbr
   AND ago.month_start = CAST(now.month_start - INTERVAL 12 MONTH AS DATE) {both})""")


ENTITY_TOTALS = """
entity_totals AS (
  SELECT 'Store Network' AS entity_type, sum(sales) AS rev FROM train GROUP BY store_nbr
  UNION ALL
  SELECT 'Product Family Mix', sum(sales) FROM train GROUP BY family),
ordered AS (
  SELECT entity_type, rev,
         row_number() OVER (PARTITION BY entity_type ORDER BY rev DESC) AS pos,
         count(*) OVER (PARTITION BY entity_type) AS n,
         sum(rev) OVER (PARTITION BY entity_type) AS tot
  FROM entity_totals)"""


ORACLE: dict[str, str] = {
    "s_stores": _source("stores", "store_nbr, city, state, type, cluster"),
    "s_train": _source("train", "date, store_nbr, family, CAST(sales AS DOUBLE) AS sales, onpromotion"),
    "s_transactions": _source("transactions", "date, store_nbr, transactions"),
    "s_holidays_events": _source("holidays_events", "date, type, locale, locale_name, description, transferred"),
    "s_oil": _source("oil", "date, CAST(dcoilwtico AS DOUBLE) AS dcoilwtico"),

    "v1_store_day_metrics": with_base(f"SELECT {METRIC_COLS} FROM sd_metrics"),
    "v2_oil_prices_filled": with_base(
        "SELECT date, CAST(oil_price_filled AS DOUBLE) AS oil_price_filled FROM oil_filled"),
    "v3_store_day_enriched": with_base(f"SELECT {ENRICHED_COLS} FROM sd_enriched"),
    # the event map, kept for the store-days that exist in the fact layer
    "v4_store_holiday_map": with_base("""
SELECT e.date, e.store_nbr, e.holiday_scope, e.event_type, e.description
FROM event_map e SEMI JOIN sd_metrics m ON m.date = e.date AND m.store_nbr = e.store_nbr"""),
    "v5_store_day_context": with_base(f"SELECT {CONTEXT_COLS} FROM sd_ctx"),

    "q01_coverage": with_base(f"""
SELECT count(*) AS store_day_rows,
       count(DISTINCT date) AS calendar_days,
       count(DISTINCT store_nbr) AS stores_covered,
       {MONEY('sum(total_sales)')} AS total_revenue,
       count(*) FILTER (WHERE missing_transactions_flag = 1) AS missing_transaction_store_days,
       {R('CAST(100 AS DOUBLE) * count(*) FILTER (WHERE missing_transactions_flag = 1) / count(*)')} AS missing_transaction_pct,
       count(*) FILTER (WHERE missing_oil_flag = 1) AS missing_oil_store_days,
       {R('CAST(100 AS DOUBLE) * count(*) FILTER (WHERE missing_oil_flag = 1) / count(*)')} AS missing_oil_pct,
       count(*) FILTER (WHERE total_sales = 0) AS zero_sales_store_days
FROM sd_ctx"""),

    "q02_anomaly_flags": with_base("""
SELECT count(*) AS total_store_days,
       count(*) FILTER (WHERE total_sales < 0) AS negative_revenue_store_days,
       count(*) FILTER (WHERE total_sales > 0 AND transactions = 0) AS sales_without_transactions_store_days,
       count(*) FILTER (WHERE total_sales = 0 AND transactions > 0) AS traffic_without_sales_store_days,
       count(*) FILTER (WHERE promo_family_mix_pct >= 50 AND total_sales = 0) AS heavy_promo_zero_sales_store_days,
       count(*) FILTER (WHERE total_sales > 0 AND sales_per_transaction IS NULL) AS unscorable_basket_quality_store_days
FROM sd_ctx"""),

    "q03_monthly_kpi": with_base(f"""
SELECT strftime(month_start, '%Y-%m') AS month,
       {MONEY('rev')} AS revenue,
       tx AS transactions,
       {R(DIV('rev', 'tx'))} AS avg_basket_value,
       {R('m_rev')} AS avg_store_day_revenue,
       active_stores,
       {R('m_mix')} AS avg_promo_family_mix_pct,
       {R('CAST(sum(rev) OVER w3 AS DOUBLE) / count(rev) OVER w3')} AS rolling_3m_revenue,
       {R(PCT('rev', 'lag(rev, 1) OVER w'))} AS mom_growth_pct,
       {R(PCT('rev', 'lag(rev, 12) OVER w'))} AS yoy_growth_pct
FROM by_month
WINDOW w AS (ORDER BY month_start), w3 AS (ORDER BY month_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
ORDER BY month_start""", f"""
by_month AS (
  SELECT month_start, sum(total_sales) AS rev, CAST(sum(transactions) AS BIGINT) AS tx,
         {MEAN('total_sales')} AS m_rev,
         count(DISTINCT store_nbr) FILTER (WHERE total_sales > 0) AS active_stores,
         {MEAN('promo_family_mix_pct')} AS m_mix
  FROM sd_ctx GROUP BY month_start)"""),

    "q04_same_store_growth": _same_store(False),
    "q04_same_store_growth_active": _same_store(True),

    "q05_seasonality": with_base(f"""
SELECT month_num, month_name, weekday_num + 1 AS weekday_order_monday_start, weekday_name,
       {R(MEAN('total_sales'))} AS avg_store_day_revenue,
       {R(MEAN('transactions'))} AS avg_transactions,
       {R('avg(sales_per_transaction)')} AS avg_sales_per_transaction
FROM sd_ctx
GROUP BY month_num, month_name, weekday_num, weekday_name
ORDER BY month_num, weekday_num"""),

    "q06_portfolio_roles": with_base(f"""
SELECT family, {MONEY('total')} AS total_revenue,
       {R(f"CAST(100 AS DOUBLE) * {D('total')} / NULLIF({D('sum(total) OVER ()')}, 0)")} AS revenue_share_pct,
       cv AS revenue_cv, growth AS recent_6m_growth_pct,
       CASE
         WHEN p_rev >= 0.80 AND p_cv <= 0.50 AND p_g >= 0.80 THEN 'Core Growth Driver'
         WHEN p_rev >= 0.80 AND p_cv <= 0.30 THEN 'Stable Cash Generator'
         WHEN p_cv >= 0.80 AND p_g >= 0.80 THEN 'Volatile Growth Bet'
         ELSE 'Monitor / Niche'
       END AS portfolio_role
FROM (SELECT *,
             percent_rank() OVER (ORDER BY total NULLS FIRST) AS p_rev,
             percent_rank() OVER (ORDER BY cv NULLS FIRST) AS p_cv,
             percent_rank() OVER (ORDER BY growth NULLS FIRST) AS p_g
      FROM (SELECT family, total, cv, {R(PCT('recent', 'earlier'))} AS growth FROM per_family) g) r
ORDER BY revenue_share_pct DESC, recent_6m_growth_pct DESC, family""", f"""
fam_month AS (
  SELECT family, CAST(date_trunc('month', date) AS DATE) AS ms, sum(sales) AS rev
  FROM train GROUP BY family, CAST(date_trunc('month', date) AS DATE)),
per_family AS (
  SELECT family, sum(rev) AS total,
         {R(f"stddev_pop({D('rev')}) / NULLIF({MEAN('rev')}, 0)", 3)} AS cv,
         COALESCE(sum(rev) FILTER (WHERE ms > CAST((SELECT max(ms) FROM fam_month) - INTERVAL 6 MONTH AS DATE)), 0) AS recent,
         COALESCE(sum(rev) FILTER (WHERE ms > CAST((SELECT max(ms) FROM fam_month) - INTERVAL 12 MONTH AS DATE)
                                     AND ms <= CAST((SELECT max(ms) FROM fam_month) - INTERVAL 6 MONTH AS DATE)), 0) AS earlier
  FROM fam_month GROUP BY family)"""),

    "q07_promo_dependency": with_base(f"""
SELECT family, {MONEY('total')} AS total_revenue, promo_row_pct,
       avg_sales_when_promoted, avg_sales_without_promo,
       {R(PCT('avg_sales_when_promoted', 'avg_sales_without_promo'))} AS promo_uplift_pct,
       CASE
         WHEN promo_row_pct >= 25 AND {PCT('avg_sales_when_promoted', 'avg_sales_without_promo')} >= 25
           THEN 'High Dependency / High Response'
         WHEN promo_row_pct >= 25 THEN 'High Dependency / Low Response'
         WHEN {PCT('avg_sales_when_promoted', 'avg_sales_without_promo')} >= 25 THEN 'Selective Promo Opportunity'
         ELSE 'Low Promo Sensitivity'
       END AS promo_profile
FROM (SELECT family, sum(sales) AS total,
             {R('CAST(100 AS DOUBLE) * count(*) FILTER (WHERE COALESCE(onpromotion, 0) > 0) / count(*)')} AS promo_row_pct,
             {R(MEAN('sales', 'COALESCE(onpromotion, 0) > 0'))} AS avg_sales_when_promoted,
             {R(MEAN('sales', 'COALESCE(onpromotion, 0) = 0'))} AS avg_sales_without_promo
      FROM train GROUP BY family) f
ORDER BY promo_uplift_pct DESC, total DESC, family"""),

    "q08_concentration": with_base(f"""
SELECT entity_type, max(n) AS entity_count,
       {R(f"sum(({DIV('rev', 'tot')}) * ({DIV('rev', 'tot')}))", 4)} AS hhi,
       {R(f"{DIV('max(rev)', 'max(tot)')} * 100")} AS top_1_share_pct,
       {R(f"{DIV('sum(rev) FILTER (WHERE pos <= ceiling(n * 0.20))', 'max(tot)')} * 100")} AS top_20pct_share_pct
FROM ordered GROUP BY entity_type
ORDER BY CASE entity_type WHEN 'Store Network' THEN 1 ELSE 2 END""", ENTITY_TOTALS),

    "q09_cluster_index": with_base(f"""
SELECT c.cluster, c.family,
       {R('c.cs')} AS cluster_share_pct,
       {R('f.ns')} AS network_share_pct,
       {R('c.cs / NULLIF(f.ns, 0)')} AS sales_index,
       CASE WHEN c.cs / NULLIF(f.ns, 0) >= 1.20 THEN 'Over-Indexed'
            WHEN c.cs / NULLIF(f.ns, 0) <= 0.80 THEN 'Under-Indexed'
            ELSE 'In-Line' END AS cluster_positioning
FROM by_cluster c JOIN by_family f ON f.family = c.family
ORDER BY c.cluster, sales_index DESC, c.family""", f"""
by_cluster AS (
  SELECT s.cluster, t.family,
         CAST(100 AS DOUBLE) * {D('sum(t.sales)')} / NULLIF({D('sum(sum(t.sales)) OVER (PARTITION BY s.cluster)')}, 0) AS cs
  FROM train t JOIN stores s ON s.store_nbr = t.store_nbr
  GROUP BY s.cluster, t.family),
by_family AS (
  SELECT family, CAST(100 AS DOUBLE) * {D('sum(sales)')} / NULLIF({D('sum(sum(sales)) OVER ()')}, 0) AS ns
  FROM train GROUP BY family)"""),

    "q10_store_scorecard": with_base(f"""
SELECT store_nbr, city, state, store_type, cluster,
       {MONEY('rev')} AS total_revenue,
       {R('m_rev')} AS avg_store_day_revenue,
       tx AS total_transactions,
       {R('bpt')} AS sales_per_transaction,
       {R('m_mix')} AS avg_promo_family_mix_pct,
       {R('special_share')} AS special_day_sales_share_pct,
       CAST(dense_rank() OVER (ORDER BY rev DESC NULLS LAST) AS INTEGER) AS revenue_rank,
       CAST(dense_rank() OVER (ORDER BY bpt DESC NULLS LAST) AS INTEGER) AS basket_rank
FROM (SELECT store_nbr, city, state, store_type, cluster,
             sum(total_sales) AS rev,
             {MEAN('total_sales')} AS m_rev,
             CAST(sum(transactions) AS BIGINT) AS tx,
             {DIV('sum(total_sales)', 'sum(transactions)')} AS bpt,
             {MEAN('promo_family_mix_pct')} AS m_mix,
             CAST(100 AS DOUBLE) * {D('COALESCE(sum(total_sales) FILTER (WHERE is_special_day = 1), 0)')}
               / NULLIF({D('sum(total_sales)')}, 0) AS special_share
      FROM sd_ctx GROUP BY store_nbr, city, state, store_type, cluster) s
ORDER BY revenue_rank, basket_rank, store_nbr"""),

    "q11_store_risk": with_base(f"""
SELECT store_nbr, city, state,
       CAST(r_rev AS DOUBLE) AS recent_90d_revenue, CAST(p_rev AS DOUBLE) AS prior_90d_revenue,
       revenue_growth_pct, transaction_growth_pct, basket_growth_pct,
       CASE
         WHEN revenue_growth_pct < lo_rev AND transaction_growth_pct < lo_tx AND basket_growth_pct < lo_b
           THEN 'High Risk Outlier (All Metrics Down)'
         WHEN revenue_growth_pct < lo_rev AND transaction_growth_pct < lo_tx THEN 'Traffic Risk Outlier'
         WHEN revenue_growth_pct < lo_rev AND basket_growth_pct < lo_b THEN 'Basket Risk Outlier'
         WHEN revenue_growth_pct >= avg_rev AND transaction_growth_pct >= avg_tx THEN 'Healthy Above Average'
         ELSE 'Watchlist'
       END AS risk_tier
FROM (SELECT *,
             avg(revenue_growth_pct) OVER () AS avg_rev,
             avg(transaction_growth_pct) OVER () AS avg_tx,
             avg(revenue_growth_pct) OVER () - stddev_pop(revenue_growth_pct) OVER () AS lo_rev,
             avg(transaction_growth_pct) OVER () - stddev_pop(transaction_growth_pct) OVER () AS lo_tx,
             avg(basket_growth_pct) OVER () - stddev_pop(basket_growth_pct) OVER () AS lo_b
      FROM growth) g
ORDER BY CASE WHEN risk_tier LIKE '%High Risk%' THEN 1 WHEN risk_tier LIKE '%Traffic Risk%' THEN 2
              WHEN risk_tier LIKE '%Basket Risk%' THEN 3 WHEN risk_tier = 'Watchlist' THEN 4 ELSE 5 END,
         revenue_growth_pct NULLS FIRST, store_nbr""", f"""
tagged AS (
  SELECT c.*,
         CASE WHEN c.date > (SELECT max(date) FROM sd_ctx) - 90 THEN 'recent'
              WHEN c.date > (SELECT max(date) FROM sd_ctx) - 180 THEN 'prior' END AS span
  FROM sd_ctx c),
per_store AS (
  SELECT store_nbr, max(city) AS city, max(state) AS state,
         COALESCE(sum(total_sales) FILTER (WHERE span = 'recent'), 0) AS r_rev,
         COALESCE(sum(total_sales) FILTER (WHERE span = 'prior'), 0) AS p_rev,
         COALESCE(sum(transactions) FILTER (WHERE span = 'recent'), 0) AS r_tx,
         COALESCE(sum(transactions) FILTER (WHERE span = 'prior'), 0) AS p_tx,
         avg(sales_per_transaction) FILTER (WHERE span = 'recent') AS r_b,
         avg(sales_per_transaction) FILTER (WHERE span = 'prior') AS p_b
  FROM tagged GROUP BY store_nbr),
growth AS (
  SELECT store_nbr, city, state, r_rev, p_rev,
         {R(PCT('r_rev', 'p_rev'))} AS revenue_growth_pct,
         {R(PCT('r_tx', 'p_tx'))} AS transaction_growth_pct,
         {R(PCT('r_b', 'p_b'))} AS basket_growth_pct
  FROM per_store WHERE p_rev > 0)"""),

    "q12_store_archetypes": with_base(f"""
SELECT store_nbr, city, state, cluster,
       {MONEY('rev')} AS total_revenue,
       {R('bpt')} AS sales_per_transaction,
       rq AS revenue_quartile, bq AS basket_quartile,
       CASE
         WHEN rq = 1 AND bq = 1 THEN 'Scale + Basket Leader'
         WHEN rq = 1 AND bq >= 2 THEN 'Traffic-Led Scale Store'
         WHEN rq IN (2, 3) AND bq = 1 THEN 'Premium Basket Store'
         WHEN rq = 4 AND bq = 4 THEN 'Turnaround Candidate'
         ELSE 'Middle Portfolio Store'
       END AS store_archetype
FROM (SELECT *,
             CAST(ntile(4) OVER (ORDER BY rev DESC NULLS LAST, store_nbr) AS INTEGER) AS rq,
             CAST(ntile(4) OVER (ORDER BY bpt DESC NULLS LAST, store_nbr) AS INTEGER) AS bq
      FROM (SELECT store_nbr, city, state, cluster, sum(total_sales) AS rev,
                   {DIV('sum(total_sales)', 'sum(transactions)')} AS bpt
            FROM sd_ctx GROUP BY store_nbr, city, state, cluster) s) q
ORDER BY rq, bq, rev DESC, store_nbr"""),

    "q13_holiday_lift": with_base(f"""
SELECT day_group, store_days,
       {R('m_rev')} AS avg_store_day_revenue,
       {R('m_tx')} AS avg_transactions,
       {R('m_b')} AS avg_sales_per_transaction,
       {R('m_rev - b_rev')} AS revenue_delta_vs_non_holiday,
       {LIFTS}
FROM (SELECT *,
             max(CASE WHEN day_group = 'Non-Holiday' THEN m_rev END) OVER () AS b_rev,
             max(CASE WHEN day_group = 'Non-Holiday' THEN m_tx END) OVER () AS b_tx,
             max(CASE WHEN day_group = 'Non-Holiday' THEN m_b END) OVER () AS b_b,
             count(CASE WHEN day_group = 'Non-Holiday' THEN 1 END) OVER () AS with_base
      FROM groups) g
WHERE with_base > 0
ORDER BY CASE day_group WHEN 'Non-Holiday' THEN 1 WHEN 'National Holiday' THEN 2
                        WHEN 'Regional Holiday' THEN 3 WHEN 'Local Holiday' THEN 4 ELSE 5 END""", f"""
groups AS (
  SELECT CASE WHEN is_holiday = 0 THEN 'Non-Holiday'
              WHEN holiday_scope = 'Mixed' THEN 'Mixed-Scope Holiday'
              ELSE holiday_scope || ' Holiday' END AS day_group,
         count(*) AS store_days, {DAY_MEANS}
  FROM sd_ctx GROUP BY 1)"""),

    "q14_event_lift": with_base(f"""
SELECT holiday_scope, event_type, description, affected_store_days,
       {R('m_rev')} AS avg_store_day_revenue,
       {LIFTS}
FROM (SELECT e.*, o.b_rev, o.b_tx, o.b_b FROM per_event e, ordinary o) x
ORDER BY revenue_lift_pct DESC NULLS LAST, affected_store_days DESC, holiday_scope, event_type, description
LIMIT 25""", f"""
per_event AS (
  SELECT m.holiday_scope, m.event_type, m.description, count(*) AS affected_store_days,
         {MEAN('c.total_sales')} AS m_rev, {MEAN('c.transactions')} AS m_tx,
         avg(c.sales_per_transaction) AS m_b
  FROM event_map m JOIN sd_ctx c ON c.date = m.date AND c.store_nbr = m.store_nbr
  GROUP BY m.holiday_scope, m.event_type, m.description
  HAVING count(*) >= 20),
ordinary AS (
  SELECT {MEAN('total_sales')} AS b_rev, {MEAN('transactions')} AS b_tx, avg(sales_per_transaction) AS b_b
  FROM sd_ctx WHERE is_special_day = 0)"""),

    "q15_oil_regimes": with_base(f"""
SELECT q AS oil_price_quartile,
       {R('min(oil)')} AS min_avg_oil_price,
       {R('max(oil)')} AS max_avg_oil_price,
       {R(MEAN('rev'))} AS avg_monthly_revenue,
       {R(f"avg({DIV('rev', 'tx')})")} AS avg_basket_value,
       max(n_months) AS months_compared,
       {R('max(r)', 4)} AS revenue_oil_correlation
FROM (SELECT *,
             CAST(ntile(4) OVER (ORDER BY oil, month_start) AS INTEGER) AS q,
             count(*) OVER () AS n_months,
             covar_pop(oil, {D('rev')}) OVER ()
               / NULLIF(stddev_pop(oil) OVER () * stddev_pop({D('rev')}) OVER (), 0) AS r
      FROM with_oil) b
GROUP BY q ORDER BY q""", f"""
with_oil AS (
  SELECT month_start, sum(total_sales) AS rev, CAST(sum(transactions) AS BIGINT) AS tx,
         {MEAN('oil_price')} AS oil
  FROM sd_ctx GROUP BY month_start
  HAVING count(oil_price) > 0)"""),

    "q16_network_anomalies": with_base(f"""
SELECT d.date, {MONEY('d.rev')} AS network_revenue, d.tx AS network_transactions,
       {R(DIV('d.rev', 'd.tx'))} AS basket_value,
       {R('d.mix')} AS avg_promo_family_mix_pct,
       {R('d.z')} AS z_score,
       CASE WHEN d.z >= 2 THEN 'High Revenue Outlier' ELSE 'Low Revenue Outlier' END AS outlier_type,
       d.has_special_day,
       COALESCE(e.descs, 'No mapped event context') AS event_context
FROM (SELECT *, ({D('rev')} - CAST(sum(rev) OVER () AS DOUBLE) / count(rev) OVER ())
                / NULLIF(stddev_pop({D('rev')}) OVER (), 0) AS z
      FROM daily) d
LEFT JOIN (SELECT date, array_to_string(list_sort(list_distinct(list(description))), ' | ') AS descs
           FROM event_map GROUP BY date) e ON e.date = d.date
WHERE abs(d.z) >= 2
ORDER BY abs(d.z) DESC, d.date""", f"""
daily AS (
  SELECT date, sum(total_sales) AS rev, CAST(sum(transactions) AS BIGINT) AS tx,
         {MEAN('promo_family_mix_pct')} AS mix, max(is_special_day) AS has_special_day
  FROM sd_ctx GROUP BY date)"""),

    "x1_coverage_span": with_base("""
SELECT min(date) AS first_date, max(date) AS last_date, count(DISTINCT store_nbr) AS stores,
       count(DISTINCT family) AS families, count(*) AS fact_rows
FROM train"""),

    "x2_top_n_share": with_base(f"""
SELECT o.entity_type, count(*) AS entity_count, l.top_n,
       {MONEY('COALESCE(sum(o.rev) FILTER (WHERE o.pos <= l.top_n), 0)')} AS top_n_revenue,
       {R(f"CAST(100 AS DOUBLE) * {D('COALESCE(sum(o.rev) FILTER (WHERE o.pos <= l.top_n), 0)')} / NULLIF({D('sum(o.rev)')}, 0)")} AS top_n_share_pct
FROM ordered o JOIN top_sizes l ON l.entity_type = o.entity_type
GROUP BY o.entity_type, l.top_n
ORDER BY CASE o.entity_type WHEN 'Store Network' THEN 1 ELSE 2 END""", ENTITY_TOTALS + """,
top_sizes(entity_type, top_n) AS (VALUES ('Store Network', 10), ('Product Family Mix', 5))"""),

    "x3_comparable_ytd": with_base(f"""
SELECT CAST(year(max(last_day)) AS INTEGER) AS current_year, max(last_day) AS through_date,
       count(*) AS comparable_stores,
       {MONEY('sum(cur)')} AS current_ytd_revenue,
       {MONEY('sum(prev)')} AS prior_ytd_revenue,
       {R(PCT('sum(cur)', 'sum(prev)'))} AS ytd_growth_pct
FROM per_store WHERE n_cur > 0 AND n_prev > 0""", """
bounds AS (
  SELECT max(date) AS last_day,
         make_date(CAST(year(max(date)) AS INTEGER), 1, 1) AS cur_from,
         make_date(CAST(year(max(date)) AS INTEGER) - 1, 1, 1) AS prev_from,
         CAST(max(date) - INTERVAL 12 MONTH AS DATE) AS prev_to
  FROM sd_ctx),
per_store AS (
  SELECT c.store_nbr, b.last_day,
         sum(c.total_sales) FILTER (WHERE c.date BETWEEN b.cur_from AND b.last_day) AS cur,
         sum(c.total_sales) FILTER (WHERE c.date BETWEEN b.prev_from AND b.prev_to) AS prev,
         count(*) FILTER (WHERE c.date BETWEEN b.cur_from AND b.last_day) AS n_cur,
         count(*) FILTER (WHERE c.date BETWEEN b.prev_from AND b.prev_to) AS n_prev
  FROM sd_ctx c JOIN bounds b ON TRUE
  GROUP BY c.store_nbr, b.last_day)"""),

    "x4_holiday_vs_non_holiday": with_base(f"""
SELECT day_group, store_days, {R('m_rev')} AS avg_store_day_revenue, {LIFTS}
FROM (SELECT *,
             max(CASE WHEN day_group = 'Non-Holiday' THEN m_rev END) OVER () AS b_rev,
             max(CASE WHEN day_group = 'Non-Holiday' THEN m_tx END) OVER () AS b_tx,
             max(CASE WHEN day_group = 'Non-Holiday' THEN m_b END) OVER () AS b_b,
             count(CASE WHEN day_group = 'Non-Holiday' THEN 1 END) OVER () AS with_base
      FROM (SELECT CASE WHEN is_holiday = 1 THEN 'Holiday' ELSE 'Non-Holiday' END AS day_group,
                   count(*) AS store_days, {DAY_MEANS}
            FROM sd_ctx GROUP BY 1) g0) g
WHERE with_base > 0
ORDER BY day_group DESC"""),

    "x5_weekday_strength": with_base(f"""
SELECT weekday_num, weekday_name, store_days, {R('m')} AS avg_store_day_revenue,
       CAST(dense_rank() OVER (ORDER BY m DESC) AS INTEGER) AS strength_rank,
       CASE WHEN m = max(m) OVER () THEN 'Strongest'
            WHEN m = min(m) OVER () THEN 'Weakest' ELSE 'Middle' END AS weekday_role
FROM (SELECT weekday_num, weekday_name, count(*) AS store_days, {MEAN('total_sales')} AS m
      FROM sd_ctx GROUP BY weekday_num, weekday_name) g
ORDER BY weekday_num"""),

    "asof_oil_fill": with_base("""
SELECT d.date, CAST(k.dcoilwtico AS DOUBLE) AS oil_price_asof
FROM (SELECT DISTINCT date FROM sd_ctx) d
ASOF LEFT JOIN (SELECT date, dcoilwtico FROM oil WHERE dcoilwtico IS NOT NULL) k
  ON d.date >= k.date"""),

    "monthly_growth_calendar": with_base(f"""
SELECT strftime(m.month_start, '%Y-%m') AS month, {MONEY('m.rev')} AS revenue,
       {R(PCT('m.rev', 'one.rev'))} AS mom_growth_pct,
       {R(PCT('m.rev', 'twelve.rev'))} AS yoy_growth_pct
FROM monthly m
LEFT JOIN monthly one ON one.month_start = CAST(m.month_start - INTERVAL 1 MONTH AS DATE)
LEFT JOIN monthly twelve ON twelve.month_start = CAST(m.month_start - INTERVAL 12 MONTH AS DATE)
ORDER BY month""", """
monthly AS (SELECT month_start, sum(total_sales) AS rev FROM sd_ctx GROUP BY month_start)"""),
    "check_constraints": with_base("""
SELECT 'stores' AS table_name, 'unique(store_nbr)' AS rule,
       (SELECT COUNT(*) FROM (SELECT store_nbr FROM stores GROUP BY store_nbr HAVING COUNT(*) > 1)) AS violations
UNION ALL SELECT 'train', 'unique(date,store_nbr,family)',
       (SELECT COUNT(*) FROM (SELECT 1 FROM train GROUP BY date, store_nbr, family HAVING COUNT(*) > 1))
UNION ALL SELECT 'transactions', 'unique(date,store_nbr)',
       (SELECT COUNT(*) FROM (SELECT 1 FROM transactions GROUP BY date, store_nbr HAVING COUNT(*) > 1))
UNION ALL SELECT 'oil', 'unique(date)',
       (SELECT COUNT(*) FROM (SELECT 1 FROM oil GROUP BY date HAVING COUNT(*) > 1))
UNION ALL SELECT 'holidays_events', 'duplicate rows',
       (SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM holidays_events
        GROUP BY date, type, locale, locale_name, description, transferred HAVING COUNT(*) > 1))
UNION ALL SELECT 'train', 'store_nbr -> stores.store_nbr',
       (SELECT COUNT(*) FROM train t WHERE NOT EXISTS (SELECT 1 FROM stores s WHERE s.store_nbr = t.store_nbr))
UNION ALL SELECT 'transactions', 'store_nbr -> stores.store_nbr',
       (SELECT COUNT(*) FROM transactions t WHERE NOT EXISTS (SELECT 1 FROM stores s WHERE s.store_nbr = t.store_nbr))
UNION ALL SELECT 'stores', 'not_null(store_nbr)', (SELECT COUNT(*) FROM stores WHERE store_nbr IS NULL)
UNION ALL SELECT 'stores', 'not_null(city)', (SELECT COUNT(*) FROM stores WHERE city IS NULL)
UNION ALL SELECT 'stores', 'not_null(state)', (SELECT COUNT(*) FROM stores WHERE state IS NULL)
UNION ALL SELECT 'stores', 'not_null(type)', (SELECT COUNT(*) FROM stores WHERE type IS NULL)
UNION ALL SELECT 'stores', 'not_null(cluster)', (SELECT COUNT(*) FROM stores WHERE cluster IS NULL)
UNION ALL SELECT 'train', 'not_null(date)', (SELECT COUNT(*) FROM train WHERE date IS NULL)
UNION ALL SELECT 'train', 'not_null(store_nbr)', (SELECT COUNT(*) FROM train WHERE store_nbr IS NULL)
UNION ALL SELECT 'train', 'not_null(family)', (SELECT COUNT(*) FROM train WHERE family IS NULL)
UNION ALL SELECT 'train', 'not_null(sales)', (SELECT COUNT(*) FROM train WHERE sales IS NULL)
UNION ALL SELECT 'train', 'not_null(onpromotion)', (SELECT COUNT(*) FROM train WHERE onpromotion IS NULL)
UNION ALL SELECT 'transactions', 'not_null(date)', (SELECT COUNT(*) FROM transactions WHERE date IS NULL)
UNION ALL SELECT 'transactions', 'not_null(store_nbr)', (SELECT COUNT(*) FROM transactions WHERE store_nbr IS NULL)
UNION ALL SELECT 'transactions', 'not_null(transactions)', (SELECT COUNT(*) FROM transactions WHERE transactions IS NULL)
UNION ALL SELECT 'holidays_events', 'not_null(date)', (SELECT COUNT(*) FROM holidays_events WHERE date IS NULL)
UNION ALL SELECT 'holidays_events', 'not_null(type)', (SELECT COUNT(*) FROM holidays_events WHERE type IS NULL)
UNION ALL SELECT 'holidays_events', 'not_null(locale)', (SELECT COUNT(*) FROM holidays_events WHERE locale IS NULL)
UNION ALL SELECT 'holidays_events', 'not_null(locale_name)', (SELECT COUNT(*) FROM holidays_events WHERE locale_name IS NULL)
UNION ALL SELECT 'holidays_events', 'not_null(description)', (SELECT COUNT(*) FROM holidays_events WHERE description IS NULL)
UNION ALL SELECT 'holidays_events', 'not_null(transferred)', (SELECT COUNT(*) FROM holidays_events WHERE transferred IS NULL)
UNION ALL SELECT 'oil', 'not_null(date)', (SELECT COUNT(*) FROM oil WHERE date IS NULL)"""),
}
