"""Time-series operators: forward / as-of filling, rolling means, period growth,
trailing-window comparison and same-period-prior-year matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.numeric import col, pct_change, ratio_mean
from . import scan


def forward_fill(df: DataFrame, value: str, order_by: str, partition_by=(),
                 out: str | None = None, segments: int | None = None) -> DataFrame:
    """Carry the last non-NULL ``value`` forward over the rows that exist (ordered by
    ``order_by``); rows before the first known value stay NULL. No rows are created: a date
    missing from ``df`` stays missing (use ``asof_fill`` to fill a spine).

    Without ``partition_by`` the rows are one series, scanned in segments (``scan.fill``). With it each
    series is a window of its own; say ``segments`` where a single series may be hot."""
    if segments or not partition_by:
        return scan.fill(df, value, order_by, out or value, partition_by, segments or scan.SEGMENTS)
    w = (Window.partitionBy(*partition_by).orderBy(order_by)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(out or value, F.last(F.col(value), ignorenulls=True).over(w))


def asof_fill(values: DataFrame, spine: DataFrame, key: str, value: str,
              out: str | None = None, partition_by=()) -> DataFrame:
    """For every row of ``spine`` (distinct ``key`` values, e.g. every calendar date), the
    last non-NULL ``value`` of ``values`` at or before that key (an as-of lookup).

    The spine and the value rows are stacked and filled in one ordered pass; value rows
    sort before spine rows with the same key so a same-day price is used."""
    out = out or value
    v = values.select(*partition_by, F.col(key), F.col(value).alias("_v"), F.lit(0).alias("_src"))
    s = (spine.select(*partition_by, F.col(key)).distinct()
         .select("*", F.lit(None).cast(values.schema[value].dataType).alias("_v"),
                 F.lit(1).alias("_src")))
    w = (Window.partitionBy(*partition_by).orderBy(key, "_src")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (v.unionByName(s)
            .withColumn(out, F.last("_v", ignorenulls=True).over(w))
            .filter(F.col("_src") == 1)
            .select(*partition_by, key, out))


def rolling_mean(value: str, order_by: str, rows: int, over: WindowSpec | None = None) -> Column:
    """Mean over the current and ``rows - 1`` preceding rows (partial at the start), from an
    exact sum of the (decimal) inputs. For period-sized tables; ``over`` is another ordered window,
    such as one of ``scan.look_back``."""
    w = (over or Window.orderBy(order_by)).rowsBetween(-(rows - 1), Window.currentRow)
    return F.sum(value).over(w).cast("double") / F.count(value).over(w)


def lag_positional(value: str, order_by: str, n: int, over: WindowSpec | None = None) -> Column:
    """Value ``n`` rows earlier (a missing period shifts the comparison). For period-sized tables, or
    ``over`` another ordered window."""
    return F.lag(value, n).over(over or Window.orderBy(order_by))


def rolling_means(df: DataFrame, value: str, order_by: str, rows: int, out: str, partition_by=()) -> DataFrame:
    """``rolling_mean`` as a column of a series of any length."""
    made = {out: lambda w: rolling_mean(value, order_by, rows, w)}
    return scan.look_back(df, order_by, rows - 1, made, partition_by)


def lags_positional(df: DataFrame, value: str, order_by: str, n: int, out: str, partition_by=()) -> DataFrame:
    """``lag_positional`` as a column of a series of any length."""
    return scan.look_back(df, order_by, n, {out: lambda w: lag_positional(value, order_by, n, w)}, partition_by)


def lag_calendar(df: DataFrame, value: str, period: str, months: int, out: str,
                 source: DataFrame | None = None) -> DataFrame:
    """Value of the period exactly ``months`` months earlier (NULL if that period is absent):
    an equi-join on the shifted period key instead of a positional lag. ``source`` (default
    ``df``) is the one-row-per-period table the earlier values come from."""
    src = df if source is None else source
    prior = src.select(F.add_months(F.col(period), months).alias("_shifted"), F.col(value).alias(out))
    # null-safe: no inferred filter differs between the two sides, so both read one aggregate
    return df.join(prior, df[period].eqNullSafe(prior["_shifted"]), "left").drop("_shifted")


def window_bounds(anchor: Column, n: int, unit: str = "day"):
    """(recent_lo, recent_hi, prior_lo, prior_hi) for the last ``n`` units up to ``anchor``
    (inclusive) and the ``n`` units before them."""
    if unit == "day":
        return (F.date_sub(anchor, n - 1), anchor, F.date_sub(anchor, 2 * n - 1), F.date_sub(anchor, n))
    if unit == "month":
        return (F.add_months(anchor, -(n - 1)), anchor, F.add_months(anchor, -(2 * n - 1)),
                F.add_months(anchor, -n))
    raise ValueError(unit)


def in_range(c, lo: Column, hi: Column) -> Column:
    return col(c).between(lo, hi)


def trailing_compare(value, date_col: str, anchor: Column, n: int, unit: str = "day",
                     how: str = "sum"):
    """Aggregate pair (recent, prior) of ``value`` over the last ``n`` units up to ``anchor``
    and the ``n`` units before them. ``how='sum'`` adds (0 outside the window, exact for
    decimals); ``how='mean'`` averages the rows inside the window (NULL if none), free
    of their order."""
    rlo, rhi, plo, phi = window_bounds(anchor, n, unit)
    recent, prior = in_range(date_col, rlo, rhi), in_range(date_col, plo, phi)
    v = col(value)
    if how == "sum":
        return (F.sum(F.when(recent, v).otherwise(F.lit(0))), F.sum(F.when(prior, v).otherwise(F.lit(0))))
    if how == "mean":
        return ratio_mean(F.when(recent, v)), ratio_mean(F.when(prior, v))
    raise ValueError(how)


def period_growth(df: DataFrame, value: str, period: str, n: int, out: str,
                  mode: str = "positional") -> DataFrame:
    """Add ``out`` = 100 * (value - earlier) / earlier (unrounded) where ``earlier`` is the
    value ``n`` rows before (positional, as LAG does: a missing period shifts it) or the
    value of the period exactly ``n`` months before (calendar; NULL when absent).
    ``df`` has one row per period (a calendar-sized table)."""
    if mode == "positional":
        return df.withColumn(out, pct_change(F.col(value), lag_positional(value, period, n)))
    if mode == "calendar":
        tmp = "_prior_" + out
        return (lag_calendar(df, value, period, n, tmp)
                .withColumn(out, pct_change(F.col(value), F.col(tmp))).drop(tmp))
    raise ValueError(mode)


def same_period_prior_year(periodic: DataFrame, entity: str, period: str, measures,
                           require_active: str | None = None) -> DataFrame:
    """Pair every (entity, period) row with the same entity's row 12 months earlier.

    Returns entity, period, cur_<m> and prev_<m> for each measure. An equi-join on
    (entity, period) after shifting the prior side forward by a year: a hash join, never a
    range or cross join. ``require_active`` names a measure that must be > 0 on both sides
    (comparable = trading in both years, not merely present)."""
    cur = periodic.select(entity, period, *[F.col(m).alias("cur_" + m) for m in measures])
    prev = periodic.select(F.col(entity).alias("_e"), F.add_months(F.col(period), 12).alias("_p"),
                           *[F.col(m).alias("prev_" + m) for m in measures])
    if require_active:
        cur = cur.filter(F.col("cur_" + require_active) > 0)
        prev = prev.filter(F.col("prev_" + require_active) > 0)
    # Keys are NOT NULL group keys; the null-safe form keeps the optimizer from inferring
    # different filters on the two sides, so both sides reuse one aggregate's exchange.
    cond = cur[entity].eqNullSafe(prev["_e"]) & cur[period].eqNullSafe(prev["_p"])
    return cur.join(prev, cond).drop("_e", "_p")
