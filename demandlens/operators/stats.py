"""Statistical operators: variation, shares, concentration, percentile and quantile
segments, sigma bands, z-scores and correlation.

Whole-set operations (ranks, totals, network means) are applied only to *aggregated entity
tables* -- one row per family, store, cluster x family, month, date or day group -- never
to the fact table or the store-day layer. Totals, means and sums of squares are scalar
aggregates; ranks go by quantile buckets (``ranking``), so no task holds an entity table. An
operator that reads its table more than once writes it first (``settled``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import dbl, dec_lit, exact_mean, money_out, nullif0, ratio_mean, ratio_sd, rnd
from ..sources.sink import write_table
from .ranking import Rank, ranked, row_numbers


def settled(entity: DataFrame) -> DataFrame:
    """The entity table written once, so that every read of it sees the same rows and values."""
    return write_table(entity, entity.sparkSession, "entity")


def over_all() -> Window:
    """The whole (entity-level) table as one window."""
    return Window.partitionBy()


def coefficient_of_variation(value) -> Column:
    """Aggregate: population standard deviation over the exact mean (NULL for a zero mean)."""
    return F.stddev_pop(dbl(value)) / nullif0(exact_mean(value))


def share_of_total(value: str, partition_by=()) -> Column:
    """100 * value / SUM(value) over the partition (or the whole entity table), DOUBLE."""
    w = Window.partitionBy(*partition_by) if partition_by else over_all()
    return F.lit(100.0) * dbl(value) / nullif0(dbl(F.sum(value).over(w)))


def with_share_of_total(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add ``out`` = 100 * value / SUM(value) over the whole entity table."""
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(out, F.lit(100.0) * dbl(value) / nullif0(dbl(total)))


def affinity_index(segment_share: Column, overall_share: Column) -> Column:
    """Ratio of a segment's share to the overall share (1.0 = in line)."""
    return segment_share / nullif0(overall_share)


def dense_rank_desc(value: str) -> Column:
    """DENSE_RANK of a calendar-sized table (day groups) in one window."""
    return F.dense_rank().over(Window.orderBy(F.col(value).desc()))


def quantile_segment(n: int, *order: Column) -> Column:
    """NTILE(n) of a calendar-sized table (months) in one window, over a total order."""
    return F.ntile(n).over(Window.orderBy(*order))


def rank_percentiles(df: DataFrame, cols: dict) -> DataFrame:
    """Add one PERCENT_RANK column per entry {out: order column} of a settled table, ascending
    with NULLs first (as the source dialect orders). All columns share one rank index."""
    return ranked(df, [Rank(c, {out: "percent"}) for out, c in cols.items()])


def with_dense_ranks_desc(df: DataFrame, cols: dict) -> DataFrame:
    """Add one DENSE_RANK column per entry {out: value}, descending with NULLs last, to a settled
    table. All columns share one rank index."""
    return ranked(df, [Rank(v, {out: "dense"}, True, False) for out, v in cols.items()])


def quantile_segments(df: DataFrame, n: int, specs: dict, tie_break: str) -> DataFrame:
    """Add NTILE(n) columns {out: (value, descending)} to a settled table; NULL values sort first
    ascending and last descending; ``tie_break`` (a unique key) orders equal values. All columns
    share one rank index."""
    return ranked(df, [Rank(v, {out: n}, desc, not desc, tie_break) for out, (v, desc) in specs.items()])


def concentration(entity_totals: DataFrame, value: str, label: str, key: str,
                  top_frac: float = 0.20) -> DataFrame:
    """One row: entity_type, entity_count, hhi (sum of squared shares, 0-1 scale),
    top_1_share_pct, top_20pct_share_pct (share of the ceil(n * top_frac) largest).
    ``entity_totals`` (settled) has one row per ``key``."""
    total = dbl(entity_totals.agg(F.sum(value)).scalar())
    numbered = row_numbers(entity_totals.select(F.col(value).alias("_v"), F.col(key).alias("_k")), "_v", "_k", "_rn",
                           "_n", descending=True)
    share = dbl("_v") / nullif0(total)
    in_top = F.col("_rn") <= F.ceil(F.col("_n") * dec_lit(top_frac))
    return numbered.agg(
        F.lit(label).alias("entity_type"),
        F.max("_n").alias("entity_count"),
        rnd(F.sum(share * share), 4).alias("hhi"),
        rnd(dbl(F.max("_v")) / nullif0(F.max(total)) * 100, 2).alias("top_1_share_pct"),
        rnd(dbl(F.sum(F.when(in_top, F.col("_v")).otherwise(F.lit(0)))) / nullif0(F.max(total)) * 100, 2)
         .alias("top_20pct_share_pct"))


def top_n_share(entity_totals: DataFrame, value: str, n: int, key: str) -> DataFrame:
    """One row: entity_count, top_n, top_n_revenue (exact), top_n_share_pct. The n largest are a
    distributed top-n; count and total are one aggregate."""
    best = entity_totals.orderBy(F.col(value).desc(), F.col(key).asc()).limit(n)
    whole = entity_totals.agg(F.struct(F.count(F.lit(1)).alias("c"), F.sum(value).alias("s"))).scalar()
    top = F.coalesce(F.sum(value), F.lit(0))
    return best.agg(
        F.max(whole.getField("c")).alias("entity_count"),
        F.lit(n).alias("top_n"),
        money_out(top).alias("top_n_revenue"),
        rnd(F.lit(100.0) * dbl(top) / nullif0(dbl(F.max(whole.getField("s")))), 2).alias("top_n_share_pct"))


def sigma_band(df: DataFrame, cols, k: float = 1.0) -> DataFrame:
    """Add _avg_<c> and _lo_<c> = mean - k * population sd of each column, over the whole
    (entity-level) table: one aggregate used as a scalar. Means and deviations do not depend on
    the order of the rows, so a value at a bound falls on the same side in every run."""
    stats = df.agg(F.struct(*[ratio_mean(c).alias("m_" + c) for c in cols],
                            *[ratio_sd(c).alias("s_" + c) for c in cols])).scalar()
    return df.withColumns({"_avg_" + c: stats.getField("m_" + c) for c in cols}
                          | {"_lo_" + c: stats.getField("m_" + c) - F.lit(k) * stats.getField("s_" + c)
                             for c in cols})


def zscore_outliers(df: DataFrame, value: str, threshold: float = 2.0, out: str = "z_score",
                    keep_all: bool = False) -> DataFrame:
    """z = (value - mean) / population sd over the whole (entity-level) table; NULL for a
    zero sd. Keeps rows with |z| >= threshold unless ``keep_all``."""
    s = df.agg(F.struct(exact_mean(value).alias("m"), F.stddev_pop(dbl(value)).alias("sd"))).scalar()
    df = df.withColumn(out, (dbl(value) - s.getField("m")) / nullif0(s.getField("sd")))
    return df if keep_all else df.filter(F.abs(F.col(out)) >= threshold)


def pearson(x, y, over: Window | None = None) -> Column:
    """Population covariance over the product of population standard deviations, on DOUBLE
    inputs; NULL for a constant or single-point series (never NaN, never an error). An
    aggregate, or a window function when ``over`` is given."""
    x, y = dbl(x), dbl(y)
    w = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return w(F.covar_pop(x, y)) / nullif0(w(F.stddev_pop(x)) * w(F.stddev_pop(y)))
