"""Numeric contract shared by every operator (decided once, used everywhere).

* Money stays an exact DECIMAL while it is summed; it becomes DOUBLE only to divide.
* Ratios, averages and percentages are DOUBLE, computed in one fixed order so that any
  engine doing the same IEEE operations gets the same bits.
* Every division is guarded: ANSI Spark raises on a zero divisor, the reference dialect
  gives NULL, so a zero divisor becomes NULL here.
* A DOUBLE is rounded by first snapping it to 6 decimals (``DECIMAL(38,6)``) and then
  rounding HALF_UP in exact decimal arithmetic (``rnd``). A value that is a decimal tie in
  exact arithmetic (a mean of 52239.105, a ratio of 0.825) may reach DOUBLE one ulp below
  the tie; the snap restores the tie so it rounds up, as exact decimal arithmetic does.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(14,4)"
PRICE = "decimal(12,4)"
PCT_DEC = "decimal(5,2)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c) -> Column:
    return col(c).cast("double")


def nullif0(c) -> Column:
    c = col(c)
    return F.when(c != 0, c)


def safe_div(num, den) -> Column:
    """DOUBLE num / den; NULL when den is 0 or NULL."""
    return dbl(num) / nullif0(dbl(den))


def pct_of(part, whole) -> Column:
    """100 * part / whole as DOUBLE (unrounded); NULL for a zero whole."""
    return F.lit(100.0) * dbl(part) / nullif0(dbl(whole))


def pct_change(cur, prev) -> Column:
    """100 * (cur - prev) / prev, unrounded. The difference is taken in the input type
    (exact for decimals and integers) before it becomes DOUBLE."""
    cur, prev = col(cur), col(prev)
    return F.lit(100.0) * (cur - prev).cast("double") / nullif0(dbl(prev))


SNAP = "decimal(38,6)"


def rnd(c, n: int = 2) -> Column:
    """ROUND of a DOUBLE (see module notes), returned as DOUBLE."""
    return F.round(col(c).cast(SNAP), n).cast("double")


def money_out(c, n: int = 2) -> Column:
    """Round an exact decimal amount, then hand it out as DOUBLE."""
    return F.round(col(c), n).cast("double")


def exact_mean(c) -> Column:
    """Aggregate: exact SUM of a decimal/integer column over its non-NULL count, as DOUBLE."""
    c = col(c)
    return F.sum(c).cast("double") / nullif0(F.count(c))


RATIO = "decimal(32,9)"


def exact_sum(c) -> Column:
    """Aggregate: order-free sum of a DOUBLE, each value taken to 9 decimals first."""
    return F.sum(col(c).cast(RATIO))


def ratio_mean(c) -> Column:
    """Aggregate: mean of a DOUBLE column (a ratio), as DOUBLE; NULL without values.

    The values are summed as 9-decimal fixed point and divided as decimals, so the bits of the
    result do not depend on how the rows were partitioned or in which order sums were merged."""
    return (exact_sum(c) / nullif0(F.count(col(c)))).cast("double")


def ratio_sd(c) -> Column:
    """Aggregate: population standard deviation of a DOUBLE of few decimals, from fixed-point sums
    of values (9 decimals) and squares (4 decimals: exact for values of two), free of order."""
    n, total = nullif0(F.count(col(c))).cast("double"), exact_sum(c).cast("double")
    squares = F.sum((dbl(c) * dbl(c)).cast("decimal(38,4)")).cast("double")
    return F.when(n.isNotNull(), F.sqrt(F.greatest((squares - total * total / n) / n, F.lit(0.0))))


def flag(cond: Column) -> Column:
    """0/1 integer flag (kept as an integer, never a boolean)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def count_where(cond: Column) -> Column:
    """Aggregate: BIGINT count of rows where ``cond`` holds."""
    return F.sum(flag(cond)).cast("bigint")


def dec_lit(x) -> Column:
    """Exact decimal literal (for fractions such as 0.20 that must not go through DOUBLE)."""
    return F.lit(Decimal(str(x)))


def pct_rounded_decimal(part, whole, scale: int = 2) -> Column:
    """100 * part / whole rounded HALF_UP in exact decimal arithmetic, as DECIMAL(5,2)."""
    num = F.lit(100).cast("decimal(3,0)") * col(part).cast("decimal(20,0)")
    den = nullif0(col(whole)).cast("decimal(20,0)")
    return F.round(num / den, scale).cast(PCT_DEC)
