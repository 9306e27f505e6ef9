"""Calendar attributes of a DATE column, all JVM-side built-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import col, flag


def month_start(d) -> Column:
    """First day of the month as a DATE (``trunc`` keeps DATE; ``date_trunc`` would not)."""
    return F.trunc(col(d), "MM")


def weekday_num(d) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(col(d))


def month_label(d) -> Column:
    """'yyyy-MM' text."""
    return F.date_format(col(d), "yyyy-MM")


def date_parts(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Add month_start, year_num, month_num, month_name (full English name), weekday_num
    (Monday = 0), weekday_name and is_weekend (Saturday/Sunday -> 1)."""
    d = F.col(date_col)
    return df.withColumns({
        "month_start": month_start(d),
        "year_num": F.year(d),
        "month_num": F.month(d),
        "month_name": F.date_format(d, "MMMM"),
        "weekday_num": weekday_num(d),
        "weekday_name": F.date_format(d, "EEEE"),
        "is_weekend": flag(weekday_num(d).isin(5, 6)),
    })
