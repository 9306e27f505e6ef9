"""Join helpers. Joins of the library carry no hints: the session's broadcast thresholds (see
``session.DEFAULT_CONF``) make the planner broadcast a side only when its statistics prove it
small, and AQE re-checks at run time; anything larger stays a shuffle join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrich_with_flag(left: DataFrame, right: DataFrame, on, value: str, out: str,
                     default=None, flag_col: str | None = None) -> DataFrame:
    """Left-join ``right.value`` onto ``left`` by ``on`` as ``out`` (``default`` when there is
    no match or the value is NULL) and, if asked, a 0/1 ``flag_col`` marking the rows whose
    value was missing. ``right`` must be unique on ``on`` (no fan-out)."""
    on = [on] if isinstance(on, str) else list(on)
    r = right.select(*on, F.col(value).alias("_enriched"))
    j = left.join(r, on, "left")
    v = F.col("_enriched")
    cols = [F.col(c) for c in left.columns]
    cols.append((F.coalesce(v, F.lit(default)) if default is not None else v).alias(out))
    if flag_col:
        cols.append(F.when(v.isNull(), F.lit(1)).otherwise(F.lit(0)).alias(flag_col))
    return j.select(*cols)
