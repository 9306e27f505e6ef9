"""Ordered scans of one long series without one task holding it: forward fill and windows that look a
bounded number of rows back, over a global order or over series one of which may be hot.

The order is cut at quantiles of the key into segments. What a segment needs from before it is
little: for a fill the last known value, for a window of n rows a halo of the n rows before it.
Both come from segment summaries (one row a segment and series). Rows are shuffled once, by
segment; no task holds more than a segment of a series and its halo.

Segments follow the key's values, so equal keys share one. A text key is cut by its first seven
bytes. The order within a series must be unique for a defined result, as for any window by rows;
a NULL key sorts first. The quantiles are read once and become constants of the plan, so every
later read cuts alike. Names that start with ``scan__`` are internal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import ACCURACY, _scale

SEGMENTS = 32
SEG, CARRY, START, ROWS, NEXT, TAIL, HALO = (f"scan__{x}" for x in ("seg", "carry", "start", "rows", "next", "tail", "halo"))


def _position(df: DataFrame, order_by: str) -> Column:
    """A number, date or the like whose order is the key's."""
    if isinstance(df.schema[order_by].dataType, T.TimestampType):
        return F.unix_micros(order_by)
    return _scale(df, order_by)


def cut(df: DataFrame, order_by: str, segments: int = SEGMENTS) -> DataFrame:
    """``df`` with the ascending number of each row's segment (``SEG``)."""
    at = F.array(*[F.lit(i / segments) for i in range(1, segments)]) if segments > 1 else None
    position = _position(df, order_by)
    found = df.agg(F.percentile_approx(position, at, F.lit(ACCURACY))).first()[0] if segments > 1 else None
    bounds = sorted(set(found or ()))
    if not bounds:
        return df.withColumn(SEG, F.lit(0))
    below = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < position))
    return df.withColumn(SEG, F.when(position.isNull(), F.lit(0)).otherwise(below))


def _same(left: DataFrame, right: DataFrame, keys) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right["scan__" + k])
    return cond


def _renamed(df: DataFrame, keys) -> DataFrame:
    return df.withColumnsRenamed({k: "scan__" + k for k in keys})


def fill(df: DataFrame, value: str, order_by: str, out: str, partition_by=(), segments: int = SEGMENTS) -> DataFrame:
    """Last non-NULL ``value`` at or before each row, in the order of ``order_by``, as column ``out``.

    Without ``partition_by`` the last known values (one a segment) come to the driver and become a
    constant array, so the plan stays a projection and a window over the input; with it, the
    summaries are joined by (series, segment)."""
    t = cut(df, order_by, segments)
    v, k = F.col(value), F.col(order_by)
    last = F.coalesce(F.max_by(v, F.when(v.isNotNull(), k)), F.first(F.when(k.isNull(), v), ignorenulls=True))
    known = t.groupBy(*partition_by, SEG).agg(last.alias(CARRY))
    if partition_by:
        before = Window.partitionBy(*partition_by).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
        keys = [*partition_by, SEG]
        carried = _renamed(known.withColumn(CARRY, F.last(CARRY, ignorenulls=True).over(before)), keys)
        t = t.join(carried, _same(t, carried, keys), "left").drop(*["scan__" + x for x in keys])
    else:
        lasts, carries, seen = {r[SEG]: r[CARRY] for r in known.collect()}, [], None    # a row a segment
        for s in range(max(lasts, default=0) + 1):
            carries.append(seen)
            seen = seen if lasts.get(s) is None else lasts[s]
        kind = df.schema[value].dataType
        t = t.withColumn(CARRY, F.get(F.array(*[F.lit(c).cast(kind) for c in carries]), F.col(SEG)))
    own = Window.partitionBy(*partition_by, SEG).orderBy(order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.coalesce(F.last(v, ignorenulls=True).over(own), F.col(CARRY))
    return t.withColumn(out, filled).drop(SEG, CARRY)


def look_back(df: DataFrame, order_by: str, back: int, columns: dict[str, Callable], partition_by=(),
              segments: int = SEGMENTS) -> DataFrame:
    """Columns {name: function of a window} over windows that reach at most ``back`` rows back, such as
    ``lambda w: F.lag("x", 12).over(w)`` (back=12). The window is ordered and may be given a rows frame.

    The last ``back`` rows of a segment are copied to each later segment that has them in its halo: at
    most ``back`` rows a segment and series, taken before the shuffle."""
    t = cut(df, order_by, segments)
    keys = [*partition_by, SEG]
    series = Window.partitionBy(*partition_by).orderBy(SEG)      # segments of a series, not its rows
    places = t.groupBy(*keys).agg(F.count(F.lit(1)).alias(ROWS)).withColumn(
        START, F.coalesce(F.sum(ROWS).over(series.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # no segment is empty, so at most ``back`` later ones can reach into this one
    places = places.withColumn(NEXT, F.collect_list(F.struct(START, SEG)).over(series.rowsBetween(1, max(1, back))))
    places = _renamed(places, keys)
    key = F.col(order_by)
    tails = (t.withColumn(TAIL, F.row_number().over(Window.partitionBy(*keys).orderBy(key.desc_nulls_last())))
             .filter(F.col(TAIL) <= back))
    position = F.col(START) + F.col(ROWS) - F.col(TAIL) + 1
    tails = tails.join(places, _same(tails, places, keys))
    reach = F.filter(NEXT, lambda s: s[START] < position + back)
    halo = (tails.withColumn(SEG, F.explode(F.transform(reach, lambda s: s[SEG])))
            .select(*df.columns, SEG, F.lit(True).alias(HALO)))
    own = Window.partitionBy(*keys).orderBy(order_by)
    both = t.withColumn(HALO, F.lit(False)).unionByName(halo)
    return (both.withColumns({name: made(own) for name, made in columns.items()})
            .filter(~F.col(HALO)).drop(SEG, HALO))
