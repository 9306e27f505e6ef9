"""Whole-table ranks without one task holding the table: one index for any number of ranks, one plan
at every size.

A rank over a global order is the number of rows in the buckets before the row's own, plus its
rank inside its bucket. Buckets are ranges between quantiles of the value (``PIECES`` of them);
each quantile value is a bucket of its own, so a frequent value never shares a bucket. Such a
one-valued bucket is dealt further: by ranges of the key where the key breaks ties (a text key by
its first bytes), else by a hash, since all its rows have the same rank. So a window holds about
1 / PIECES of the table.

``ranked`` reads the table three times, however many ranks it adds: one aggregate for the quantiles of
all columns, one for the rows of all buckets (each row offers its bucket of every rank), and the
result, with one window a rank. Quantiles and bucket sizes (at most (2 * PIECES + 1) ^ 2 rows a
rank) come to the driver and go back as a broadcast table of offsets.

Entity tables must be written (``sources.sink.write_table``) before they are ranked: the three reads
must see the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import nullif0

PIECES = 32
ACCURACY = 10_000


def ntile_of(rn: Column, n_rows: Column, k: int) -> Column:
    """NTILE(k) bucket of row number ``rn`` among ``n_rows`` rows: the first n_rows % k
    buckets hold one row more than the others."""
    q = n_rows / F.lit(k)
    q = F.floor(q).cast("bigint")
    r = n_rows - q * k
    big = r * (q + 1)
    return (F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1)
             .otherwise(r + F.floor((rn - big - 1) / nullif0(q)) + 1)).cast("int")


def sort_key(name: str, descending: bool = False, nulls_first: bool | None = None) -> Column:
    """Sort order on ``name``; NULLs first on ascending and last on descending unless said
    otherwise (Spark's and the source dialect's default)."""
    c = F.col(name)
    if nulls_first is None:
        nulls_first = not descending
    if descending:
        return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()


@dataclass(frozen=True)
class Rank:
    """Columns to add for one order: {name: kind} with kind 'rank' (RANK), 'dense' (DENSE_RANK), 'row'
    (ROW_NUMBER, equal values by ``tie_break`` ascending), 'percent' (PERCENT_RANK), 'n' (rows of
    the table) or a number k (NTILE(k), by row number)."""
    value: str
    out: dict = field(hash=False)
    descending: bool = False
    nulls_first: bool = True
    tie_break: str | None = None

    def order(self) -> list[Column]:
        return [sort_key(self.value, self.descending, self.nulls_first)] + ([F.col(self.tie_break).asc()] if self.tie_break else [])


def _scale(df: DataFrame, name: str) -> Column:
    """A column whose order is the column's own, as far as quantiles need it: a text counts by the
    number that its first seven bytes are."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.conv(F.hex(F.rpad(F.substring(F.col(name).cast("binary"), 1, 7), 7, F.lit(b"\0"))), 16, 10).cast("long")
    return F.col(name)


def _bounds(df: DataFrame, cols: list[str]) -> dict[str, list]:
    """Ascending quantiles of every column (values of the columns themselves), in one aggregate."""
    at = F.array(*[F.lit(i / PIECES) for i in range(1, PIECES)])
    row = df.agg(*[F.percentile_approx(_scale(df, c), at, F.lit(ACCURACY)).alias(f"q{k}") for k, c in enumerate(cols)]).first()
    return {c: sorted(set(row[k] or ())) for k, c in enumerate(cols)}


def _bucket(value: Column, bounds: list, kind: T.DataType) -> Column:
    """Ascending bucket number: even between two bounds, odd on a bound, NULL for NULL."""
    # one literal that the optimizer folds to an array, whatever the number of bounds
    bounds = F.split(F.lit(",".join(map(str, bounds))), ",").cast(T.ArrayType(kind)) if bounds else F.array().cast(T.ArrayType(kind))
    below = F.size(F.filter(bounds, lambda b: b < value))
    return F.when(value.isNotNull(), 2 * below + F.array_contains(bounds, value).cast("int"))


def _tags(df: DataFrame, k: int, rank: Rank, bounds: dict[str, list]) -> dict[str, Column]:
    """Bucket and deal of a row in rank number k."""
    def bucket(name: str) -> Column:
        kind = df.schema[name].dataType
        return _bucket(_scale(df, name), bounds[name], T.LongType() if isinstance(kind, T.StringType) else kind)

    b = bucket(rank.value)
    deal = (F.coalesce(bucket(rank.tie_break), F.lit(-1)) if rank.tie_break
            else F.pmod(F.hash(*[F.col(c) for c in df.columns]), F.lit(PIECES)))
    return {f"_b{k}": b, f"_s{k}": F.when(b.isNull() | (b % 2 == 1), deal).otherwise(F.lit(0))}


def _sizes(t: DataFrame, ranks: list[Rank]) -> list:
    """Rows, distinct values and whether they are NULL, of every (rank, bucket, deal): one pass."""
    entries = []
    for k, r in enumerate(ranks):
        v = F.col(r.value)
        # distinct values count only for dense ranks; 0.0 and -0.0 are one value
        v = F.when(v == 0, F.lit("0")).otherwise(v.cast("string")) if "dense" in r.out.values() else F.lit(None).cast("string")
        entries.append(F.struct(F.lit(k).alias("k"), F.col(f"_b{k}").alias("b"), F.col(f"_s{k}").alias("s"), v.alias("v")))
    each = t.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs.append(F.count_distinct("v").alias("d") if any("dense" in r.out.values() for r in ranks) else F.lit(0).alias("d"))
    return each.groupBy("k", "b", "s").agg(*aggs).collect()


def _offsets(rank: Rank, sizes: list) -> tuple[pa.Table, int]:
    """Rows and distinct values before each bucket (and deal, where a key orders equal values)."""
    places: dict = {}
    for r in sizes:
        key = (r["b"], r["s"] if rank.tie_break else 0)
        n, d = places.get(key, (0, 0))
        one_valued = r["b"] is None or r["b"] % 2 == 1
        places[key] = n + r["n"], 1 if one_valued else d + r["d"]
    sign = -1 if rank.descending else 1
    null_at = -1 if rank.nulls_first else 1
    rows, n, d = [], 0, 0
    for b, s in sorted(places, key=lambda p: (null_at if p[0] is None else 0, sign * (p[0] or 0), p[1])):
        rows.append((b, s, n, d))
        n, d = n + places[b, s][0], d + places[b, s][1]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["b", "s", "n", "d"]), n


def ranked(df: DataFrame, ranks: list[Rank]) -> DataFrame:
    """``df`` (a settled table) with the columns of every rank."""
    names = list(dict.fromkeys(c for r in ranks for c in (r.value, r.tie_break) if c))
    bounds = _bounds(df, names)
    t = df
    for k, r in enumerate(ranks):
        t = t.withColumns(_tags(df, k, r, bounds))
    sizes = _sizes(t, ranks)
    added = []
    for k, r in enumerate(ranks):
        table, total = _offsets(r, [x for x in sizes if x["k"] == k])
        offsets = df.sparkSession.createDataFrame(table).toDF(f"_ob{k}", f"_os{k}", f"_n{k}", f"_d{k}")
        deal = F.col(f"_s{k}") if r.tie_break else F.lit(0)
        t = t.join(F.broadcast(offsets), F.col(f"_b{k}").eqNullSafe(F.col(f"_ob{k}")) & (deal == F.col(f"_os{k}")))
        w = Window.partitionBy(f"_b{k}", f"_s{k}").orderBy(*r.order())
        for name, kind in r.out.items():
            row = F.col(f"_n{k}") + F.row_number().over(w)
            rank = F.col(f"_n{k}") + F.rank().over(w)
            made = {"rank": rank, "dense": (F.col(f"_d{k}") + F.dense_rank().over(w)).cast("int"), "row": row.cast("int"),
                    "n": F.lit(total).cast("long"),
                    "percent": (rank - 1).cast("double") / F.lit(float(total - 1)) if total > 1 else F.lit(0.0)}
            added.append((ntile_of(row, F.lit(total).cast("long"), kind) if isinstance(kind, int) else made[kind]).alias(name))
    return t.select(*df.columns, *added)


def row_numbers(df: DataFrame, value: str, tie_break: str, out: str, total: str | None = None,
                descending: bool = False) -> DataFrame:
    """ROW_NUMBER by ``value``, then ``tie_break`` (a unique key) ascending; optionally the row count."""
    return ranked(df, [Rank(value, {out: "row"} | ({total: "n"} if total else {}), descending, not descending, tie_break)])


def ntiles(df: DataFrame, k: int, value: str, tie_break: str, out: str, descending: bool = False) -> DataFrame:
    return ranked(df, [Rank(value, {out: k}, descending, not descending, tie_break)])


def dense_ranks(df: DataFrame, value: str, out: str, descending: bool = False) -> DataFrame:
    """DENSE_RANK by ``value``; NULLs first ascending and last descending."""
    return ranked(df, [Rank(value, {out: "dense"}, descending, not descending)])


def percent_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """PERCENT_RANK by ``value`` ascending, NULLs first: (rank - 1) / (n - 1)."""
    return ranked(df, [Rank(value, {out: "percent"})])
