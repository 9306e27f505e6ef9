"""Data-quality operators: coverage and contradiction audits over the store-day layer and
the declared-constraint checks the source tables never enforce."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col, count_where, flag, money_out, nullif0, rnd
from ..sources.model import FOREIGN_KEYS, NOT_NULL, PRIMARY_KEYS, Model


def with_distinct_counts(df: DataFrame, sums: dict, distinct: dict) -> DataFrame:
    """One row: the ``sums`` {out: column to add} and exact distinct counts {out: integer column},
    NULLs not counted.

    A task sets one bit a value, in bitmaps of 32,768 values (4 KB) by bucket of the columns; the
    bitmaps are merged by bucket and counted. So a row is read once however many columns are
    counted, and what is shuffled is a few bitmaps a task and not its distinct values. Any 64-bit
    value has its own bit; values far apart take a bitmap each."""
    value = {out: col(c).cast("bigint") for out, c in distinct.items()}
    buckets = {out: F.bitmap_bucket_number(v).alias("_b_" + out) for out, v in value.items()}
    bits = [F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("_m_" + out) for out, v in value.items()]
    local = df.groupBy(*buckets.values()).agg(*bits, *[F.sum(c).alias(out) for out, c in sums.items()])
    # the few (bucket, bitmap) pairs in one column; the sums stay with the first
    types = dict(local.dtypes)
    own = lambda k, out: F.col(out) if k == 0 else F.lit(None).cast(types[out])
    pairs = F.array(*[F.struct(F.lit(k).alias("_k"), F.col("_b_" + out).alias("_b"), F.col("_m_" + out).alias("_m"),
                               *[own(k, s).alias(s) for s in sums]) for k, out in enumerate(distinct)])
    merged = (local.select(F.explode(pairs).alias("e")).select("e.*").groupBy("_k", "_b")
              .agg(F.bitmap_count(F.bitmap_or_agg("_m")).alias("_n"), *[F.sum(s).alias(s) for s in sums]))
    return merged.agg(*[F.coalesce(F.sum(F.when(F.col("_k") == k, F.col("_n"))), F.lit(0)).cast("bigint").alias(out)
                        for k, out in enumerate(distinct)], *[F.sum(s).alias(s) for s in sums])


def coverage_audit(ctx: DataFrame) -> DataFrame:
    counted = with_distinct_counts(
        ctx, {"rows": F.lit(1), "revenue": F.col("total_sales"), "no_tx": flag(F.col("missing_transactions_flag") == 1),
              "no_oil": flag(F.col("missing_oil_flag") == 1), "no_sales": flag(F.col("total_sales") == 0)},
        {"days": F.unix_date("date"), "stores": "store_nbr"})
    n = F.coalesce("rows", F.lit(0)).cast("bigint")
    share = lambda c: rnd(F.lit(100.0) * F.col(c) / nullif0(n), 2)
    return counted.select(
        n.alias("store_day_rows"),
        F.col("days").alias("calendar_days"),
        F.col("stores").alias("stores_covered"),
        money_out("revenue").alias("total_revenue"),
        F.col("no_tx").alias("missing_transaction_store_days"),
        share("no_tx").alias("missing_transaction_pct"),
        F.col("no_oil").alias("missing_oil_store_days"),
        share("no_oil").alias("missing_oil_pct"),
        F.col("no_sales").alias("zero_sales_store_days"))


def contradiction_audit(ctx: DataFrame) -> DataFrame:
    s, tx = F.col("total_sales"), F.col("transactions")
    return ctx.agg(
        F.count(F.lit(1)).alias("total_store_days"),
        count_where(s < 0).alias("negative_revenue_store_days"),
        count_where((s > 0) & (tx == 0)).alias("sales_without_transactions_store_days"),
        count_where((s == 0) & (tx > 0)).alias("traffic_without_sales_store_days"),
        count_where((F.col("promo_family_mix_pct") >= 50) & (s == 0))
         .alias("heavy_promo_zero_sales_store_days"),
        count_where((s > 0) & F.col("sales_per_transaction").isNull())
         .alias("unscorable_basket_quality_store_days"))


def _rules(model: Model) -> list[tuple]:
    """(table, rule, kind, key columns, parent table, parent column) of every declared rule."""
    rules = [(t, f"unique({','.join(k)})", "unique", k, None, None) for t, k in PRIMARY_KEYS.items()]
    rules.append(("holidays_events", "duplicate rows", "duplicate", model.holidays.columns, None, None))
    rules += [(c, f"{ck} -> {p}.{pk}", "foreign", [ck], p, pk) for c, ck, p, pk in FOREIGN_KEYS]
    has_id = "id" in model.train.columns          # the surrogate key, where the source has it
    if has_id:
        rules.append(("train", "unique(id)", "unique_known", ["id"], None, None))
    for t, cols in NOT_NULL.items():
        rules += [(t, f"not_null({c})", "not_null", [c], None, None) for c in (["id"] if t == "train" and has_id else []) + cols]
    return rules


def check_constraints(model: Model) -> DataFrame:
    """One row per declared rule: (table_name, rule, violations).

    * key rules: number of key values that occur more than once (``holidays_events`` has
      no key, so whole duplicate rows are counted there),
    * foreign keys: child rows whose key has no parent,
    * NOT NULL: NULL count per column.

    Every table is read once, and its rows are grouped by its unique key (``holidays_events``: by the
    whole row) where they are shuffled to, not before: a task's share of a key that hardly repeats
    is as long as its rows, and would be held as groups for nothing. For the same reason those
    partitions are not merged. A NULL where there may be none is a row of its own, spread by task.
    The groups then offer their foreign keys, as child or as parent, and what their own rule finds;
    these are few, and are added up before they are shuffled."""
    rules = _rules(model)
    # the column of a table's key that a foreign key compares, as child or as parent
    linked = {c: ck for c, ck, _, _ in FOREIGN_KEYS} | {p: pk for _, _, p, pk in FOREIGN_KEYS}
    unique = {t: next(i for i, r in enumerate(rules) if r[:3:2] == (t, "unique")) for t in linked}
    none, zero, one = F.lit(None).cast("string"), F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    entry = lambda k, link, rest: F.struct(F.lit(k).alias("k"), link.alias("link"), rest.alias("rest"))
    offers: dict[str, list] = {}
    for k, (table, _, kind, cols, _, _) in enumerate(rules):
        if kind == "not_null":
            offer = F.when(F.col(cols[0]).isNull(), entry(k, none, F.spark_partition_id().cast("string")))
        elif kind == "unique" and table in linked:
            offer = entry(k, F.col(linked[table]).cast("string"), _text([c for c in cols if c != linked[table]]))
        elif kind != "foreign":
            offer = entry(k, none, _text(cols))
            if kind == "unique_known":
                offer = F.when(F.col(cols[0]).isNotNull(), offer)
        else:
            continue
        offers.setdefault(table, []).append(offer)
    rows = reduce(DataFrame.unionByName, [
        model.table(t).select(F.explode(F.array_compact(F.array(*own))).alias("e")).select("e.*")
        for t, own in offers.items()])
    partitions = int(model.train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = (rows.repartition(partitions, "k", "link", "rest").groupBy("k", "link", "rest")
              .agg(F.count(F.lit(1)).alias("n")))

    k, n, link = F.col("k"), F.col("n"), F.col("link")
    kinds = {kind: [i for i, r in enumerate(rules) if r[2].startswith(kind)] for kind in ("unique", "duplicate")}
    own_finding = F.when(k.isin(kinds["unique"]), flag(n > 1).cast("bigint")).when(k.isin(kinds["duplicate"]), n - 1).otherwise(n)
    found = lambda k, key, here, there: F.struct(k.alias("k"), key.alias("key"), here.alias("here"), there.alias("there"))
    made = [F.when(own_finding > 0, found(k, none, own_finding, zero))]
    for i, (table, _, kind, _, parent, _) in enumerate(rules):
        if kind == "foreign":       # a NULL parent key is nobody's parent
            made.append(F.when(k == unique[table], found(F.lit(i), link, n, zero)))
            made.append(F.when((k == unique[parent]) & link.isNotNull(), found(F.lit(i), link, zero, one)))
    keys = (groups.select(F.explode(F.array_compact(F.array(*made))).alias("e")).select("e.*")
            .groupBy("k", "key").agg(F.sum("here").alias("here"), F.max("there").alias("there")))
    bad = F.when(F.col("there") == 0, F.col("here"))
    total = keys.agg(*[F.sum(F.when(k == i, bad)).alias(f"_{i}") for i in range(len(rules))])
    report = F.array(*[F.struct(F.lit(r[0]).alias("table_name"), F.lit(r[1]).alias("rule"),
                                F.coalesce(F.col(f"_{i}"), zero).alias("violations")) for i, r in enumerate(rules)])
    return total.select(F.explode(report).alias("e")).select("e.*")


def _text(cols: list[str]) -> Column:
    """The values as one text, each after its length: different values never give the same text."""
    parts = [F.col(c).cast("string") for c in cols]
    if len(parts) == 1:
        return parts[0]
    return F.concat(F.lit(""), *[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts])
