"""Binding of the retail model onto the driver's TPC-H-style test tables.

stores <- supplier/nation/region, train <- lineitem x part, transactions <- lineitem x orders,
oil <- orders, holidays_events <- calendar years of lineitem x fixed/regional/local rules.
Every table grows with the inputs it is derived from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import MONEY, PRICE, dbl
from .model import Model

# Fixed values of the test binding: the national calendar rows generated for every year
# (month, day, type, description, transferred).
NATIONAL_DAYS = [
    (1, 1, "Holiday", "New Year", "False"),
    (5, 1, "Holiday", "Labour Day", "False"),
    (12, 25, "Holiday", "Christmas", "False"),
    (12, 26, "Bridge", "Christmas bridge", "False"),
    (11, 24, "Event", "Black Friday", "False"),
    (1, 8, "Work Day", "Make-up day", "False"),
    (8, 10, "Holiday", "Independence Day", "True"),
    (8, 11, "Transfer", "Independence Day (observed)", "False"),
]
NATIONAL_LOCALE_NAME = "Everywhere"


def _reader(spark: SparkSession, sf_dir: str):
    """One DataFrame per raw table (each is scanned by several derived tables; reading the
    footer once keeps planning to one schema lookup per file)."""
    cache: dict = {}

    def read(name: str) -> DataFrame:
        if name not in cache:
            cache[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return cache[name]
    return read


def bind_stores(read) -> DataFrame:
    s = read("supplier").select("s_suppkey", "s_nationkey")
    n = read("nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read("region").select("r_regionkey", "r_name")
    return (s.join(n, s.s_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("s_suppkey").alias("store_nbr"),
                    F.col("n_name").alias("city"),
                    F.col("r_name").alias("state"),
                    F.expr("chr(CAST(65 + s_suppkey % 5 AS INT))").alias("type"),
                    (F.col("s_suppkey") % 17 + 1).cast("int").alias("cluster")))


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys that hardly repeat, to be grouped where they arrive: groups held by the
    tasks that scan would be as many as their rows. The partitions are not merged, for their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def bind_train(read) -> DataFrame:
    li = read("lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
                                 "l_returnflag", "l_discount")
    p = read("part").select("p_partkey", "p_brand")
    sales = F.when(F.col("l_returnflag") == "R", F.lit(0).cast(MONEY)) \
             .otherwise(F.col("l_extendedprice").cast(MONEY))
    sold = (li.join(p, li.l_partkey == p.p_partkey)
            .select(F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("store_nbr"),
                    F.col("p_brand").alias("family"), sales.alias("sales"),
                    F.when(F.col("l_discount") >= 0.07, 1).otherwise(0).alias("onpromotion")))
    return (_dealt(sold, "date", "store_nbr", "family").groupBy("date", "store_nbr", "family")
            .agg(F.sum("sales").cast(MONEY).alias("sales"), F.sum("onpromotion").cast("int").alias("onpromotion")))


def bind_transactions(read) -> DataFrame:
    li = read("lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    o = read("orders").filter(F.col("o_orderstatus") != "P").select("o_orderkey")
    # Only existence in non-pending orders matters for a distinct count: a semi join.
    ordered = (li.join(o, li.l_orderkey == o.o_orderkey, "left_semi")
               .select(F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("store_nbr"), "l_orderkey"))
    return (_dealt(ordered, "date", "store_nbr", "l_orderkey").groupBy("date", "store_nbr")
            .agg(F.count_distinct("l_orderkey").cast("int").alias("transactions")))


def bind_oil(read) -> DataFrame:
    o = read("orders").select(F.col("o_orderdate").cast("date").alias("d"),
                              F.col("o_totalprice").cast(MONEY).alias("p"))
    price = F.round(dbl(F.sum("p")) / F.count(F.lit(1)) / 4000, 4).cast(PRICE)
    return (o.filter(F.weekday("d") < 5)
            .groupBy("d")
            .agg(price.alias("price"))
            .select(F.col("d").alias("date"),
                    F.when(F.dayofmonth("d") != 15, F.col("price")).cast(PRICE).alias("dcoilwtico")))


def bind_holidays(spark: SparkSession, read) -> DataFrame:
    # Distinct calendar years of the fact table, as one small array (bounded by the calendar).
    years = (read("lineitem").select(F.year("l_shipdate").cast("int").alias("y")).distinct()
             .agg(F.array_sort(F.collect_set("y")).alias("ys")).scalar())
    fixed = spark.createDataFrame(NATIONAL_DAYS, "m int, dd int, ty string, de string, tr string")
    national = (fixed.select("*", F.explode(years).alias("y"))
                .select(F.make_date("y", "m", "dd").alias("date"), F.col("ty").alias("type"),
                        F.lit("National").alias("locale"),
                        F.lit(NATIONAL_LOCALE_NAME).alias("locale_name"),
                        F.col("de").alias("description"), F.col("tr").alias("transferred")))
    region = read("region").select("r_regionkey", "r_name", F.explode(years).alias("y"))
    regional = region.select(
        F.make_date("y", F.col("r_regionkey") + 2, F.lit(15)).alias("date"),
        F.lit("Holiday").alias("type"), F.lit("Regional").alias("locale"),
        F.col("r_name").alias("locale_name"),
        F.concat(F.lit("Founding of "), "r_name").alias("description"),
        F.lit("False").alias("transferred"))
    nation = read("nation").select("n_nationkey", "n_name", F.explode(years).alias("y"))
    local = nation.select(
        F.make_date("y", F.col("n_nationkey") % 12 + 1, F.col("n_nationkey") % 25 + 1).alias("date"),
        F.lit("Holiday").alias("type"), F.lit("Local").alias("locale"),
        F.col("n_name").alias("locale_name"),
        F.concat(F.lit("Foundation of "), "n_name").alias("description"),
        F.lit("False").alias("transferred"))
    parades = nation.filter(F.col("n_nationkey") % 5 == 0).select(
        F.make_date("y", F.lit(5), F.lit(1)).alias("date"),
        F.lit("Event").alias("type"), F.lit("Local").alias("locale"),
        F.col("n_name").alias("locale_name"),
        F.concat(F.lit("Parade in "), "n_name").alias("description"),
        F.lit("False").alias("transferred"))
    return national.unionByName(regional).unionByName(local).unionByName(parades)


def bind_tpch(spark: SparkSession, sf_dir: str) -> Model:
    """Lazy binding (nothing is computed until an action)."""
    read = _reader(spark, sf_dir)
    return Model(stores=bind_stores(read), train=bind_train(read),
                 transactions=bind_transactions(read), holidays=bind_holidays(spark, read),
                 oil=bind_oil(read), origin=f"tpch:{sf_dir}")
