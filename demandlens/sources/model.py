"""The five-table retail model and its declared schemas."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STORES_SCHEMA = T.StructType([
    T.StructField("store_nbr", T.ShortType(), False),
    T.StructField("city", T.StringType(), False),
    T.StructField("state", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("cluster", T.ByteType(), False),
])

TRAIN_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("store_nbr", T.ShortType(), False),
    T.StructField("family", T.StringType(), False),
    T.StructField("sales", T.DecimalType(14, 4), False),
    T.StructField("onpromotion", T.IntegerType(), False),
])

TRANSACTIONS_SCHEMA = T.StructType([
    T.StructField("date", T.DateType(), False),
    T.StructField("store_nbr", T.ShortType(), False),
    T.StructField("transactions", T.IntegerType(), False),
])

HOLIDAYS_SCHEMA = T.StructType([
    T.StructField("date", T.DateType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("locale", T.StringType(), False),
    T.StructField("locale_name", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("transferred", T.StringType(), False),
])

OIL_SCHEMA = T.StructType([
    T.StructField("date", T.DateType(), False),
    T.StructField("dcoilwtico", T.DecimalType(12, 4), True),
])

SCHEMAS = {
    "stores": STORES_SCHEMA,
    "train": TRAIN_SCHEMA,
    "transactions": TRANSACTIONS_SCHEMA,
    "holidays_events": HOLIDAYS_SCHEMA,
    "oil": OIL_SCHEMA,
}

# Declared keys, used by check_constraints (the store never enforces them).
PRIMARY_KEYS = {
    "stores": ["store_nbr"],
    "train": ["date", "store_nbr", "family"],   # business grain (UNIQUE); `id` is a surrogate
    "transactions": ["date", "store_nbr"],
    "oil": ["date"],
}
FOREIGN_KEYS = [
    ("train", "store_nbr", "stores", "store_nbr"),
    ("transactions", "store_nbr", "stores", "store_nbr"),
]
NOT_NULL = {
    "stores": ["store_nbr", "city", "state", "type", "cluster"],
    "train": ["date", "store_nbr", "family", "sales", "onpromotion"],
    "transactions": ["date", "store_nbr", "transactions"],
    "holidays_events": ["date", "type", "locale", "locale_name", "description", "transferred"],
    "oil": ["date"],
}


def in_months(month: Column, months) -> Column:
    """Whether ``month`` is one of ``months``, None included if it is there."""
    known = month.isin([m for m in months if m is not None])
    return known | month.isNull() if None in months else known


@dataclass
class Model:
    stores: DataFrame
    train: DataFrame
    transactions: DataFrame
    holidays: DataFrame
    oil: DataFrame
    origin: str = ""
    extra: dict = field(default_factory=dict)
    # Whether the tables should be written once before use: True when they are derived by a
    # plan (the test binding) or parsed from text (CSV); False for Parquet inputs, which are
    # already columnar files on durable storage (copying a large fact table would be waste).
    materialise: bool = True
    # The fact table with its month_start, where it was written in one folder a month.
    train_by_month: DataFrame | None = None

    def facts(self, months) -> DataFrame:
        """The facts of some months (first days; None for undated rows); of a table in folders only
        theirs are read."""
        if self.train_by_month is None:
            return self.train.filter(in_months(F.trunc("date", "MM"), months))
        return self.train_by_month.filter(in_months(F.col("month_start"), months)).select(*self.train.columns)

    def table(self, name: str) -> DataFrame:
        return {"stores": self.stores, "train": self.train, "transactions": self.transactions,
                "holidays_events": self.holidays, "oil": self.oil}[name]
