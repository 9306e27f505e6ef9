"""Source connector for the store-sales data in its published layout.

Five files (``stores``, ``train``, ``transactions``, ``holidays_events``, ``oil``) as CSV
with a header, or as Parquet. Schemas are always declared, never inferred.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .model import SCHEMAS, Model

TABLES = ("stores", "train", "transactions", "holidays_events", "oil")


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "csv"):
    schema = SCHEMAS[name]
    if fmt == "csv":
        # Read text columns as declared; nullable on read because files carry no NOT NULL
        # guarantee (check_constraints reports violations instead of failing the scan).
        reader = spark.read.option("header", True).option("mode", "FAILFAST")
        df = reader.schema(schema).csv(f"{path}/{name}.csv")
    else:
        df = spark.read.parquet(f"{path}/{name}.parquet")
        df = df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return df


def read_retail(spark: SparkSession, path: str, fmt: str = "csv") -> Model:
    t = {n: read_table(spark, path, n, fmt) for n in TABLES}
    return Model(stores=t["stores"], train=t["train"], transactions=t["transactions"],
                 holidays=t["holidays_events"], oil=t["oil"], origin=f"retail:{path}",
                 materialise=(fmt == "csv"))
