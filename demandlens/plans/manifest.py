"""The layer's manifest: which generation of a month's folder is the valid one, and fingerprints of
what each month was made from.

Folders are ``<root>/gen=<n>/month_start=<day>``. A refresh writes the changed months as a new
generation and lets the manifest name it; the other months stay where they are. The layer is read
by one scan of the live generations, with the live (generation, month) pairs as partition filter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.model import in_months

MONTH = "month_start"


@dataclass(frozen=True)
class Manifest:
    root: str
    months: dict          # month -> generation of its valid folder

    def generation(self) -> int:
        """The next unused one."""
        return max(self.months.values(), default=-1) + 1

    def folder(self, gen: int) -> str:
        return f"{self.root}/gen={gen}"

    def read(self, spark: SparkSession, schema) -> DataFrame:
        """The layer: one scan, whatever the number of refreshes."""
        columns, live = schema.names, sorted(set(self.months.values()))
        if not live:
            return spark.createDataFrame([], schema)
        if len(live) == 1:
            df = spark.read.schema(schema).parquet(self.folder(live[0]))
            every = self._written(spark, live[0])
            return (df if every <= set(self.months) else df.filter(in_months(F.col(MONTH), list(self.months)))).select(*columns)
        df = spark.read.schema(schema).option("basePath", self.root).parquet(*map(self.folder, live))
        valid = [(F.col("gen") == g) & in_months(F.col(MONTH), [m for m, n in self.months.items() if n == g]) for g in live]
        return df.filter(reduce(or_, valid)).select(*columns)

    def _listing(self, spark: SparkSession, path: str) -> list[str]:
        fs, at = _file_system(spark, path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _written(self, spark: SparkSession, gen: int) -> set:
        return {_month_of(n) for n in self._listing(spark, self.folder(gen)) if n.startswith(MONTH + "=")}

    def drop_dead(self, spark: SparkSession) -> list[str]:
        """Delete the folders that the manifest no longer names, and return their paths. Layers
        from before a refresh still read them: call it when those are no longer in use."""
        dead = []
        for name in self._listing(spark, self.root):
            gen = int(name.partition("=")[2])
            for month in self._written(spark, gen):
                if self.months.get(month, -1) != gen:
                    dead.append(f"{self.folder(gen)}/{MONTH}={_HIVE_NULL if month is None else month}")
        for path in dead:
            fs, at = _file_system(spark, path)
            fs.delete(at, True)
        return dead


_HIVE_NULL = "__HIVE_DEFAULT_PARTITION__"


def _month_of(folder: str):
    import datetime as dt
    value = folder.partition("=")[2]
    return None if value == _HIVE_NULL else dt.date.fromisoformat(value)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def fingerprints(tables: dict[str, DataFrame]) -> dict:
    """{(table, month): (rows, fingerprint, fingerprint)} of tables with a ``date``.

    A fingerprint is the exact sum of a 64-bit hash of every row, with NULLs marked: it depends on
    the rows and how often each is there, not on their order or files. Each task sends one row a
    month; the result is a row per table and month, as small as the calendar."""
    def one(name, df):
        cells = [c for col in df.columns for c in (F.col(col), F.col(col).isNull())]
        total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(20,0)"))
        return (df.groupBy(F.trunc("date", "MM").alias(MONTH))
                .agg(F.count(F.lit(1)).alias("n"), total(1).alias("a"), total(2).alias("b"))
                .select(F.lit(name).alias("name"), MONTH, "n", "a", "b"))
    found = reduce(DataFrame.unionByName, [one(n, df) for n, df in tables.items()])
    return {(r["name"], r[MONTH]): (r["n"], r["a"], r["b"]) for r in found.collect()}


def changed_months(old: dict, new: dict) -> set:
    """Months of which some table differs."""
    return {m for t, m in old.keys() | new.keys() if old.get((t, m)) != new.get((t, m))}
