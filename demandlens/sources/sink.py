"""Written tables: the lineage cut every layer and large intermediate goes through, and the month
layout of the large ones."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

TASK_ROWS = 500_000     # rows of small folders that share a writing task


def write_table(df: DataFrame, spark: SparkSession, name: str, sort_by=(),
                partition_col: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back: cuts the
    lineage (an executor lost later re-reads files instead of recomputing the plan) and
    gives later queries column pruning and row-group skipping on ``sort_by``.

    With ``partition_col`` the table is laid out in one folder per value (directory pruning). The
    rows are first rebalanced on it: the shuffle's measured sizes decide how many tasks a value
    gets, so a folder's files are near the session's advisory partition size whatever it holds."""
    path = scratch_path(spark, name)
    w = df.hint("rebalance", partition_col) if partition_col else df
    w = w.sortWithinPartitions(*sort_by) if sort_by else w
    writer = w.write.mode("overwrite")
    if partition_col:
        writer = writer.partitionBy(partition_col)
    writer.parquet(path)
    return read_table(spark, path, df.schema)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*[f.name for f in schema.fields])


def deal(counts: dict, rows_per_file: int, parallelism: int) -> tuple[dict, int]:
    """Writers for a table in folders: {value: (first task, tasks)} and the number of tasks.

    A value of more than ``rows_per_file`` rows gets one task for each such run of rows. Smaller
    ones share a task, in order, as long as that leaves ``parallelism`` tasks to do."""
    share = max(1, min(rows_per_file, -(-sum(counts.values()) // max(1, parallelism))))
    plan, task, held = {}, 0, 0
    for value in sorted(counts, key=lambda v: (v is not None, v)):
        own = -(-counts[value] // rows_per_file)
        if held and (own > 1 or held + counts[value] > share):
            task, held = task + 1, 0
        plan[value] = (task, max(1, own))
        if own > 1:
            task += own
        else:
            held += counts[value]
    return plan, task + bool(held)


def write_dealt(df: DataFrame, spark: SparkSession, path: str, partition_col: str, counts: dict,
                rows_per_file: int, key=(), sort_by=(), widen=None) -> None:
    """Write ``df`` under ``path`` in one folder per value of ``partition_col``. ``counts`` (rows per
    value, or a bound of them) sets the tasks of each folder, see ``deal``; within a folder a hash
    of ``key`` (unique columns) deals the rows, so no single key can load one task.

    ``widen`` adds what need not be shuffled: columns of the row itself and of small tables. Small
    folders share a task up to ``TASK_ROWS`` rows, so that a task sorts its rows in memory."""
    busy = max(spark.sparkContext.defaultParallelism, sum(counts.values()) // TASK_ROWS)
    plan, tasks = deal(counts, rows_per_file, busy)
    schema = pa.schema([("_value", pa.date32()), ("_first", pa.int32()), ("_tasks", pa.int32())])
    rows = pa.table([list(plan), [t for t, _ in plan.values()], [n for _, n in plan.values()]], schema=schema)
    own = spark.createDataFrame(rows)            # a row a folder: the planner knows its size
    slot = F.coalesce(F.col("_first") + F.pmod(F.xxhash64(*key), F.col("_tasks").cast("bigint")).cast("int"), F.lit(0))
    dealt = (df.join(own, df[partition_col].eqNullSafe(own["_value"]), "left")
             .repartitionById(max(1, tasks), slot).select(*df.columns))
    wide = widen(dealt) if widen else dealt
    wide.sortWithinPartitions(partition_col, *sort_by).write.mode("overwrite").partitionBy(partition_col).parquet(path)
