"""Connected components by alternating large-star and small-star steps, in DataFrames.

Each step halves path lengths roughly, so a chain of a million links needs some twenty rounds.
Every round is written to the shared folder; nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's links as stars around their smallest node: as connected, with short paths."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = p
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        links = [(x, r) for x in parent if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()),
                                          pa.array([r for _, r in links], pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of every node of the links (a, b)."""
    edges = written(links.select("a", "b").mapInArrow(_forest, "a long, b long").distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").filter(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))))
        edges = written(small.filter(F.col("a") != F.col("b")).distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == now:
            break
        state = now
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
            .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()))
