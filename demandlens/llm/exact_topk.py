"""Exact top-k search on integer vectors by exhaustive term-at-a-time accumulation.

A component x becomes floor(scale * x); a vector is the list of its components that are not 0.
Vectors are written once as such sparse rows. A task holds a unit of candidates of bounded size
as posting lists (for each component: places and weights) and streams all query rows past it: for
each component of a group of queries the posting list, times the queries' weights, is added to
the places of a dense score array. Every score is exact; a partition of the array selects
each query's best, and the short lists of all units are merged by query.

Work is (queries x candidates x components), as an exhaustive search has it; queries are read by
each unit from the shared folder, so neither they nor the candidates are copied through a
shuffle per query, and only k entries a (unit, query) are shuffled.

Defined cases: vectors that are null or hold null or non-finite components, and rows without vec_id,
take no part; an empty or zero vector does (score 0); vectors of other lengths are compared on the
components both have; integers saturate at +-2^26, so that sums stay exact; rows with equal vec_id
are one candidate if their vectors are equal, else each is one, and none is a candidate of its own
vec_id; a repeated query row counts once, of different vectors under one query id the first in the order
of its sparse rows; with fewer than k candidates all are found; an empty table gives no
rows; only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.session import scratch_path

from .common import file_system, written

#: Components of a unit (a task holds its posting lists), and scores of a dense array.
UNIT, SCORES = 1 << 22, 1 << 22
QUERIES = 128
LIMIT = 1 << 26


def sparse_rows(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, at (components that are not 0), weight (their integers) of the rows that take part."""
    x = F.col("embedding")
    whole = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    number = F.transform(x, lambda v: F.greatest(F.least(F.floor(F.lit(float(scale)) * v.cast("double")), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    made = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))
            .filter(F.col("vec_id").isNotNull() & whole).select("vec_id", number.alias("n")))
    entries = F.filter(F.transform("n", lambda v, i: F.struct(i.alias("at"), v.alias("weight"))), lambda e: e["weight"] != 0)
    return (made.distinct().withColumn("e", entries)
            .select("vec_id", F.col("e.at").alias("at"), F.col("e.weight").alias("weight")))


class Postings:
    """Posting lists of a unit of candidates in ascending order of vec_id."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, at: np.ndarray, weight: np.ndarray):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int32)
        place[order] = np.arange(len(ids), dtype=np.int32)
        of = np.repeat(place, sizes)
        by = np.lexsort((of, at))
        self.ids, self.place, self.weight = ids[order], of[by], weight[by].astype(np.int64)
        self.terms, begin = np.unique(at[by], return_index=True)
        self.begin = np.append(begin, len(by))

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Dense scores [candidate, query]; ``weights`` is [term, query]."""
        out = np.zeros((len(self.ids), weights.shape[1]), np.int64)
        for k in np.flatnonzero(np.isin(terms, self.terms)):
            at = np.searchsorted(self.terms, terms[k])
            own = slice(self.begin[at], self.begin[at + 1])
            having = np.flatnonzero(weights[k])
            posted = self.weight[own][:, None] * weights[k][having]
            if len(having) == out.shape[1]:
                out[self.place[own]] += posted          # a candidate is once in a posting list
            else:
                out[np.ix_(self.place[own], having)] += posted
        return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest numbers, ties to smaller places; largest first."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        more = np.flatnonzero(scores > least)
        found = np.concatenate([more, np.flatnonzero(scores == least)[:k - len(more)]])
    else:
        found = np.arange(len(scores))
    return found[np.lexsort((found, -scores[found]))]


def query_groups(folder: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query ids, the components they have, and weights [component, query], a bounded group at a time."""
    fs, path = file_system(folder)
    for batch in pads.dataset(path, filesystem=fs, format="parquet").to_batches(
            columns=["vec_id", "at", "weight"], batch_size=QUERIES, batch_readahead=2, fragment_readahead=1):
        if batch.num_rows:
            sizes = batch.column("at").value_lengths().to_numpy(zero_copy_only=False)
            at = batch.column("at").flatten().to_numpy(zero_copy_only=False)
            terms, row = np.unique(at, return_inverse=True)
            weights = np.zeros((len(terms), batch.num_rows), np.int64)
            weights[row, np.repeat(np.arange(batch.num_rows), sizes)] = batch.column("weight").flatten().to_numpy(zero_copy_only=False)
            yield batch.column("vec_id").to_numpy(zero_copy_only=False), terms, weights


def _units(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    held, components = [], 0
    for batch in batches:
        held.append(batch)
        components += batch.num_rows + len(batch.column("at").flatten())
        if components >= size:
            yield held
            held, components = [], 0
    if held:
        yield held


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, unit: int = UNIT) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of every query (the rows
    for which ``is_query``, on vec_id, holds) among all rows of other ids."""
    spark = vectors.sparkSession
    # dealt evenly over the cores; a unit, not a partition, bounds what a task holds
    rows = written(sparse_rows(vectors, scale).repartition(max(spark.sparkContext.defaultParallelism, 2)), "topk-vectors")
    folder = scratch_path(spark, "topk-queries")
    (rows.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("at", "weight")).alias("v"))
     .select("vec_id", "v.at", "v.weight").write.parquet(folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _units(batches, unit):
            column = lambda name: pa.chunked_array([b.column(name) for b in held]).combine_chunks()
            at = column("at")
            own = Postings(column("vec_id").to_numpy(), at.value_lengths().to_numpy(zero_copy_only=False),
                           at.flatten().to_numpy(zero_copy_only=False), column("weight").flatten().to_numpy(zero_copy_only=False))
            width = max(1, SCORES // max(len(own.ids), 1))
            for ids, terms, weights in query_groups(folder):
                for a in range(0, len(ids), width):
                    scores = np.ascontiguousarray(own.scores(terms, weights[:, a:a + width]).T)
                    top = []
                    for q, s in zip(ids[a:a + width], scores):
                        lo, hi = np.searchsorted(own.ids, (q, q + 1))          # its own rows
                        if hi > lo:
                            s = np.delete(s, slice(lo, hi))
                        found = best(s, k)
                        top.append((own.ids[np.where(found >= lo, found + hi - lo, found)], s[found]))
                    offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for _, s in top])]), pa.int32())
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([t[j] for t in top]), pa.int64())) for j in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:a + width], pa.int64()), *lists], names=["query_id", "ids", "scores"])

    found = rows.mapInArrow(run, "query_id long, ids array<long>, scores array<long>")
    entry = F.transform(F.arrays_zip("scores", "ids"), lambda e: F.struct((-e["scores"]).alias("less"), e["ids"].alias("vec_id")))
    merged = (found.withColumn("e", entry).groupBy("query_id")
              .agg(F.slice(F.array_sort(F.flatten(F.collect_list("e"))), 1, k).alias("e")))
    return (merged.select("query_id", F.posexplode("e").alias("at", "e"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"),
                    (-F.col("e.less")).alias("score")))
