"""Approximate nearest neighbours by learned partitions.

On a bounded sample of distinct vectors (``sample_rows``) the driver builds a neighbour graph,
cuts it into balanced parts with few edges between them, and trains a small network that tells
a vector's part. The network then assigns every distinct vector to its most probable part and
routes each query to as many probable parts as held-out sample queries need for the wished
recall. Spark searches part by part: a part is split into blocks of bounded size, queries into
chunks, and each (block, chunk) is scored with exact inner products in double precision.

Copies of a vector are one entry of the index that keeps its smallest ``k + 1`` ids - no more
can be among anyone's k nearest - so large groups of copies cost nothing and lose nothing.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components, or differ in
length from the most common one (ties: the longest), and rows without vec_id, take no part; repeated
rows count once; rows that share a vec_id with the query are its own; with fewer than k candidates
all are found; equal scores go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SAMPLE, PARTS, PART_SAMPLE, DEGREE = 6000, 48, 60, 12
BLOCK, CHUNK, SALTS = 1024, 1 << 14, 16


def neighbours(x: np.ndarray, k: int, rows: np.ndarray | None = None) -> np.ndarray:
    """Ids of the k nearest (largest inner product) other rows, in blocks."""
    rows = np.arange(len(x)) if rows is None else rows
    out = np.empty((len(rows), k), np.int64)
    for a in range(0, len(rows), 512):
        own = rows[a:a + 512]
        s = x[own] @ x.T
        s[np.arange(len(own)), own] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[a:a + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), 1, kind="stable"), 1)
    return out


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 25,
                   slack: float = 1.1) -> np.ndarray:
    """Parts of nearly equal size with few edges between them: grown over the graph from seeds,
    then vertices move to the part most of their neighbours are in while it has room."""
    n = len(graph)
    room = int(np.ceil(slack * n / parts))
    ends = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    others = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    label = np.full(n, -1)
    order = rng.permutation(n)
    near = np.split(others[np.argsort(ends, kind="stable")], np.cumsum(np.bincount(ends, minlength=n))[:-1])
    at = 0
    for part in range(parts):                       # breadth-first growth up to n / parts vertices
        size, queue = n // parts + (part < n % parts), []
        while size:
            while queue and label[queue[0]] >= 0:
                queue.pop(0)
            if queue:
                v = queue.pop(0)
            else:
                while label[order[at]] >= 0:
                    at += 1
                v = int(order[at])
            label[v] = part
            size -= 1
            queue.extend(int(u) for u in near[v] if label[u] < 0)
    for _ in range(rounds):
        votes = np.bincount(ends * parts + label[others], minlength=n * parts).reshape(n, parts)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        sizes, moved = np.bincount(label, minlength=parts), 0
        for v in np.argsort(-gain, kind="stable").tolist():
            if gain[v] <= 0:
                break
            if sizes[best[v]] < room and rng.random() < 0.7:      # not all at once, or pairs swap for ever
                sizes[label[v]] -= 1
                sizes[best[v]] += 1
                label[v] = best[v]
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """Vector -> probabilities of the parts: one hidden layer, on unit vectors."""
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train_router(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = 128,
                 epochs: int = 40, rate: float = 0.003) -> Router:
    d, parts = x.shape[1], target.shape[1]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    p = [rng.normal(0, np.sqrt(2 / d), (d, hidden)) * np.sqrt(d) / 4, np.zeros(hidden),
         rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(unit))
        for a in range(0, len(order), 128):
            own = order[a:a + 128]
            h = np.maximum(unit[own] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (z / z.sum(axis=1, keepdims=True) - target[own]) / len(own)
            dh = dz @ p[2].T * (h > 0)
            t += 1
            for i, g in enumerate((unit[own].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
    return Router(*p)


def fit(x: np.ndarray, k: int, recall: float = 0.98, seed: int = 5) -> Router:
    """Parts and router from sample vectors; probes reach ``recall`` on held-out sample vectors."""
    n, rng = len(x), np.random.default_rng(seed)
    parts = max(1, min(PARTS, n // PART_SAMPLE))
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    held = rng.permutation(n)[:max(1, n // 5)]
    learn = np.setdiff1d(np.arange(n), held)
    own = x[learn]
    graph = neighbours(own, min(DEGREE, len(own) - 1))
    label = balanced_parts(graph, parts, rng)
    near = np.column_stack([label, label, label, label[graph]])         # a vector's own part weighs most
    target = np.zeros((len(own), parts))
    np.add.at(target, (np.repeat(np.arange(len(own)), near.shape[1]), near.ravel()), 1 / near.shape[1])
    router = train_router(own, target, rng)
    prob = router.probabilities(x)
    home = prob.argmax(axis=1)
    truth = home[neighbours(x, min(k, n - 1), held)]
    rank = np.argsort(np.argsort(-prob[held], axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort(np.take_along_axis(rank, truth, 1).ravel()) + 1
    router.probes = int(min(parts, needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]))
    return router


def classes(rows: DataFrame, k: int) -> DataFrame:
    """Distinct usable vectors: key, x (doubles) and their k + 1 smallest ids."""
    x = F.col("embedding").cast("array<double>")
    fine = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull()
        & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists("x", lambda c: c != 0))
    lengths = fine.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths:
        fine = fine.filter(F.size("x") == lengths["d"])
    return fine.withColumn("key", F.md5(F.array_join(F.col("x").cast("array<string>"), ",")))


def search(rows: DataFrame, is_query, k: int = 20, sample_rows: int = SAMPLE, recall: float = 0.98) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row where ``is_query`` (on vec_id)."""
    spark = rows.sparkSession
    fine = classes(rows, k)
    smallest = Window.partitionBy("key").orderBy("vec_id")
    index = (fine.distinct().withColumn("rn", F.row_number().over(smallest)).filter(F.col("rn") <= k + 1)
             .groupBy("key").agg(F.first("x").alias("x"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    index = written(index, "ann-index")
    queries = fine.filter(is_query).select("key", F.col("vec_id").alias("query_id")).distinct()
    out = "query_id long, rank int, vec_id long, score double"
    sample = [r["x"] for r in index.orderBy(F.xxhash64("key"), "key").limit(sample_rows).select("x").collect()]
    if not sample:
        return spark.createDataFrame([], out)
    shared = spark.sparkContext.broadcast(fit(np.array(sample), k, recall))

    def route(batches, probes: int):
        for batch in batches:
            x = _vectors(batch.column("x"))
            if not len(x):
                continue
            prob = shared.value.probabilities(x)
            top = np.argsort(-prob, axis=1, kind="stable")[:, :probes]
            parts = pa.ListArray.from_arrays(np.arange(0, top.size + 1, top.shape[1], dtype=np.int32),
                                             pa.array(top.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts], names=[*batch.schema.names, "parts"])

    probes = shared.value.probes
    base = "key string, x array<double>, ids array<long>, parts array<int>"
    home = written(index.mapInArrow(lambda b: route(b, 1), base)
                   .withColumn("part", F.col("parts")[0]).drop("parts"), "ann-home")
    sizes = home.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))     # at most PARTS rows
    asked = index.join(queries.select("key").distinct(), "key", "left_semi")
    asked = written(asked.mapInArrow(lambda b: route(b, probes), base).drop("ids"), "ann-asked")
    chunks = max(1, -(-asked.count() // CHUNK))
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    left = (home.join(F.broadcast(sizes), "part")
            .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).drop("blocks")
            .withColumn("chunk", every))
    right = (asked.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int"))
             .withColumn("part", F.explode("parts")).drop("parts").join(F.broadcast(sizes), "part")
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks"))

    def nearest(own: pa.Table, asks: pa.Table) -> pa.Table:
        if not own.num_rows or not asks.num_rows:
            return _FOUND.empty_table()
        x, q = _vectors(own.column("x")), _vectors(asks.column("x"))
        ids = own.column("ids").to_pylist()
        first = np.array([i[0] for i in ids])
        keys, found = asks.column("key").to_pylist(), []
        for a in range(0, len(q), 1024):
            s = q[a:a + 1024] @ x.T
            take = min(k + 1, len(x))
            least = -np.partition(-s, take - 1, axis=1)[:, take - 1]
            for i, own_row in enumerate(s):
                # rounding of the product must not decide: near ones are scored again, term by term
                j = np.flatnonzero(own_row >= least[i] - 1e-9 * (1 + abs(least[i])))
                exact = (x[j] * q[a + i]).sum(axis=1)
                best = np.lexsort((first[j], -exact))[:k + 1]
                found += [(keys[a + i], ids[j[b]], float(exact[b])) for b in best]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _FOUND.types)], schema=_FOUND)

    place = ["part", "block", "chunk"]
    hits = (left.groupBy(*place).cogroup(right.groupBy(*place))
            .applyInArrow(nearest, "key string, ids array<long>, score double")
            .select("key", F.explode("ids").alias("vec_id"), "score"))
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    lists = (hits.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k + 1)
             .groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rn", "vec_id", "score"))).alias("found"))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salted = queries.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int"))
    own = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    return (salted.join(lists, ["key", "salt"]).select("query_id", F.posexplode(own).alias("at", "f"))
            .select("query_id", (F.col("at") + 1).alias("rank"), "f.vec_id", "f.score"))


_FOUND = pa.schema([("key", pa.string()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])


def _vectors(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
