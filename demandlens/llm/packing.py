"""Best-fit packing (best-two-fit) of tokenized documents into fixed-length sequences.

Only lengths matter to a packing, and there are at most ``capacity`` of them. So the bins
are planned on the histogram of piece lengths: a *pattern* (how many pieces of each length
one bin takes) is found greedily and used as often as the histogram allows. Pieces are then
dealt to patterns by their rank among the pieces of their length, which Spark computes with
a two-level count (within a partition, then partition totals), so no length gathers in one task.

Defined cases: null text is an empty document (one end id); a null doc_id and repeated rows
are packed like any other row, one document each; an empty table gives no rows; only doc_id
and text are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, written, tidy
from .tokens import encoder, ids_crc32, tokenizer_path

CAPACITY = 2048
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                    ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("part", pa.int32()), ("local_rank", pa.int64())])
PIECES_DDL = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
              "part int, local_rank long")


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0,
               capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, with the partition that cut it and its rank there among equal lengths."""
    path = tokenizer or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows: list[tuple] = []
            found, at = encoder(path).encode(batch.column(1))
            for doc_id, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                ids = np.append(found[a:b], np.uint16(end_id))
                for k, start in enumerate(range(0, len(ids), capacity)):
                    piece = ids[start:start + capacity]
                    n = len(piece)
                    rows.append((doc_id, k, start, n, ids_crc32(piece), part, ranks[n]))
                    ranks[n] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(PIECES), PIECES.types)],
                schema=PIECES)

    return id_text(docs).mapInArrow(tidy(cut), PIECES_DDL)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    """Patterns and how many bins use each, by best-two-fit on a histogram of lengths.

    A bin is filled greedily, each time with the longest piece that fits. Then its smallest
    piece makes room for two unpacked pieces if they fill the widened gap more tightly.
    Each pattern leaves one of its lengths short of a further use, so there are at most
    sum(1 + capacity / length) patterns, about 18,000 for 2048, whatever the corpus size.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan, at = [], np.arange(capacity + 1)
    longest = np.maximum.accumulate(np.where(left > 0, at, 0))   # longest left of at most x
    while longest[capacity]:
        bin_, gap, free = Counter(), capacity, left.copy()
        fits = longest.copy()
        while gap and fits[gap]:
            n = int(fits[gap])
            k = int(min(gap // n, free[n]))
            bin_[n] += k
            free[n] -= k
            gap -= k * n
            if not free[n]:
                fits = np.maximum.accumulate(np.where(free > 0, at, 0))
        if gap:
            small = min(bin_)
            room = gap + small
            fits = np.maximum.accumulate(np.where(free > 0, at, 0))
            first = np.flatnonzero(free[:room] > 0)
            second = np.minimum(fits[room - first], first)        # the second is the shorter one
            second = np.where((second == first) & (free[first] < 2),
                              fits[np.maximum(np.minimum(room - first, first - 1), 0)], second)
            total = np.where(second > 0, first + second, 0)
            if len(total) and (best := int(total.argmax())) >= 0 and total[best] > small:
                bin_[small] -= 1
                bin_.update((int(first[best]), int(second[best])))
                bin_ = +bin_
        times = int(min(left[n] // k for n, k in bin_.items()))
        for n, k in bin_.items():
            left[n] -= k * times
        plan.append((bin_, times))
        longest = np.maximum.accumulate(np.where(left > 0, at, 0))
    return plan


def slots(plan: list[tuple[Counter, int]]) -> dict[str, np.ndarray]:
    """For each (length, pattern): first rank dealt to it, pieces a bin, first bin, offset."""
    seen: Counter = Counter()
    rows, sequence = [], 0
    for bin_, times in plan:
        offset = 0
        for n in sorted(bin_, reverse=True):
            rows.append((n, seen[n], bin_[n], sequence, offset))
            seen[n] += bin_[n] * times
            offset += n * bin_[n]
        sequence += times
    rows.sort()
    names = ("length", "rank", "each", "sequence", "offset")
    return {c: np.array([r[i] for r in rows], dtype=np.int64) for i, c in enumerate(names)}


_SHIFT = np.int64(1 << 48)      # ranks stay far below it


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0,
         capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    pieces = written(cut_pieces(docs, tokenizer, end_id, capacity), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    dealt = spark.sparkContext.broadcast(slots(plan_bins(histogram, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = dealt.value
        keys = s["length"] * _SHIFT + s["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            i = np.searchsorted(keys, length * _SHIFT + rank, side="right") - 1
            copy, slot = np.divmod(rank - s["rank"][i], s["each"][i])
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(s["sequence"][i] + copy), pa.array(s["offset"][i] + slot * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = (pieces.join(base, ["part", "length"])
              .select("doc_id", "piece", "start", "length", "ids_crc32",
                      (F.col("base") + F.col("local_rank")).alias("rank")))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")
