"""Questions and answers between the partitions of a written table and hash buckets.

A partition is read in blocks of bounded size. A block asks each bucket about its distinct keys
in one packed row; the bucket, which sees every block's row, answers each in one packed row. So
keys travel as arrays, are merged within a block before they travel, and no key, however
frequent, is more than one entry a block. Answers are written a folder a partition; the task
that reads the partition again reads its own folder.

The written table is read through one DataFrame, so each partition holds the same rows in every
pass; a block's stamp proves it (a mismatch raises, it is never taken for an answer).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from demandlens.session import scratch_path

from .common import file_system, release, text_bytes, tidy

#: Text bytes of a block; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21
PACKED = "bucket int, part int, block int, stamp long, a binary, b binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("block", pa.int32()), ("stamp", pa.int64()),
                     ("a", pa.binary()), ("b", pa.binary())])
Packed = list[tuple[int, bytes, bytes]]          # bucket, two arrays


@dataclass
class Block:
    """Some rows of a partition in order."""
    part: int
    number: int
    ids: list
    texts: list[bytes]
    slices: list[pa.RecordBatch]

    @property
    def stamp(self) -> int:
        out = 0
        for i, t in zip(self.ids, self.texts):
            out = zlib.crc32(b"%s,%d;" % (str(i).encode(), len(t)), out)
        return out

    def column(self, name: str) -> pa.Array:
        return pa.chunked_array([s.column(name) for s in self.slices]).combine_chunks()


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The blocks of a partition whose first columns are doc_id and text."""
    part, number, held = TaskContext.get().partitionId(), 0, 0
    ids: list = []
    texts: list[bytes] = []
    slices: list[pa.RecordBatch] = []
    for batch in (whole.slice(k, 500) for whole in batches for k in range(0, whole.num_rows, 500)):
        found, begin = text_bytes(batch.column(1)), 0
        for i, t in enumerate(found):
            held += len(t) + 1
            if held >= size:
                yield Block(part, number, ids + batch.column(0).slice(begin, i + 1 - begin).to_pylist(),
                            texts + found[begin:i + 1], slices + [batch.slice(begin, i + 1 - begin)])
                number, held, begin, ids, texts, slices = number + 1, 0, i + 1, [], [], []
        if begin < len(found):
            ids += batch.column(0).slice(begin).to_pylist()
            texts += found[begin:]
            slices.append(batch.slice(begin))
    if texts:
        yield Block(part, number, ids, texts, slices)


def ask(parts: DataFrame, question: Callable[[Block], Packed],
        answer: Callable[[int, list[tuple[bytes, bytes]]], list[tuple[bytes, bytes]]], name: str) -> str:
    """The folder of the answers. ``question`` gets a block; ``answer`` a bucket and its questions,
    and returns an answer to each."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            stamp = block.stamp
            for bucket, a, b in question(block):
                row = (bucket, block.part, block.number, stamp, a, b)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _SCHEMA.types)], schema=_SCHEMA)

    def merge(table: pa.Table) -> pa.Table:
        asked = list(zip(table.column("a").to_pylist(), table.column("b").to_pylist()))
        found = answer(table.column("bucket")[0].as_py(), asked)
        release()
        return pa.Table.from_arrays([*(table.column(c) for c in _SCHEMA.names[:4]),
                                     pa.array([a for a, _ in found], pa.binary()),
                                     pa.array([b for _, b in found], pa.binary())], schema=_SCHEMA)

    path = scratch_path(parts.sparkSession, name)
    found = parts.mapInArrow(tidy(send), PACKED).groupBy("bucket").applyInArrow(merge, PACKED)
    found.repartition("part").write.partitionBy("part").parquet(path)
    return path


@lru_cache(maxsize=3)
def _folder(path: str, part: int) -> pa.Table:
    fs, name = file_system(f"{path}/part={part}")
    if fs.get_file_info(name).type == pafs.FileType.NotFound:
        return _SCHEMA.empty_table()
    return pads.dataset(name, filesystem=fs, format="parquet").to_table(columns=["bucket", "block", "stamp", "a", "b"])


def answers(path: str, block: Block) -> dict[int, tuple[bytes, bytes]]:
    """The answers to a block, by bucket."""
    found = _folder(path, block.part)
    found = found.filter(pc.equal(found.column("block"), block.number))
    stamp = block.stamp
    if any(s != stamp for s in found.column("stamp").to_pylist()):
        raise RuntimeError("a partition holds other rows than when it asked")
    return {k: (a, b) for k, a, b in zip(found.column("bucket").to_pylist(), found.column("a").to_pylist(),
                                         found.column("b").to_pylist())}


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted distinct numbers as gaps of one or two bytes (the largest value adds up to larger gaps)."""
    if not len(x):
        return b""
    gaps = np.diff(x, prepend=-1) - 1
    kind = np.uint8 if gaps.mean() < 200 else np.uint16
    top = np.iinfo(kind).max
    over, rest = np.divmod(gaps, top)
    out = np.full(int(over.sum()) + len(x), top, kind)
    out[np.cumsum(over + 1) - 1] = rest
    return bytes([out.itemsize]) + out.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    kind = np.uint8 if data[0] == 1 else np.uint16
    got = np.frombuffer(data, kind, offset=1)
    last = got != np.iinfo(kind).max
    return (np.cumsum(got.astype(np.int64) + last) - 1)[last]
