"""Token-ID output: a static range asymmetric numeral system (rANS) over shared frequencies.

One frequency table, counted over the whole corpus, encodes every block. A block holds whole
documents; its ids are dealt in turn to many interleaved states ("lanes"), so that numpy
advances all lanes at once. After every ``CHECKPOINT`` rounds the block keeps the lanes'
states and the place in its word stream, with the words' and ids' checksums: each segment
between checkpoints decodes on its own, in another task or side by side with the others.

A shard (one file a partition, documents in ascending doc_id order) is a sequence of blocks:

    block  = header, doc ids, null flags, id counts, segment table, segment states, words
    header = magic "RNS1", crc32 of the frequency table, documents, ids, lanes, segments, words

Defined cases: null text is an empty document (the end id only); a null doc_id sorts first;
rows that share a doc_id are separate documents in the order of their ids; an empty table writes no
shard and reads no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlens.session import scratch_path

from .common import id_text, publishing, read_range, written
from .tokens import encoder, ids_crc32, tokenizer_path

MAGIC = b"RNS1"
HEADER = struct.Struct("<4sIQQIIQ")
SCALE_BITS = 20
LOW = np.uint64(1 << 31)            # states stay in [2^31, 2^63)
LANES, CHECKPOINT = 4096, 256       # states a block, rounds a segment
BLOCK_IDS = 1 << 21                 # a block closes after the document that reaches it


class Frequencies:
    """Counts scaled to 2^SCALE_BITS; every id that occurs keeps at least one slot."""

    def __init__(self, scaled: np.ndarray):
        self.scaled = scaled.astype("<u4")
        self.f = scaled.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.f)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(scaled), dtype=np.uint16), scaled)
        self.crc = zlib.crc32(self.scaled.tobytes())

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Frequencies:
        total, slots_ = int(counts.sum()), 1 << SCALE_BITS
        if not total:
            return cls(np.zeros(len(counts), np.int64))
        scaled = np.where(counts > 0, np.maximum(1, counts * (slots_ / total)).astype(np.int64), 0)
        over = int(scaled.sum()) - slots_
        for i in np.argsort(-scaled, kind="stable"):      # the largest ids absorb the rounding
            if not over:
                break
            take = min(over, int(scaled[i]) - 1) if over > 0 else over
            scaled[i] -= max(take, -int(scaled[i])) if over < 0 else take
            over = int(scaled.sum()) - slots_
        return cls(scaled)


def encode_block(ids: np.ndarray, freq: Frequencies, lanes: int = LANES,
                 checkpoint: int = CHECKPOINT) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """lanes used, segment table (words before, words, words' crc, ids' crc), states, words."""
    n = len(ids)
    lanes = max(1, min(lanes, 1 << max(0, (n // 64).bit_length() - 1)))
    rounds = -(-n // lanes)
    x = np.full(lanes, LOW, dtype=np.uint64)
    limit = np.uint64((1 << 31) >> SCALE_BITS << 32)
    bits, word = np.uint64(SCALE_BITS), np.uint64(32)
    f_all, s_all = freq.f[ids], freq.start[ids]
    segments, states, stream = [], [], []
    part: list[np.ndarray] = []
    for r in range(rounds - 1, -1, -1):
        f, s = f_all[r * lanes:(r + 1) * lanes], s_all[r * lanes:(r + 1) * lanes]
        y = x[:len(f)]
        full = y >= limit * f
        if full.any():
            out = y[full]
            part.append(out.astype(np.uint32))
            y[full] = out >> word
        q = y // f
        x[:len(f)] = (q << bits) + (y - q * f) + s
        if r % checkpoint == 0:
            words = np.concatenate(part[::-1]) if part else np.zeros(0, np.uint32)
            own = ids[r * lanes:(r + checkpoint) * lanes]
            segments.append((len(words), zlib.crc32(words.astype("<u4").tobytes()), ids_crc32(own)))
            states.append(x.copy())
            stream.append(words)
            part = []
    table = np.array(segments[::-1], dtype="<u8").reshape(-1, 3)
    before = np.concatenate([[0], np.cumsum(table[:, 0])[:-1]]).astype("<u8") if len(table) else np.zeros(0, "<u8")
    return (lanes, np.column_stack([before, table]).astype("<u8"),
            np.concatenate(states[::-1]).astype("<u8") if states else np.zeros(0, "<u8"),
            np.concatenate(stream[::-1]).astype("<u4") if stream else np.zeros(0, "<u4"))


def decode_segment(words: np.ndarray, states: np.ndarray, n: int, freq: Frequencies) -> np.ndarray:
    """The ``n`` ids of one segment from its own words and its checkpoint's states."""
    lanes, x = len(states), states.astype(np.uint64)
    out = np.empty(n, dtype=np.uint16)
    mask, bits, word, at = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32), 0
    for r in range(-(-n // lanes)):
        y = x[:min(lanes, n - r * lanes)]
        slot = y & mask
        ids = freq.symbol[slot]
        out[r * lanes:r * lanes + len(y)] = ids
        y[:] = freq.f[ids] * (y >> bits) + slot - freq.start[ids]
        low = np.flatnonzero(y < LOW)
        if len(low):
            y[low] = (y[low] << word) | words[at:at + len(low)].astype(np.uint64)
            at += len(low)
    if at != len(words):
        raise ValueError("words are left over: damaged segment")
    return out


def pack_block(doc_ids: list, counts: list[int], ids: np.ndarray, freq: Frequencies,
               lanes: int = LANES, checkpoint: int = CHECKPOINT) -> bytes:
    lanes, table, states, words = encode_block(ids, freq, lanes, checkpoint)
    head = HEADER.pack(MAGIC, freq.crc, len(counts), len(ids), lanes, len(table), len(words))
    known = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    nulls = np.array([d is None for d in doc_ids], dtype="u1")
    body = [known, nulls, np.array(counts, dtype="<u8"), np.array([checkpoint], dtype="<u8"), table, states, words]
    return head + b"".join(b.tobytes() for b in body)


def unpack_block(data: bytes, freq: Frequencies) -> tuple[list, np.ndarray, np.ndarray]:
    """doc ids, id counts and ids of one block; damage raises."""
    magic, crc, n_docs, n, lanes, n_seg, n_words = HEADER.unpack_from(data)
    if magic != MAGIC or crc != freq.crc:
        raise ValueError("not a block of this frequency table")
    at = HEADER.size

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        a = np.frombuffer(data, kind, k, at)
        at += a.nbytes
        return a

    known, nulls, counts = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    checkpoint = int(take("<u8", 1)[0])
    table, states, words = take("<u8", 4 * n_seg).reshape(-1, 4), take("<u8", lanes * n_seg), take("<u4", n_words)
    ids = np.empty(n, dtype=np.uint16)
    for k, (before, k_words, words_crc, ids_crc) in enumerate(table.tolist()):
        own = words[before:before + k_words]
        if zlib.crc32(own.tobytes()) != words_crc:
            raise ValueError("damaged words")
        begin = k * checkpoint * lanes
        m = min(checkpoint * lanes, n - begin)
        ids[begin:begin + m] = decode_segment(own, states[k * lanes:(k + 1) * lanes], m, freq)
        if ids_crc32(ids[begin:begin + m]) != ids_crc:
            raise ValueError("decoded ids differ from those encoded")
    return [None if z else d for d, z in zip(known.tolist(), nulls.tolist())], counts.astype(np.int64), ids


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id and ids (little-endian unsigned 16-bit, the end id last) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            ids, at = encoder(tokenizer).encode(batch.column(1))
            data = ids.astype("<u2").tobytes()
            rows = [data[2 * a:2 * b] + end for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "ids"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids binary")


def count_ids(ids: DataFrame) -> np.ndarray:
    """Occurrences of every id over all documents: one row an id reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=1 << 16)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen])], names=["id", "n"])

    total = np.zeros(1 << 16, np.int64)
    for r in ids.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        total[r["id"]] = r["n"]
    return total


MANIFEST = "shard int, block int, path string, at long, size long, n_docs long, n_ids long"


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None,
                 end_id: int = 1) -> tuple[DataFrame, Frequencies]:
    """Encode into one file a range partition; the manifest has a row a block."""
    path = tokenizer or tokenizer_path()
    rows = written(tokenized(docs, path, end_id), "ids", compression="zstd")
    freq = Frequencies.from_counts(count_ids(rows))
    shared = docs.sparkSession.sparkContext.broadcast(freq.scaled)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, shard = Frequencies(shared.value), TaskContext.get().partitionId()
        name, done, at = f"{folder}/shard-{shard:06d}.rans", [], 0
        doc_ids, counts, parts, size = [], [], [], 0

        def flush(out) -> None:
            nonlocal doc_ids, counts, parts, size, at
            data = pack_block(doc_ids, counts, np.frombuffer(b"".join(parts), "<u2"), table)
            out.write(data)
            done.append((shard, len(done), name, at, len(data), len(counts), size))
            at += len(data)
            doc_ids, counts, parts, size = [], [], [], 0

        first = next(batches, None)
        if first is None:
            return
        with publishing(name) as out:
            while first is not None:
                for doc_id, data in zip(first.column(0).to_pylist(), first.column(1).to_pylist()):
                    doc_ids.append(doc_id)
                    counts.append(len(data) // 2)
                    parts.append(data)
                    size += len(data) // 2
                    if size >= BLOCK_IDS:
                        flush(out)
                first = next(batches, None)
            if counts:
                flush(out)
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done), (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4))],
                names=["shard", "block", "path", "at", "size", "n_docs", "n_ids"])

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    return written(ordered.mapInArrow(encode, MANIFEST), "manifest"), freq


def read_shards(manifest: DataFrame, freq: Frequencies) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files, a block a row.

    Block starts are a running sum over the manifest (a row for some two million ids)."""
    spark = manifest.sparkSession
    shared = spark.sparkContext.broadcast(freq.scaled)
    before = Window.orderBy("shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Frequencies(shared.value)
        for batch in batches:
            for r in batch.to_pylist():
                doc_ids, counts, ids = unpack_block(read_range(r["path"], r["at"], r["size"]), table)
                starts = np.concatenate([[0], np.cumsum(counts)])
                crcs = [ids_crc32(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts[:-1] + r["start"], pa.int64()),
                     pa.array(counts), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))
    return (blocks.repartition(tasks, "shard", "block")
            .mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def encode_corpus(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Write all documents as shards in the shared folder and read them back."""
    manifest, freq = write_shards(docs, scratch_path(docs.sparkSession, "rans"), tokenizer, end_id)
    return read_shards(manifest, freq)
