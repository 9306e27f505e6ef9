"""Substring dedup with a count-min prefilter, over windows of words.

1. Each block of rows sketches its windows: ``DEPTH`` rows of counters, ``LOAD`` a window, sent as
   sparse slices. Buckets add the blocks' slices and tell each block which of its
   counters reached two. A count-min sketch only overestimates, so every repeated window is
   among those whose counters all did.
2. Only those windows are grouped, exactly, by 64-bit hash within buckets chosen by an
   independent hash: the smallest document that holds the window goes back to the blocks
   where it is not known.
3. Each block removes the words that a window covers whose first document is a smaller one.

Defined cases: a null or wordless text has no words; a null doc_id is larger than any other and
removes from none; rows that share a doc_id do not remove from each other; empty tables give no
rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written, tidy
from .exchange import Block, answers, ask, blocks, pack_sorted, unpack_sorted
from .wordhash import Words, groups, words

WINDOW, DEPTH, LOAD = 13, 2, 4
SLICE, BUCKET = 1 << 22, 1 << 20            # counters of a sketch slice, windows of an exact bucket
_LAST = np.iinfo(np.int64).max


def _hashes(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and two independent hashes of every window of a block's texts."""
    docs, one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for offset, own in groups(texts):
        w = words(own)
        at, h = w.windows(window, 1)
        docs.append(w.doc[at] + offset)
        one.append(h)
        two.append(w.windows(window, 2)[1])
    return np.concatenate(docs), np.concatenate(one), np.concatenate(two)


def _counters(one: np.ndarray, two: np.ndarray, width: int) -> list[np.ndarray]:
    """A window's counter in each row of the sketch."""
    a, b = one >> np.uint64(1), two >> np.uint64(1)
    return [((a + np.uint64(d) * b) % np.uint64(width)).astype(np.int64) for d in range(1, DEPTH + 1)]


def _slices(width: int) -> int:
    return -(-width // SLICE)


def _cut(x: np.ndarray, size: int) -> list[tuple[int, slice]]:
    """(block, its range) of a sorted array cut at multiples of ``size``."""
    block = x // size
    at = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(x)]])
    return [(int(block[a]), slice(a, b)) for a, b in zip(at[:-1].tolist(), at[1:].tolist()) if b > a]


def _sketch(texts: list[bytes], window: int, width: int) -> list[tuple[int, bytes, bytes]]:
    _, one, two = _hashes(texts, window)
    out = []
    for row, c in enumerate(_counters(one, two, width)):
        distinct, n = np.unique(c, return_counts=True)
        for block, own in _cut(distinct, SLICE):
            out.append((row * _slices(width) + block, pack_sorted(distinct[own] - block * SLICE),
                        np.packbits(n[own] > 1).tobytes()))
    return out


def _add_sketches(bucket: int, asked: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    total, places = np.zeros(SLICE, np.uint8), []
    for packed, twice in asked:
        at = unpack_sorted(packed)
        n = 1 + np.unpackbits(np.frombuffer(twice, np.uint8), count=len(at))
        total[at] = np.minimum(total[at] + n, 2)
        places.append(at)
    return [(np.packbits(total[at] > 1).tobytes(), b"") for at in places]


def _estimated(block: Block, window: int, width: int, path: str):
    """Text number and hashes of the windows that the sketch estimates repeated, with their places."""
    docs, one, two = _hashes(block.texts, window)
    found, keep = answers(path, block), np.ones(len(docs), bool)
    for row, c in enumerate(_counters(one, two, width)):
        distinct, back = np.unique(c, return_inverse=True)
        bits = [np.unpackbits(np.frombuffer(found[row * _slices(width) + k][0], np.uint8), count=own.stop - own.start)
                for k, own in _cut(distinct, SLICE)]
        if bits:
            keep &= np.concatenate(bits)[back] > 0
    at = np.flatnonzero(keep)
    return at, docs[at], one[at], two[at]


def _order(ids: list) -> np.ndarray:
    """doc_ids as comparable numbers, null as the largest."""
    return np.array([_LAST if i is None else i for i in ids], dtype=np.int64)


def _first_docs(ids: np.ndarray, one: np.ndarray, two: np.ndarray, buckets: int):
    """Distinct windows of a block by (bucket, hash), their smallest doc_id, and where each went."""
    bucket = (two % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((ids, one, bucket))
    b, h, d = bucket[order], one[order], ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (h[1:] != h[:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return b[new], h[new], d[new], which


def _group(bucket: int, asked: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """Smallest document of each window, to the blocks that know only a larger one."""
    hashes = [np.frombuffer(a, np.uint64) for a, _ in asked]
    h, d = np.concatenate(hashes), np.concatenate([np.frombuffer(b, np.int64) for _, b in asked])
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    least = np.minimum.reduceat(d[order], np.flatnonzero(new)) if len(s) else d
    first = np.empty(len(s), np.int64)
    first[order] = least[np.cumsum(new) - 1]
    out, at = [], 0
    for own in hashes:
        better = np.flatnonzero(first[at:at + len(own)] < d[at:at + len(own)])
        out.append((pack_sorted(better), first[at:at + len(own)][better].tobytes()))
        at += len(own)
    return out


def _covered(w: Words, begins: np.ndarray, window: int) -> np.ndarray:
    step = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(step, begins, 1)
    np.add.at(step, begins + window, -1)
    return np.cumsum(step[:-1]) > 0


def remove(docs: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, text without the removed words (unchanged where none is removed; elsewhere
    the white space before a removed word goes with it), n_words, n_removed, kept_sha256 and the
    removed ``spans`` (first word, words). ``keep`` names further columns to carry along."""
    parts = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                                *[F.col(c) for c in keep]), "substring-docs", compression="zstd")
    total = parts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = max(1 << 16, LOAD * total // 6)             # about six bytes a word; only efficiency depends on it
    buckets = max(1, total // 6 // BUCKET)
    sketch = ask(parts, lambda block: _sketch(block.texts, window, width), _add_sketches, "substring-sketch")

    def exact(block: Block):
        at, doc, one, two = _estimated(block, window, width, sketch)
        return at, doc, _first_docs(_order(block.ids)[doc], one, two, buckets)

    def question(block: Block):
        _, _, (b, h, d, _) = exact(block)
        return [(k, h[own].tobytes(), d[own].tobytes()) for k, own in _cut(b, 1)]

    grouped = ask(parts, question, _group, "substring-groups")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            carried = {c: block.column(c) for c in keep}
            at, doc, (b, _, d, which) = exact(block)
            found, least = answers(grouped, block), d.copy()
            for k, own in _cut(b, 1):
                where, smaller = found[k]
                least[own.start + unpack_sorted(where)] = np.frombuffer(smaller, np.int64)
            repeated = at[least[which] < _order(block.ids)[doc]]        # numbers of windows, in the block's order
            seen = 0
            for offset, own in groups(block.texts):
                w = words(own)
                begins, _ = w.windows(window, 1)
                mine = repeated[(repeated >= seen) & (repeated < seen + len(begins))] - seen
                seen += len(begins)
                rows = _rows(block.ids[offset:offset + len(own)], own, w, _covered(w, begins[mine], window))
                more = [carried[c].slice(offset, len(own)) for c in keep]
                yield pa.RecordBatch.from_arrays([*rows.columns, *more], names=[*_ROWS.names, *keep])

    ddl = ("doc_id long, text string, n_words long, n_removed long, kept_sha256 string, "
           "spans array<struct<first:long,words:long>>")
    return parts.mapInArrow(tidy(apply), T.StructType(T.StructType.fromDDL(ddl).fields + [parts.schema[c] for c in keep]))


_ROWS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                   ("kept_sha256", pa.string()),
                   ("spans", pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))])


def _rows(ids: list, texts: list[bytes], w: Words, gone: np.ndarray) -> pa.RecordBatch:
    rows = []
    for i, (doc_id, text) in enumerate(zip(ids, texts)):
        a, b = int(w.first[i]), int(w.first[i + 1])
        own = gone[a:b]
        if not own.any():
            rows.append((doc_id, text, b - a, 0, hashlib.sha256(b" ".join(text.split())).hexdigest(), []))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
        spans = list(zip(edge[0::2].tolist(), (edge[1::2] - edge[0::2]).tolist()))
        begin = int(w.start[a]) - (len(text) - len(text.lstrip(b" \t\n\r\x0b\x0c")))
        keep, place = [], 0
        for first, n in spans:
            left = int(w.end[a + first - 1]) - begin if first else int(w.start[a]) - begin
            keep.append(text[place:left])
            place = int(w.end[a + first + n - 1]) - begin
        kept = b"".join(keep) + text[place:]
        rows.append((doc_id, kept, b - a, int(own.sum()), hashlib.sha256(b" ".join(kept.split())).hexdigest(),
                     [{"first": x, "words": n} for x, n in spans]))
    columns = list(zip(*rows))
    columns[1] = pa.array(columns[1], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t)
                                       for c, t in zip(columns, _ROWS.types)], schema=_ROWS)
