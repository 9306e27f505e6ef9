"""Tokenization, packing and rANS shards against the tokenizer itself."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from demandlens.llm import packing, rans
from demandlens.llm.tokens import encoder, tokenizer_path

TEXTS = ["Hello, world! It's 2024.", "", None, " \n\t ", "a  b c <|endoftext|> x<|startoftext|>y don't İI ΣΑΣ é ßẞ ..!",
         "word " * 5000, "ab\x0bcd\x1fef", "x" * 9000, "Émile, Ärger; naïve: ¿qué? 12ab #$%", "same", "same"]


def ids_of(text):
    return encoder(tokenizer_path()).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_batch_ids_equal_the_tokenizer():
    ids, at = encoder(tokenizer_path()).encode(pa.array(TEXTS))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [ids_of(t) for t in TEXTS]
    ids, at = encoder(tokenizer_path()).encode(pa.array([], pa.string()))
    assert len(ids) == 0 and at.tolist() == [0]


@pytest.mark.parametrize("n,lanes,checkpoint", [(0, 8, 4), (1, 8, 4), (1000, 8, 4), (5003, 16, 7), (70_000, 256, 16)])
def test_rans_round_trip_and_segments(n, lanes, checkpoint):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 40_000).astype(np.uint16)
    freq = rans.Frequencies.from_counts(np.bincount(ids, minlength=1 << 16))
    assert int(freq.f.sum()) in (0, 1 << rans.SCALE_BITS) and (freq.f[ids] > 0).all()
    data = rans.pack_block([5, None], [n // 2, n - n // 2], ids, freq, lanes, checkpoint)
    docs, counts, back = rans.unpack_block(data, freq)
    assert docs == [5, None] and counts.tolist() == [n // 2, n - n // 2] and (back == ids).all()
    used, table, states, words = rans.encode_block(ids, freq, lanes, checkpoint)
    for k in reversed(range(len(table))):          # each checkpoint decodes alone
        own = ids[k * checkpoint * used:(k + 1) * checkpoint * used]
        part = words[table[k, 0]:table[k, 0] + table[k, 1]]
        assert (rans.decode_segment(part, states[k * used:(k + 1) * used], len(own), freq) == own).all()
    if n > 100:
        broken = bytearray(data)
        broken[-3] ^= 1
        with pytest.raises(ValueError):
            rans.unpack_block(bytes(broken), freq)


def test_many_rare_ids_keep_a_slot():
    counts = np.zeros(1 << 16, np.int64)
    counts[:49_000] = 1
    counts[7] = 10 ** 9
    freq = rans.Frequencies.from_counts(counts)
    assert int(freq.f.sum()) == 1 << rans.SCALE_BITS and (freq.f[:49_000] > 0).all()


def test_shards_return_every_document(documents):
    rows = [(i * 3 % 11, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (4, "again"), (4, "again")]
    got = sorted(rans.encode_corpus(documents(rows)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([i for i, _ in rows], key=lambda x: (x is not None, x or 0))
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    want = sorted((str(i), zlib.crc32(np.array(ids_of(t) + [1], "<u4").tobytes())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got) == want


def test_empty_tables(documents):
    assert rans.encode_corpus(documents([])).count() == 0
    assert packing.pack(documents([])).count() == 0


def test_packing_is_whole_and_gapless(documents):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "x"), (3, "x")]
    got = packing.pack(documents(rows), capacity=64).collect()
    want = []
    for i, t in rows:
        ids = np.array(ids_of(t) + [0], "<u4")
        want += [(str(i), k, s, len(ids[s:s + 64]), zlib.crc32(ids[s:s + 64].tobytes()))
                 for k, s in enumerate(range(0, len(ids), 64))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= -(-sum(r["length"] for r in got) // 64) + 1


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_piece_once_and_packs_tightly(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 100) for _ in range(rng.randint(1, 400))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.plan_bins(histogram, 100)
    used: dict[int, int] = {}
    for bin_, times in plan:
        assert 0 < sum(n * k for n, k in bin_.items()) <= 100
        for n, k in bin_.items():
            used[n] = used.get(n, 0) + k * times
    assert used == histogram
    first_fit = []
    for n in sorted(lengths, reverse=True):
        for i, room in enumerate(first_fit):
            if room >= n:
                first_fit[i] -= n
                break
        else:
            first_fit.append(100 - n)
    assert sum(t for _, t in plan) <= len(first_fit) + 1


def test_two_smaller_pieces_replace_the_smallest():
    # greedy: 60 + 30 leaves a gap of 10; 25 + 15 in place of 30 fill the bin
    plan = packing.plan_bins({60: 1, 30: 1, 25: 1, 15: 1}, 100)
    assert {25: 1, 15: 1, 60: 1} == dict(plan[0][0])
