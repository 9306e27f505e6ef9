"""Fill-in-middle: documents rearranged so that a model learns to write the middle.

A text is cut into units (white space and the word after it; a last run of white space is a unit of
its own). Two cuts at unit borders, drawn from a hash of the doc_id, give prefix, middle and
suffix; the document is written as prefix-suffix-middle (psm), suffix-prefix-middle (spm) or left
as it is (plain). ``restore`` rebuilds the text from output and form alone.

Each record batch goes through ``pyarrow.compute``: a mark byte that UTF-8 never holds is put
after each unit and the text split at it, which gives a list array; the lists are flattened with
the number of the row each unit is from; a unit's ordinal and the row's cuts give its role; the
units of a role are filtered, put into lists again and joined. Nothing is shuffled, rows are
worked on in runs of bounded bytes, and no Python loop sees a unit.

Defined cases: a null text is the empty text (form plain, n 0); a null doc_id draws as an empty
number; repeated rows give repeated rows; a text that holds a sentinel stays plain; an empty table
gives no rows; only doc_id and text are read, other columns are left behind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, text_slices

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: ends a unit; no byte of UTF-8 has this value
MARK = b"\xff"
SENTINELS = ("<P>", "<S>", "<M>")


def draw(seed: int, k: int) -> Column:
    """The k-th (from 1) 8-digit group of the hex sha256 of ``seed:doc_id``, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def remainder(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def units(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Units of all texts in a row, the number of the text each is from, and units of each text."""
    marked = pc.replace_substring_regex(texts.cast(pa.large_binary()), pattern=UNIT, replacement=rb"\0" + MARK)
    lists = pc.split_pattern(marked, pattern=MARK)       # and an empty piece after the last mark
    n = pc.subtract(pc.list_value_length(lists).cast(pa.int64()), 1)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).cast(pa.int64())
    real = pc.not_equal(flat, pa.scalar(b"", pa.large_binary()))
    return flat.filter(real), parent.filter(real), n


def ordinals(parent: pa.Array, n: pa.Array) -> pa.Array:
    """Place of each unit in its text, from 0."""
    begin = pc.subtract(pc.cumulative_sum(n), n)
    return pc.subtract(pa.array(np.arange(len(parent))), begin.take(parent))


def joined(flat: pa.Array, role: pa.Array, count: pa.Array) -> pa.Array:
    """The units for which ``role`` holds, ``count`` of them in each text, joined by text."""
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(count)])
    lists = pa.LargeListArray.from_arrays(offsets, flat.filter(role))
    return pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))


def pieces(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """Units of each text, and its prefix, middle and suffix (UTF-8 bytes)."""
    flat, parent, n = units(texts)
    one_more = pc.add(n, 1)
    cuts = remainder(h1, one_more), remainder(h2, one_more)
    a, b = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    at = ordinals(parent, n)
    in_prefix, in_suffix = pc.less(at, a.take(parent)), pc.greater_equal(at, b.take(parent))
    in_middle = pc.invert(pc.or_(in_prefix, in_suffix))
    return (n, joined(flat, in_prefix, a), joined(flat, in_middle, pc.subtract(b, a)),
            joined(flat, in_suffix, pc.subtract(n, b)))


def _sentinels(names: tuple[str, str, str]) -> list[bytes]:
    if len(set(names)) != 3 or not all(re.fullmatch(r"<[^<>]+>", s) for s in names):
        raise ValueError("three different sentinels of the form <name> are needed")     # others could overlap a text's end
    return [s.encode() for s in names]


def _glue(*parts) -> pa.Array:
    parts = [pa.scalar(p, pa.large_binary()) if isinstance(p, bytes) else p for p in parts]
    return pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.large_binary()))


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80,
              sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain) and output of every row:
    ``rate`` percent of the documents are rearranged, ``spm_rate`` percent of these as spm."""
    p, s, m = _sentinels(sentinels)
    rows = id_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    held = F.lit(False)
    for name in sentinels:
        held = held | F.contains(F.col("text"), F.lit(name))
    plain = (F.col("text") == "") | held | (draw(seed, 3) % 100 >= rate)
    form = F.when(plain, "plain").when(draw(seed, 4) % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", form.alias("form"), draw(seed, 1).alias("h1"), draw(seed, 2).alias("h2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, "text")):
            form, text = batch.column("form"), batch.column("text").cast(pa.large_binary())
            n, prefix, middle, suffix = pieces(text, batch.column("h1"), batch.column("h2"))
            is_plain, is_psm = pc.equal(form, "plain"), pc.equal(form, "psm")
            output = pc.if_else(is_plain, text, pc.if_else(is_psm, _glue(p, prefix, s, suffix, m, middle),
                                                           _glue(s, suffix, p, prefix, m, middle)))
            chars = [pc.if_else(is_plain, pa.scalar(None, pa.int64()), pc.utf8_length(x.cast(pa.large_string())).cast(pa.int64()))
                     for x in (prefix, middle)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, form, *chars, output.cast(pa.string())],
                                             names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(fim: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``fim`` with the column restored: the text rebuilt from output and form."""
    any_sentinel = "|".join(re.escape(s.decode()) for s in _sentinels(sentinels))
    kept = [c for c in fim.columns if c != "restored"]
    schema = fim.select(*kept).withColumn("restored", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, "output")):
            form, output = batch.column("form"), batch.column("output").cast(pa.large_binary())
            parts = pc.split_pattern_regex(pc.if_else(pc.equal(form, "plain"), pa.scalar(b"", pa.large_binary()), output),
                                           pattern=any_sentinel)
            # '', first, second, middle; a plain row has none and takes none
            n = pc.list_value_length(parts).cast(pa.int64())
            at = pc.subtract(pc.cumulative_sum(n), n)
            flat = pa.concat_arrays([pc.list_flatten(parts), pa.array([b""] * 3, pa.large_binary())])
            first, second, middle = (flat.take(pc.add(at, k)) for k in (1, 2, 3))
            is_psm = pc.equal(form, "psm")
            text = _glue(pc.if_else(is_psm, first, second), middle, pc.if_else(is_psm, second, first))
            text = pc.if_else(pc.equal(form, "plain"), output, text)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), text.cast(pa.string())], names=[*kept, "restored"])

    return fim.select(*kept).mapInArrow(run, schema)
