"""Source divergence audit: how far the words of each source lie from its language and from the others.

Identical texts of a language are one text with the number of its copies in each source. Each is
split into terms once, in Arrow batches; its counts and document frequencies are added weighted by
the copies. A language keeps the terms of at least ``min_docs`` documents. Shares are whole
parts of 10^9, smoothed by 2 for every kept term, and all arithmetic is exact in 64 bits (shares
in 38 decimal digits before they are divided).

The divergence of two shares is floor((p - q)^2 / (p + q)). For a pair of sources only the terms
that both have are visited: a term that one lacks depends on its count in the other alone, so
those are summed over the histogram of a source's shares, and terms that both lack are one product.

Everything is keyed by (lang, text), (lang, source, term) or (lang, source) and combined before it is
shuffled; nothing is collected. Result rows per language: one for each ordered pair of its
sources, and ``top`` terms for each source.

Defined cases: null text, lang and source are empty strings; a group without terms has its rows; with
no kept term all pair values are 0 and there are no term rows; an empty table gives no rows; only
text, lang and source are read; repeated rows count each.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_slices, written

#: Bytes of terms as they are counted; all others end a term.
_LOWER = bytes(32 if b < 128 and not chr(b).isalpha() else b | 32 if chr(b) in string.ascii_uppercase else b for b in range(256))
PARTS = 1_000_000_000
#: Pairs of cells and rows of counts that a task holds at once.
PAIRS = 1 << 20
ROWS = 1 << 20


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms, the number of each term in text order, and of the text it is in."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    lowered = data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes().translate(_LOWER) if data else b""
    own = pa.py_buffer(np.ascontiguousarray(offsets - offsets[0]))
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, own, pa.py_buffer(lowered)])
    lists = pc.split_pattern(texts, pattern=b" ")
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(real).dictionary_encode()
    return (coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
            parent.filter(real).to_numpy(zero_copy_only=False).astype(np.int64))


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each range in turn."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


def collapsed(docs: DataFrame) -> DataFrame:
    """lang, text, sources, copies: each distinct text of a language with its copies by source. The
    texts are shuffled once, the copies with them as counts by digest."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    texts = rows.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    copies = (rows.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("c")))
    return (texts.join(copies.hint("merge"), ["lang", "digest"])        # both lie by (lang, digest) already
            .select("lang", "text", F.col("c.source").alias("sources"), F.col("c.n").alias("copies")))


def term_counts(texts: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term), lying by (lang, term)."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, "text")):
            terms, number, of = split_terms(batch.column("text"))
            if not len(number):
                continue
            key, n = np.unique(of * len(terms) + number, return_counts=True)     # one a (text, term)
            of, number = np.divmod(key, len(terms))
            lists = batch.column("sources")
            width = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.cumsum(width) - width
            langs = batch.column("lang").dictionary_encode()
            sources = lists.flatten().dictionary_encode()
            copies = batch.column("copies").flatten().to_numpy(zero_copy_only=False)
            at = ranges(begin[of], width[of])                                    # a (text, term, source) each
            of, number, n = (np.repeat(x, width[of]) for x in (of, number, n))
            lang, source = langs.indices.to_numpy()[of].astype(np.int64), sources.indices.to_numpy()[at].astype(np.int64)
            key = (lang * len(sources.dictionary) + source) * len(terms) + number
            key, place = np.unique(key, return_inverse=True)
            total = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            np.add.at(total[0], place, n * copies[at])
            np.add.at(total[1], place, copies[at])
            rest, number = np.divmod(key, len(terms))
            lang, source = np.divmod(rest, len(sources.dictionary))
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)),
                 terms.take(pa.array(number)).cast(pa.string()), pa.array(total[0]), pa.array(total[1])],
                names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in counted(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows >= ROWS:
                both = _added(held)
                if both.num_rows < ROWS // 2:             # they combine well: go on
                    held, rows = both.to_batches(), both.num_rows
                else:
                    yield from both.to_batches()
                    held, rows = [], 0
        if held:
            yield from _added(held).to_batches()

    # combined by task, then dealt by (lang, term): the sums by source and by language need no other shuffle
    found = texts.mapInArrow(run, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _added(counts: list[pa.RecordBatch]) -> pa.Table:
    sums = pa.Table.from_batches(counts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return sums.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"]).combine_chunks()


def share(count, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * kept)), exact."""
    top = (F.lit(PARTS).cast("decimal(10,0)") * (F.lit(count) if isinstance(count, int) else count).cast("decimal(19,0)")
           + F.lit(2 * PARTS).cast("decimal(11,0)"))
    return F.call_function("div", top.cast("decimal(38,0)"), (total.cast("decimal(19,0)") + 2 * kept.cast("decimal(19,0)")).cast("decimal(38,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def both_terms(cells: DataFrame) -> DataFrame:
    """lang, a, b, both, delta for pairs of sources with common terms: their number, and what they
    add to the divergence beyond a term that only one of the two has. ``cells`` has a row for each
    term with arrays of (source, p, p0); pairs are added up where they are made."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell")
            width = cell.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = cell.flatten()
            names = flat.field("source").dictionary_encode()
            source = names.indices.to_numpy().astype(np.int64)
            p, p0 = (flat.field(c).to_numpy() for c in ("p", "p0"))
            langs = batch.column("lang").dictionary_encode()
            lang = langs.indices.to_numpy().astype(np.int64)
            begin, upto = np.cumsum(width) - width, np.cumsum(width * width)
            size, found = len(names.dictionary), {}
            for a in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):          # a bounded run of pairs
                at = np.arange(a, min(a + PAIRS, int(upto[-1])))
                row = np.searchsorted(upto, at, side="right")
                i, j = np.divmod(at - (upto[row] - width[row] * width[row]), width[row])
                i, j = begin[row] + i, begin[row] + j
                less = source[i] < source[j]
                i, j, row = i[less], j[less], row[less]
                f = lambda x, y: (x - y) * (x - y) // (x + y)
                delta = f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
                key, place = np.unique((lang[row] * size + source[i]) * size + source[j], return_inverse=True)
                add = np.zeros(len(key), np.int64)
                np.add.at(add, place, delta)
                for k, d in zip(key.tolist(), add.tolist()):
                    found[k] = found.get(k, 0) + d
            if found:
                rest, b = np.divmod(np.array(list(found)), size)
                lang_of, a = np.divmod(rest, size)
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(lang_of)), names.dictionary.take(pa.array(a)),
                     names.dictionary.take(pa.array(b)), pa.array(list(found.values()), pa.int64())],
                    names=["lang", "a", "b", "delta"])

    pairs = cells.mapInArrow(run, "lang string, a string, b string, delta long")
    # one direction is evaluated, by names in the batch's own order; both are the same number
    either = pairs.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("ab"), "delta")
    return either.groupBy("lang", "ab.a", "ab.b").agg(F.sum("delta").alias("delta"))


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: item is each other source of the
    language, value the divergence summed over all kept terms. Part ``term``: item is one of the
    ``top`` terms that the source has most beyond its language, value the divergence of the two."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    kept = (term_counts(collapsed(docs)).groupBy("lang", "term")
            .agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("cell"))
            .filter(F.col("docs") >= min_docs).select("lang", "term", "lang_n", "cell"))
    kept = written(kept, "divergence-kept")
    cells = kept.select("lang", "term", "lang_n", F.inline("cell"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    # one row for every group, kept terms or not
    stats = (groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
             .na.fill(0, ["total", "own", "v", "lang_total"]))
    stats = written(stats.withColumn("p0", F.when(F.col("v") > 0, share(0, F.col("total"), F.col("v")))), "divergence-groups")
    shares = cells.join(stats, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))

    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = F.row_number().over(by_value).alias("rank")
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    terms = (shares.withColumn("q", q).filter(F.col("p") > F.col("q"))
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                     divergence(F.col("p"), F.col("q")).alias("value")))
    terms = terms.select("*", ranked).filter(F.col("rank") <= top)

    # terms that only one of two sources has: by the histogram of its shares
    bars = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k"))
    other = stats.select("lang", F.col("source").alias("b"), F.col("p0").alias("q0"))
    alone = (bars.withColumnRenamed("source", "a").join(other, "lang").filter(F.col("a") != F.col("b"))
             .groupBy("lang", "a", "b").agg(F.sum(F.col("k") * divergence(F.col("p"), F.col("q0"))).alias("alone")))
    back = alone.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col("alone").alias("alone_b"))
    both = both_terms(shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("cell")))
    one = stats.select("lang", F.col("source").alias("a"), "v", F.col("own").alias("own_a"), F.col("p0").alias("p0_a"))
    two = stats.select("lang", F.col("source").alias("b"), F.col("own").alias("own_b"), F.col("p0").alias("p0_b"))
    pairs = one.join(two, "lang").filter(F.col("a") != F.col("b"))       # the rows of the result
    for part in (alone, back, both):
        pairs = pairs.join(part, ["lang", "a", "b"], "left")
    # every common term is in both histograms and takes one lacking term of the product away too many:
    # delta holds f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
    value = F.when(F.col("v") > 0, (F.col("v") - F.col("own_a") - F.col("own_b")) * divergence(F.col("p0_a"), F.col("p0_b"))
                   + F.coalesce("alone", F.lit(0)) + F.coalesce("alone_b", F.lit(0)) + F.coalesce("delta", F.lit(0))).otherwise(F.lit(0))
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.cast("long").alias("value"))
    return terms.unionByName(pairs.select("*", ranked)).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
