"""Benchmark decontamination: a prefix-filtered set join in DataFrame operations only.

A window of an item is a set of positioned shingles (``shingle`` consecutive words). A document
that holds the window holds all of them, so a prefix of one shingle is enough to find it: the
window's rarest, by occurrences over all documents. Document shingles are joined with those
prefix shingles; a match at document position p and window offset o can only be the window that
starts at p - o, which must lie within the document (length and positional bounds); its words
are then compared with the window's, all of them.

The prefix shingles are 8-byte hashes. When their written table is within the session's broadcast
threshold, document shingles are filtered by them as the document streams by, and a match takes
along the few words around it. Beyond that size (position, hash) rows are joined by a shuffle and
the matches joined back to their documents, so that no word array is shuffled a position.

Defined cases: null or wordless texts of documents have no words and no hits, those of items no
windows; an item with fewer words than a window is one window; rows that repeat doc_id and text
have equal results, rows that repeat only doc_id are judged each by its own text; items that
share an item_id count once; a null item_id is left out of the item list but its windows hit;
empty tables give no rows or no hits; only doc_id, text and item_id are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, text_key, written

WINDOW, SHINGLE = 10, 3
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str = "text") -> Column:
    """Words of a text: A-Z lower-cased, split at everything ASCII that is no letter or digit."""
    found = F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), _SPLIT)
    return F.array_remove(found, "")


def _hash(array: str, start: Column, n: int) -> Column:
    """Hash of ``n`` words of an array column from a 1-based position."""
    return F.xxhash64(*[F.element_at(array, start + i) for i in range(n)])


def windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, w, n) and the items that hold them (wid, item)."""
    split = (items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
             .select("item", words().alias("all")).filter(F.size("all") > 0))
    last = F.greatest(F.size("all") - window, F.lit(0))
    each = split.select("item", F.explode(F.transform(F.sequence(F.lit(0), last),
                                                      lambda i: F.slice(F.col("all"), i + 1, window))).alias("w"))
    each = written(each.withColumn("wid", F.md5(F.array_join("w", " "))).distinct(), "benchmark-windows")
    return (each.groupBy("wid").agg(F.first("w").alias("w")).withColumn("n", F.size("w")),
            each.filter(F.col("item").isNotNull()).select("wid", "item").distinct())


def _positions(docs: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """Every shingle of ``size`` words of the documents: ``keep``, p (from 0), sh."""
    at = docs.select(*keep, F.posexplode("words").alias("p", "first"))
    whole = at.filter(F.col("p") + size <= F.size("words"))
    return whole.withColumn("sh", _hash("words", F.col("p") + 1, size))


def _frequencies(split: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """Occurrences (sh, freq) over all documents of the shingles in ``wanted`` (distinct, written).

    Occurrences are counted by task before they are dealt by shingle, so a shingle that a third of
    the documents hold is one row a task. Within the broadcast threshold other shingles are left
    out before that, beyond it after."""
    at = _positions(split, size, ["words"]).select("sh")
    small = _fits_broadcast(split.sparkSession, wanted)
    if small:
        at = at.join(F.broadcast(wanted), "sh", "left_semi")
    count = at.groupBy("sh").agg(F.count("*").alias("freq"))
    return count if small else count.join(wanted, "sh", "left_semi")


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Occurrences (doc_id, tk, start from 0, n, wid) of item windows in documents, and (wid, item)."""
    spark = docs.sparkSession
    found, holders = windows(items, window)
    split = id_text(docs).select("doc_id", text_key().alias("tk"), words().alias("words"))
    # a window of fewer words than a shingle is one shingle; sizes: at most ``shingle`` different ones
    shingles = found.withColumn("size", F.least(F.col("n"), F.lit(shingle)))
    out = None
    for size in sorted(r["size"] for r in shingles.select("size").distinct().collect()):
        own = shingles.filter(F.col("size") == size).select(
            "wid", "w", "n", F.posexplode(F.sequence(F.lit(1), F.col("n") - size + 1)).alias("o", "from"))
        own = own.withColumn("sh", _hash("w", F.col("from"), size)).drop("from")
        own = written(own, f"benchmark-shingles-{size}")
        count = _frequencies(split.select("words"), size, written(own.select("sh").distinct(), f"benchmark-sh-{size}"))
        # rarest first; a window whose rarest shingle never occurs occurs nowhere
        rank = F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "sh", "o")
        prefix = (own.join(count, "sh", "left").groupBy("wid").agg(F.min(rank).alias("r"), F.first("w").alias("w"),
                                                                 F.first("n").alias("n"))
                  .filter(F.col("r.freq") > 0).select("wid", "w", "n", F.col("r.sh").alias("sh"), F.col("r.o").alias("o")))
        prefix = written(prefix, f"benchmark-prefix-{size}")
        keys = written(prefix.select("sh").distinct(), f"benchmark-keys-{size}")
        begin = F.col("p") - F.col("o")
        inside = (begin >= 0) & (begin + F.col("n") <= F.col("n_words"))
        reach = window - size                               # largest offset of a shingle in a window
        low = F.greatest(F.col("p") - reach, F.lit(0))
        if _fits_broadcast(spark, keys):
            near = (_positions(split, size, ["doc_id", "tk", "words"]).join(F.broadcast(keys), "sh", "left_semi")
                    .select("doc_id", "tk", "p", "sh", F.size("words").alias("n_words"),
                            F.slice("words", low + 1, F.lit(2 * window)).alias("around")))
            same = F.slice("around", begin - low + 1, F.col("n")) == F.col("w")
            match = near.join(prefix, "sh").filter(inside).filter(same).select(
                "doc_id", "tk", begin.alias("start"), "n", "wid")
        else:
            near = (_positions(split, size, ["doc_id", "tk", "words"]).select("doc_id", "tk", "p", "sh", F.size("words").alias("n_words"))
                    .join(prefix, "sh").filter(inside).select("doc_id", "tk", begin.alias("start"), "n", "wid", "w"))
            near = near.groupBy("doc_id", "tk").agg(F.collect_set(F.struct("start", "n", "wid", "w")).alias("c"))
            same_row = F.col("s.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("s.tk") == F.col("m.tk"))
            back = (split.dropDuplicates(["doc_id", "tk"]).alias("s").join(near.alias("m"), same_row)
                    .select("s.doc_id", "s.tk", "words", F.explode("c").alias("c")).select("doc_id", "tk", "words", "c.*"))
            match = back.filter(F.slice("words", F.col("start") + 1, F.col("n")) == F.col("w")).select(
                "doc_id", "tk", "start", "n", "wid")
        out = match if out is None else out.unionByName(match)
    if out is None:
        out = spark.createDataFrame([], "doc_id long, tk long, start int, n int, wid string")
    return written(out.distinct(), "benchmark-hits"), holders


def _fits_broadcast(spark, table: DataFrame) -> bool:
    """The planner's own size check, on the written table's files."""
    limit = int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= limit


def _covered(spans: str) -> Column:
    """Positions covered by sorted (start, n) spans, overlaps once."""
    step = F.aggregate(
        spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["n"]).alias("end"),
                              (a["n"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(a["end"], s["start"]))).alias("n")))
    return step["n"]


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings), spans of the hits, for every row."""
    found, holders = hits(docs, items, window, shingle)
    spans = (found.groupBy("doc_id", "tk").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"))
             .withColumn("n_hit", _covered("spans").cast("long")))
    held = (found.select("doc_id", "tk", "wid").distinct().join(holders, "wid").groupBy("doc_id", "tk")
            .agg(F.sort_array(F.collect_set("item")).alias("item_ids")))
    per = spans.alias("s").join(held.alias("h"), F.col("s.doc_id").eqNullSafe(F.col("h.doc_id"))
                                & (F.col("s.tk") == F.col("h.tk")), "left").select("s.*", "h.item_ids")
    rows = id_text(docs).select("doc_id", text_key().alias("tk"), F.size(words()).cast("long").alias("n_words"))
    return (rows.alias("d").join(per.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))
                                 & (F.col("d.tk") == F.col("p.tk")), "left")
            .select("d.doc_id", "d.tk", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "spans"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item window occurs."""
    found, _ = hits(docs, items, window, shingle)
    bad = found.select("doc_id", "tk").distinct().alias("b")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("b.doc_id")) & (text_key("d.text") == F.col("b.tk"))
    return docs.alias("d").join(bad, same, "left_anti")
