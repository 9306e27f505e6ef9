"""The registered queries: each applies one operator, with its production parameters, to
its whole table and derives the digest columns from the operator's outputs."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, decontaminate, divergence, exact_topk, infill, jaccard, packing, quality, rans, substring, suffixes,
               toxicity, warc)
from .common import ship, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.held_out(4, 2)
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~out)
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_token_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.encode_corpus(table(spark, sf_dir, "documents"))


def op3_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_substring_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_suffix_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove(table(spark, sf_dir, "documents")).drop("kept")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), toxicity.held_out(5, 0)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~out)
    return toxicity.score(docs, model).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill.restore(infill.transform(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                        F.sha2("restored", 256).alias("restored_sha256"))


#: operators that read partitions in blocks of their own
BY_BLOCKS = (op4_substring_sketch, op7_suffix_columns, op8_ngram_jaccard)


def _shipped(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark, 1000 if f in BY_BLOCKS else 5000)
        return f(spark, sf_dir)
    return run


OPERATORS = (op1_quality, op2_token_rans, op3_learned_partitions, op4_substring_sketch, op5_best_two_fit, op6_decontamination, op7_suffix_columns, op8_ngram_jaccard, op9_warc, op10_toxicity, op11_exact_topk, op12_divergence, op13_infill)


def queries() -> dict[str, Query]:
    return {f.__name__: _shipped(f) for f in OPERATORS}
