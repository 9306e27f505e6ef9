"""Corpus pipeline: raw documents to packed training sequences.

Stages, each on all rows its predecessor kept, written as Parquet and read again in between:

1. toxicity: documents with a toxicity score of 0.5 or more go (model trained from ``labels``;
   where the labels hold one class only, or none, nothing is learned and no document goes);
2. near_duplicates: of each component of documents linked by a Jaccard similarity of 0.8 or more
   on five-word shingles, the smallest doc_id stays;
3. substring_dedup: words in 13-word windows that also start in a smaller document go, and with
   them documents of which no word is left; untouched documents keep their text as it is;
4. decontamination: documents that hold a window of a ``benchmark`` item go;
5. packing: the rest becomes sequences of at most 2048 tokens; one row a piece.

Defined cases, in every stage: extra columns of the input are dropped, so they cannot clash; an
empty table gives an empty table. Null, empty and wordless texts score as the median clean
text, have no shingle, window or benchmark word and so pass to the packing; a null text is an
empty one from substring_dedup on; texts of any length are read whole. A repeated row stays once if it has a word (its
copies are near duplicates of each other), else as often as it is there; a null doc_id is the
last to represent its component and never an earlier document of a window. An empty ``benchmark``
takes nothing away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm import decontaminate, jaccard, packing, substring, toxicity
from demandlens.llm.common import ship, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def bounded(spark: SparkSession) -> None:
    """Rows with whole texts go to Python, and to row groups, in small runs."""
    ship(spark, 1000)
    spark.conf.set("parquet.block.size", str(32 << 20))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(5, 0))
    if model.constant is not None:
        return docs.select(*COLUMNS)
    return toxicity.score(docs, model, keep=COLUMNS).filter(F.col("score") < 0.5).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return jaccard.representatives(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_repeated_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    found = substring.remove(docs, keep=("lang", "source", "n_chars"))
    left = (F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))
    length = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return found.filter(left).withColumn("n_chars", length.cast("long")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates),
          ("substring_dedup", drop_repeated_windows), ("decontamination", drop_contaminated),
          ("packing", pack_sequences)]

# A trained model and a tokenizer decide: no SQL. tests/llm/test_pipeline.py checks every stage, and the
# whole run, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
