"""Registered queries against their SQL on the driver's smallest tables, and the pipeline's stages
against plain models of what each must keep."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from demandlens.llm.oracle import ORACLE
from demandlens.llm.queries import OPERATORS

SF = os.environ.get("DEMANDLENS_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_all_operators_and_the_pipeline_are_registered():
    assert sorted(int(f.__name__[2:].split("_")[0]) for f in OPERATORS) == list(range(1, 14))
    assert {f.__name__ for f in OPERATORS} | {"pipeline"} <= set(E.queries())
    assert set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    df = E.queries()[name](spark, SF)
    rel = duck.execute(ORACLE[name])
    columns = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(r) for r in rel.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == want


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), f"test-{name}")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    order = [n for n, _ in corpus_pipeline.STAGES]
    for before, after in zip(order, order[1:]):
        assert kept[after].keys() <= kept[before].keys()
    assert len(kept["near_duplicates"]) < len(kept["toxicity"])
    assert all(r["n_chars"] == len(r["text"]) for r in kept["substring_dedup"].values())
    assert kept["packing"].keys() == kept["decontamination"].keys()
