from __future__ import annotations

import pytest

from demandlens.llm.common import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text) pairs, with extra columns whose names clash with internal ones."""
    def make(rows, parts=3):
        full = [(i, t, "en", "src", len(t or ""), "x", 1.0, 7) for i, t in rows]
        return spark.createDataFrame(full, DOCS + ", tk string, score double, part int").repartition(parts)
    return make
