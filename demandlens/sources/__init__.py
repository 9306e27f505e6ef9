"""Sources: the retail model's tables, from the published files or from the test tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .model import Model
from .retail import read_retail
from .tpch import bind_tpch


def load_model(spark: SparkSession, path: str, binding: str = "retail", fmt: str = "csv") -> Model:
    """``binding='retail'``: the five published files under ``path`` (CSV or Parquet);
    ``binding='tpch'``: derived from the TPC-H-style tables under ``path``."""
    if binding == "retail":
        return read_retail(spark, path, fmt)
    if binding == "tpch":
        return bind_tpch(spark, path)
    raise ValueError(binding)


__all__ = ["Model", "load_model", "read_retail", "bind_tpch"]
