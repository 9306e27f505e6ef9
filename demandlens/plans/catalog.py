"""Registry of named queries and the per-session cache of built layers."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from ..session import app_id
from ..sources import load_model
from .queries import QUERIES
from .storeday import Layer, build_layer

_LOCK = threading.Lock()
_LAYERS: dict = {}


def layer_for(spark: SparkSession, sf_dir: str, materialise: bool = True) -> Layer:
    """Build the layer for the driver's tables once per (application, folder, mode)."""
    key = (app_id(spark), sf_dir.rstrip("/"), materialise)
    with _LOCK:
        if key not in _LAYERS:
            _LAYERS[key] = build_layer(load_model(spark, sf_dir, binding="tpch"), spark, materialise=materialise)
        return _LAYERS[key]


def forget_layers() -> None:
    with _LOCK:
        _LAYERS.clear()


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return QUERIES[name](layer_for(spark, sf_dir))


def names() -> list[str]:
    return list(QUERIES)


# Names of the analytical views and tables as the source analysis exposes them (fixed values).
VIEW_NAMES = {
    "stores": "stores", "train": "train", "transactions": "transactions",
    "holidays_events": "holidays_events", "oil": "oil",
    "v1_store_day_metrics": "vw_store_day_metrics", "v2_oil_prices_filled": "vw_oil_prices_filled",
    "v3_store_day_enriched": "vw_store_day_enriched", "v4_store_holiday_map": "vw_store_holiday_map",
    "v5_store_day_context": "vw_store_day_context",
}


def register_views(layer: Layer) -> list[str]:
    """Expose the model tables and the five views as temporary views of the session, so
    ad-hoc Spark SQL can run against the same names the source analysis uses."""
    for name in ("stores", "train", "transactions", "holidays_events", "oil"):
        layer.model.table(name).createOrReplaceTempView(VIEW_NAMES[name])
    for key in ("v1_store_day_metrics", "v2_oil_prices_filled", "v3_store_day_enriched",
                "v4_store_holiday_map", "v5_store_day_context"):
        QUERIES[key](layer).createOrReplaceTempView(VIEW_NAMES[key])
    return list(VIEW_NAMES.values())
