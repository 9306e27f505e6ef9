"""demandlens: Spark-native retail demand and revenue analytics.

    from demandlens import get_session, load_model, build_layer, QUERIES, register_views

    spark = get_session()
    layer = build_layer(load_model(spark, "/data/store-sales", fmt="csv"), spark)
    QUERIES["q13_holiday_lift"](layer).show()
"""

from .plans.catalog import register_views
from .plans.queries import QUERIES
from .plans.storeday import Layer, build_layer, refresh_layer
from .session import cluster_conf, get_session
from .sources import Model, load_model

__all__ = ["QUERIES", "Layer", "Model", "build_layer", "cluster_conf", "get_session",
           "load_model", "refresh_layer", "register_views"]
