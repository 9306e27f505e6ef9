"""Rule tables as data: first matching (predicate, label) wins, else a default.

A predicate that evaluates to NULL does not match, so NULL inputs fall through to the
default exactly as a searched CASE does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def classify(rules, default: str) -> Column:
    expr = None
    for pred, label in rules:
        expr = F.when(pred, F.lit(label)) if expr is None else expr.when(pred, F.lit(label))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def rank_of(value: Column, order) -> Column:
    """Position of ``value`` in a fixed label order (1-based), len(order)+1 if absent."""
    expr = None
    for i, label in enumerate(order, start=1):
        expr = F.when(value == label, F.lit(i)) if expr is None else expr.when(value == label, F.lit(i))
    return expr.otherwise(F.lit(len(order) + 1))
