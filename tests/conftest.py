from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from demandlens.session import get_session  # noqa: E402
from demandlens.sources.model import Model, SCHEMAS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", 4, app_name="demandlens-tests")
    yield s
    s.stop()


def D(x: str) -> dt.date:
    return dt.date.fromisoformat(x)


def M(x) -> Decimal:
    return Decimal(str(x))


# Stores of the micro fixtures: 1, 2 in Quito (Pichincha), 3 in Guayaquil (Guayas).
STORES = [(1, "Quito", "Pichincha", "A", 1), (2, "Quito", "Pichincha", "B", 1),
          (3, "Guayaquil", "Guayas", "A", 2)]


def make_model(spark, train, stores=STORES, transactions=(), holidays=(), oil=()) -> Model:
    """Build a Model from literal rows. ``train`` rows: (date, store, family, sales, promo)."""
    train_rows = [(i + 1, D(d) if isinstance(d, str) else d, s, f, M(v), p)
                  for i, (d, s, f, v, p) in enumerate(train)]
    tx_rows = [(D(d), s, n) for d, s, n in transactions]
    hol_rows = [(D(d), t, loc, name, desc, tr) for d, t, loc, name, desc, tr in holidays]
    oil_rows = [(D(d), None if p is None else M(p)) for d, p in oil]
    mk = lambda rows, name: spark.createDataFrame(list(rows), SCHEMAS[name])
    return Model(stores=mk(stores, "stores"), train=mk(train_rows, "train"),
                 transactions=mk(tx_rows, "transactions"), holidays=mk(hol_rows, "holidays_events"),
                 oil=mk(oil_rows, "oil"), origin="fixture")
