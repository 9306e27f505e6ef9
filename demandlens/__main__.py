"""Command line: build the store-day layer and write query results.

    python -m demandlens --input DIR [--binding retail|tpch] [--fmt csv|parquet]
                         [--queries q13_holiday_lift,q14_event_lift | all]
                         (--out DIR [--as parquet|csv] | --explain)
"""

from __future__ import annotations

import argparse

from .plans.queries import QUERIES
from .plans.storeday import build_layer
from .session import get_session
from .sources import load_model


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="demandlens")
    ap.add_argument("--input", required=True, help="folder of the five tables (or the TPC-H test tables)")
    ap.add_argument("--binding", default="retail", choices=["retail", "tpch"])
    ap.add_argument("--fmt", default="csv", choices=["csv", "parquet"], help="format of the retail files")
    ap.add_argument("--queries", default="all", help="comma-separated query names, or 'all'")
    ap.add_argument("--out", help="output folder (one sub-folder per query)")
    ap.add_argument("--explain", action="store_true",
                    help="print each query's formatted physical plan instead of writing it")
    ap.add_argument("--as", dest="out_format", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--master", default=None, help="Spark master for local runs, e.g. local[8]")
    ap.add_argument("--collation", default=None, help="e.g. UNICODE_CI_AI for locale matching")
    a = ap.parse_args(argv)

    if not a.out and not a.explain:
        ap.error("--out is required unless --explain is given")
    names = list(QUERIES) if a.queries == "all" else [q.strip() for q in a.queries.split(",")]
    unknown = [n for n in names if n not in QUERIES]
    if unknown:
        ap.error(f"unknown queries: {', '.join(unknown)}")
    spark = get_session(a.master)
    layer = build_layer(load_model(spark, a.input, a.binding, a.fmt), spark, collation=a.collation)
    for name in names:
        if a.explain:
            print(f"== {name} ==")
            QUERIES[name](layer).explain("formatted")
            continue
        w = QUERIES[name](layer).write.mode("overwrite")
        path = f"{a.out.rstrip('/')}/{name}"
        (w.option("header", True).csv(path) if a.out_format == "csv" else w.parquet(path))
        print(f"{name} -> {path}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
