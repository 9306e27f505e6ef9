"""Executed-plan summary of every registered query: scans, shuffles, broadcasts,
single-partition steps and reused exchanges (after AQE has finished the plan)."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from demandlens.plans.catalog import layer_for
    from demandlens.plans.queries import QUERIES
    from demandlens.session import get_session
    spark = get_session("local[8]", 16)
    L = layer_for(spark, sf)
    print("| query | scans | shuffles | broadcasts | single-partition | reused |")
    print("|---|---|---|---|---|---|")
    for name, q in QUERIES.items():
        df = q(L)
        df.collect()
        text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        tree, _, details = text.partition("\n\n")
        final = tree.split("== Initial Plan ==")[0]            # operator tree of the final plan
        scans = len(re.findall(r"Scan parquet", final))
        exchange_ids = set(re.findall(r"(?<!Broadcast)Exchange \((\d+)\)", final))
        bcast = len(re.findall(r"BroadcastExchange \(\d+\)", final))
        single_ids = set(re.findall(r"\((\d+)\) Exchange\s*\nInput[^\n]*\nArguments: SinglePartition", details))
        shuffles = len(exchange_ids)
        single = len(exchange_ids & single_ids)
        reused = len(re.findall(r"ReusedExchange", final))
        print(f"| {name} | {scans} | {shuffles} | {bcast} | {single} | {reused} |")


if __name__ == "__main__":
    main()
