"""Summarise the physical plans of the fact aggregates (the only steps that touch the big tables).

Usage: python tools/plan_report.py [sf_dir]  -> markdown on stdout
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scenaria.plans import bindings as B  # noqa: E402
from scenaria.session import get_spark  # noqa: E402


def lazy_facts(spark, d):
    """The fact aggregates before they are written (the plans that scan the fact tables)."""
    from pyspark.sql import functions as F

    j = B._orders_by_nation(spark, d)
    alloc = F.col("o_orderstatus") != F.lit("P")
    stim = j.groupBy("country_code").agg(F.sum(F.when(alloc, F.col("cents"))).alias("total"))
    return {"orders by nation (stimulus parts)": stim, "lineitem by investment roles": B.invest_cells_plan(spark, d)}


def summary(df) -> dict:
    p = df._jdf.queryExecution().executedPlan().toString()
    return {
        "exchanges": len(re.findall(r"Exchange hashpartitioning", p)),
        "broadcast_exchanges": p.count("BroadcastExchange"),
        "joins": sorted(set(re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin)", p))),
        "partial_agg": "partial_" in p,
        "windows": p.count("Window ["),
        "scans": [(m.group(1).rsplit("/", 1)[-1], m.group(2)) for m in
                  re.finditer(r"FileScan parquet \[[^\]]*\].*?Location: [^\[]*\[[^\]]*?([\w]+\.parquet)\].*?ReadSchema: (struct<[^>]*>)", p)],
        "pushed": re.findall(r"PushedFilters: (\[[^\]]*\])", p),
    }


def main():
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # show the plan a 100 TB table gets
    print("| Fact step | Shuffles (hash) | Broadcasts | Joins | Partial agg | Windows | Scans (ReadSchema) |")
    print("|---|---|---|---|---|---|---|")
    for name, df in lazy_facts(spark, d).items():
        s = summary(df)
        scans = "; ".join(f"{t}: {r}" for t, r in s["scans"])
        print(f"| {name} | {s['exchanges']} | {s['broadcast_exchanges']} | {', '.join(s['joins'])} | {s['partial_agg']} "
              f"| {s['windows']} | {scans} |")


if __name__ == "__main__":
    main()
