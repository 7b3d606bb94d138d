"""Write PLANS.md: physical-plan shape of every catalog query (sf0.001, AQE initial plan).

    python tools/plans.py
"""

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def shape(plan: str) -> dict:
    ops = re.findall(r"[+:\- ]*([A-Z][A-Za-z]+)(?:\s|\(|\[)", plan)
    count = lambda name: sum(1 for o in ops if o == name)
    joins = sorted({o for o in ops if o.endswith("Join")})
    aggs = sorted({o for o in ops if o.endswith("Aggregate")})
    cols = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    return {"exchanges": count("Exchange") + count("BroadcastExchange"), "joins": ", ".join(joins) or "—",
            "aggregates": ", ".join(aggs) or "—", "windows": count("Window") + count("WindowGroupLimit"),
            "python": sum(map(count, ("ArrowEvalPython", "MapInArrow", "FlatMapGroupsInPandas", "FlatMapGroupsInArrow"))),
            "scan_cols": max((len(c.split(",")) for c in cols), default=0), "scans": len(cols)}


def main():
    from gustframe.plans import catalog
    from gustframe.plans.registry import REGISTRY
    from gustframe.session import get_spark
    spark = get_spark()
    rows = []
    for name, fn in catalog.queries().items():
        if not REGISTRY[name].bench:          # fits models while its plan is built
            continue
        try:
            plan = fn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        except Exception as e:  # noqa: BLE001
            rows.append(f"| {name} | error: {str(e)[:60]} |||||||")
            continue
        s = shape(plan)
        rows.append(f"| {name} | {s['exchanges']} | {s['joins']} | {s['aggregates']} | {s['windows']} | "
                    f"{s['scans']} | {s['scan_cols']} | {s['python']} |")
    lines = ["# PLANS", "", "Generated by `python tools/plans.py` from each query's physical plan (AQE initial",
             "plan at sf 0.001; AQE may still turn shuffle joins into broadcasts at run time).",
             "Exchanges = shuffles + broadcasts; scan cols = widest `ReadSchema` of the query's scans. A segmented scan or a",
             "global index checkpoints its ranged rows, so the plan shows what follows; before it come one range exchange and one",
             "`MapInArrow` for each scan.", "",
             "| query | exchanges | joins | aggregates | window ops | scans | scan cols | python nodes |",
             "| --- | --- | --- | --- | --- | --- | --- | --- |"] + rows + [""]
    open(os.path.join(ROOT, "PLANS.md"), "w").write("\n".join(lines))
    print(len(rows), "queries")


if __name__ == "__main__":
    main()
