"""Write PLANS.md: a compact summary of the physical plan of the headline
queries (shuffles, join strategies, scans with pushed filters and read
schema, Python steps). Usage: python tests/plan_report.py [sf_dir]"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summary(text: str) -> dict:
    nodes = re.findall(r"^\((\d+)\) (\w+)", text, re.M)
    kinds = [k for _, k in nodes]
    scans = []
    for block in re.split(r"\n\n", text):
        if re.match(r"^\(\d+\) Scan parquet", block.strip()):
            loc = re.search(r"Location: \w+ \[file:[^\]]*/(\w+)\.parquet\]", block)
            pf = re.search(r"PushedFilters: \[(.*)\]", block)
            rs = re.search(r"ReadSchema: struct<(.*)>", block)
            cols = [c.split(":")[0] for c in re.split(r",(?![^<]*>)", rs.group(1))] if rs else []
            scans.append((loc.group(1) if loc else "?", cols, pf.group(1) if pf else ""))
    return {
        "exchanges": sum(1 for k in kinds if k == "Exchange"),
        "broadcasts": sum(1 for k in kinds if k == "BroadcastExchange"),
        "subqueries": len(re.findall(r"^Subquery:\d+ .*Hosting Expression = Subquery", text, re.M)),
        "reused": len(re.findall(r"^Subquery:\d+ .*ReusedSubquery", text, re.M)),
        "joins": sorted({k for k in kinds if k.endswith("Join")}),
        "python": sorted({k for k in kinds if "Pandas" in k or "Python" in k or "Arrow" in k}),
        "scans": scans,
    }


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from bench import HEADLINE
    from tessera.plans.registry import load_all
    from tessera.session import get_spark
    spark = get_spark("local[8]", 16)
    qs = load_all()
    out = ["# PLANS — physical plans of the headline queries", "",
           f"Generated by `python tests/plan_report.py` on `{sf_dir}` from the final (executed) AQE plans.",
           "Shuffles are `Exchange` nodes; broadcasts are bounded dimension sides or sides AQE measured as small;",
           "scalar subqueries are statistics computed once and reused (`ReusedSubquery`). Scans list the columns",
           "read and the filters pushed into the parquet reader. Queries that use the exact quantile selection or",
           "the cooldown replay also run a few small jobs while the query is built; those are not shown.", ""]
    for name in HEADLINE:
        df = qs[name].build(spark, sf_dir)
        df.collect()  # the explain below then shows the final adaptive plan
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain(mode="formatted")
        s = summary(buf.getvalue())
        out.append(f"## {name}")
        out.append("")
        out.append(f"- shuffles: {s['exchanges']}, broadcasts: {s['broadcasts']}, joins: "
                   f"{', '.join(s['joins']) or 'none'}, scalar subqueries: {s['subqueries']} "
                   f"(+{s['reused']} reused), Python steps: {', '.join(s['python']) or 'none'}")
        for table, cols, pf in s["scans"]:
            out.append(f"- scan `{table}` columns ({len(cols)}): {', '.join(cols)}"
                       + (f"; pushed: {pf}" if pf else ""))
        out.append("")
    open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w").write(
        "\n".join(out))


if __name__ == "__main__":
    main(sys.argv)
