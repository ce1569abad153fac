"""Run registered queries in Spark and their SQL twins in DuckDB and compare
row count, column names and the multiset of rows.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tessera.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return v
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
    return v


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
                 "smallint": "SMALLINT", "tinyint": "TINYINT", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def spark_type_as_duck(t: str) -> str:
    if t.startswith("array<") and t.endswith(">"):
        return spark_type_as_duck(t[6:-1]) + "[]"
    if t.startswith("decimal"):
        return "DECIMAL"
    return SPARK_TO_DUCK.get(t, t.upper())


def type_mismatches(sdf, res):
    duck = {d[0]: str(d[1]) for d in res.description}
    out = []
    for name, t in sdf.dtypes:
        dt_ = duck.get(name, "?")
        st = spark_type_as_duck(t)
        if not (dt_ == st or (st == "DECIMAL" and dt_.startswith("DECIMAL"))):
            out.append((name, t, dt_))
    return out


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, q, sf_dir):
    t0 = time.time()
    sdf = q.build(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if not q.sql:
        return {"name": name, "status": "no-sql", "rows": len(srows), "spark_s": round(t1 - t0, 2)}
    res = con.execute(q.oracle)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    out = {"name": name, "rows": len(srows), "oracle_rows": len(drows), "spark_s": round(t1 - t0, 2)}
    if sorted(scols) != sorted(dcols):
        out.update(status="cols", spark_cols=scols, oracle_cols=dcols)
        return out
    tm = type_mismatches(sdf, res)
    if tm:
        out["types"] = tm
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    if a == b:
        out["status"] = "ok"
    else:
        out["status"] = "values"
        sa, sb = set(a), set(b)
        out["only_spark"] = [x for x in a if x not in sb][:3]
        out["only_oracle"] = [x for x in b if x not in sa][:3]
        out["cols_sorted"] = sorted(scols)
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from tessera.session import get_spark
    from tessera.plans.registry import load_all
    spark = get_spark("local[8]", 8)
    con = duck(sf_dir)
    qs = load_all()
    bad = 0
    for name, q in qs.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, name, q, sf_dir)
        except Exception as e:  # report and continue
            r = {"name": name, "status": "error", "error": repr(e)[:400]}
        if r["status"] not in ("ok", "no-sql"):
            bad += 1
        print(r, flush=True)
    print(f"done: {len(qs)} queries, {bad} not ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
