"""Spark-vs-DuckDB comparison used by the tests and by hand:

    python tests/compare.py [sf_dir] [name ...]

Runs each catalog query in Spark and its oracle SQL in DuckDB over the same parquet files and
compares row count, column names and the multiset of rows (floats compared to 1e-9 relative).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    import datetime as dt
    import decimal

    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if os.environ.get("COMPARE_EXACT"):
            return repr(v)
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_key(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "date": "DATE", "timestamp": "TIMESTAMP", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def type_mismatches(sdf, res) -> list:
    """(column, spark type, duckdb type) for columns whose types differ."""
    d_types = {d[0]: str(d[1]).upper() for d in res.description}
    out = []
    for f in sdf.schema.fields:
        st = f.dataType.simpleString()
        want = SPARK_TO_DUCK.get(st, st.upper())
        got = d_types.get(f.name)
        if got is not None and got != want:
            out.append((f.name, st, got))
    return out


def compare_one(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    types = type_mismatches(sdf, res)
    ok_cols = sorted(s_cols) == sorted(d_cols)
    ok_n = len(s_rows) == len(d_rows)
    ok_v = ok_cols and ok_n and rows_key(s_cols, s_rows) == rows_key(d_cols, d_rows)
    return {"name": name, "cols": ok_cols, "rows": ok_n, "values": ok_v, "n_spark": len(s_rows),
            "n_duck": len(d_rows), "spark_cols": s_cols, "duck_cols": d_cols, "sec": round(t1 - t0, 2),
            "s_sample": rows_key(s_cols, s_rows)[:3], "d_sample": rows_key(d_cols, d_rows)[:3], "types": types}


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from clickstack.session import build_session

    spark = build_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in (names or list(qs)):
        if name not in sqls:
            df = qs[name](spark, sf_dir)
            n = df.count()
            print(f"ROWS-ONLY {name}: {n} rows")
            continue
        try:
            r = compare_one(spark, con, sf_dir, name, qs[name], sqls[name])
        except Exception as e:  # noqa: BLE001
            print(f"ERROR {name}: {type(e).__name__}: {str(e)[:600]}")
            bad += 1
            continue
        ok = r["values"]
        bad += 0 if ok else 1
        print(f"{'OK  ' if ok else 'FAIL'} {name}: spark={r['n_spark']} duck={r['n_duck']} {r['sec']}s")
        if r["types"]:
            print("   TYPES", r["types"])
        if not ok:
            print("   cols", r["spark_cols"], r["duck_cols"])
            print("   spark", r["s_sample"])
            print("   duck ", r["d_sample"])
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
