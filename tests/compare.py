"""Run registered queries against their SQL in DuckDB. Usage: python tests/compare.py SF [name-prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v, digits=5):
    if v is None or v is pd.NaT:
        return None
    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, digits) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, digits) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def close(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-5 + 1e-9 * abs(a)
    return a == b and type(a) is type(b)


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
         "TIMESTAMP": "timestamp", "DATE": "date", "FLOAT": "float"}


def check(spark, con, name, sf_dir, queries, oracles):
    df = queries[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name not in oracles:
        return len(got), None
    rel = con.execute(oracles[name])
    cols = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    if sorted(cols) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} vs {sorted(cols)}"
    bad = [
        (c, t, types[c]) for c, t in df.dtypes
        if types[c] in KINDS and KINDS[types[c]] != t or types[c].startswith(("DECIMAL", "HUGEINT"))
    ]
    if bad:
        return len(got), f"types {bad}"
    if len(got) != len(want):
        return len(got), f"rows {len(got)} vs {len(want)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    real = [(x, y) for x, y in diff if not all(close(p, q) for p, q in zip(x, y))]
    if real:
        return len(got), f"{len(real)} rows differ, first {real[0]}"
    if diff:
        return len(got), f"NEAR {len(diff)} rows at rounding edge, first {diff[0]}"
    return len(got), ""


def main():
    import __spark_entry__ as entry
    from stratafold.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    prefixes = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, orc = entry.queries(), entry.oracle_sql()
    fails, slow = [], []
    for name in sorted(qs):
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            n, msg = check(spark, con, name, sf_dir, qs, orc)
        except Exception as e:  # report and go on to the next query
            n, msg = -1, f"ERROR {type(e).__name__}: {str(e)[:600]}"
        dt = time.time() - t
        slow.append((dt, name))
        state = "rows-only" if msg is None else ("ok" if msg == "" else "FAIL " + msg)
        if msg:
            fails.append(name)
        if n == 0:
            state += " EMPTY"
        print(f"{name:8s} {dt:6.2f}s {n:8d} {state}", flush=True)
    print("slowest", [(n, round(d, 1)) for d, n in sorted(slow, reverse=True)[:8]])
    print("failed", fails)


if __name__ == "__main__":
    main()
