"""Spark-vs-DuckDB comparison, the way the driver's correctness gate does it:
row count, column names (sorted) and an order-insensitive value multiset.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


DUCK_TYPES = {"BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double",
              "INTEGER": "int"}


def rows_of_spark(df):
    cols = sorted(df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return cols, [types[c] for c in cols], [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]


def rows_of_duck(con, sql):
    rel = con.sql(sql)
    names = list(rel.columns)
    types = dict(zip(names, [DUCK_TYPES.get(str(t), str(t)) for t in rel.types]))
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, [types[c] for c in cols], [tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()]


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    s_cols, s_types, s_rows = rows_of_spark(fn(spark, sf_dir))
    t1 = time.time()
    d_cols, d_types, d_rows = rows_of_duck(con, sql)
    t2 = time.time()
    ok_cols = s_cols == d_cols and s_types == d_types
    ok_n = len(s_rows) == len(d_rows)
    cs, cd = Counter(s_rows), Counter(d_rows)
    ok_v = ok_cols and cs == cd
    detail = ""
    if not ok_v:
        only_s = list((cs - cd).elements())[:2]
        only_d = list((cd - cs).elements())[:2]
        detail = f"\n   spark cols={list(zip(s_cols, s_types))}\n   duck  cols={list(zip(d_cols, d_types))}\n   only spark: {str(only_s)[:600]}\n   only duck: {str(only_d)[:600]}"
    return ok_cols and ok_n and ok_v, f"{name}: rows {len(s_rows)}/{len(d_rows)} cols {ok_cols} values {ok_v} ({t1 - t0:.1f}s spark, {t2 - t1:.1f}s duck){detail}"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = set(argv[2:])
    import __spark_entry__ as entry
    from scriptorium.session import build_session
    spark = build_session()
    con = duck_connection(sf_dir)
    qs, oracle = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in qs.items():
        if wanted and name not in wanted:
            continue
        if name not in oracle:
            df = fn(spark, sf_dir)
            print(f"{name}: rows-only {df.count()}")
            continue
        try:
            ok, msg = compare(spark, con, sf_dir, name, fn, oracle[name])
        except Exception as e:  # report and go on
            ok, msg = False, f"{name}: ERROR {str(e)[:800]}"
        print(("OK   " if ok else "FAIL ") + msg, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
