"""Compare queries with their expected SQL: python tests/check.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value)) if not float(value).is_integer() else str(int(value))
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, build, sql, sf_dir):
    start = time.time()
    df = build(spark, sf_dir)
    rows = df.collect()
    took = time.time() - start
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    got_c, got = table(df.columns, rows)
    want_c, want = table(want_cols, want)
    if got_c != want_c:
        return took, f"columns {sorted(set(got_c) ^ set(want_c))}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return took, f"rows {len(got)} vs {len(want)}; only spark {sorted(a)[:2]}; only sql {sorted(b)[:2]}; {got_c}"
    return took, f"ok {len(got)}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from poolwise.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    names = sys.argv[2:]
    spark = build_session("local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="10g",
                          spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, con, expected = f"/root/testdata/{sf}", duck(f"/root/testdata/{sf}"), e.oracle_sql()
    bad = 0
    for name, build in e.queries().items():
        if names and name not in names:
            continue
        try:
            if name in expected:
                took, result = compare(spark, con, name, build, expected[name], sf_dir)
            else:
                start = time.time()
                n = len(build(spark, sf_dir).collect())
                took, result = time.time() - start, f"ok {n} (rows only)"
        except Exception as error:  # noqa: BLE001
            took, result = 0.0, f"ERROR {type(error).__name__} {str(error)[:600]}"
        if not result.startswith("ok"):
            bad += 1
            print(f"{took:6.2f} {name}: {result}"[:1500], flush=True)
        elif names or took > 5:
            print(f"{took:6.2f} {name}: {result}", flush=True)
    print("bad", bad, "unmatched sql", sorted(set(expected) - set(e.queries())))
