"""Run registered queries and their oracle SQL side by side: python tests/oracle_check.py [sf] [name ...]"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
ROOT = "/root/testdata"


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "as_tuple"):
        return float(value)
    if isinstance(value, list):
        return tuple(normal(v) for v in value)
    return value


def compare(spark, name, folder):
    import __spark_entry__ as e

    started = time.time()
    frame = e.queries()[name](spark, folder)
    rows = [tuple(r) for r in frame.collect()]
    took = time.time() - started
    sql = e.oracle_sql().get(name)
    if sql is None:
        return f"rows-only {len(rows)} rows {took:.1f}s", bool(rows)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    started = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    duck = time.time() - started
    if sorted(names) != sorted(frame.columns):
        return f"columns differ: spark {sorted(frame.columns)} oracle {sorted(names)}", False
    order = sorted(range(len(names)), key=lambda i: names[i])
    mine = sorted(range(len(names)), key=lambda i: frame.columns[i])
    left = sorted(repr(tuple(normal(r[i]) for i in mine)) for r in rows)
    right = sorted(repr(tuple(normal(r[i]) for i in order)) for r in expected)
    if left == right:
        return f"ok {len(rows)} rows {took:.1f}s (oracle {duck:.1f}s)", bool(rows)
    only = [x for x in left if x not in set(right)][:2]
    other = [x for x in right if x not in set(left)][:2]
    return (
        f"MISMATCH spark {len(left)} oracle {len(right)}\n   spark : {[o[:700] for o in only]}"
        f"\n   oracle: {[o[:700] for o in other]}\n   cols {sorted(names)}", False,
    )


if __name__ == "__main__":
    from corpusflow.session import build_session

    import __spark_entry__ as e

    spark = build_session(
        "oracle-check", "local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions=8,
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(e.queries())
    bad = []
    for name in names:
        try:
            text, good = compare(spark, name, f"{ROOT}/sf{sf}")
        except Exception as error:  # noqa: BLE001
            text, good = f"ERROR {str(error)[:1500]}", False
        print(f"{name}: {text}", flush=True)
        if not good:
            bad.append(name)
    print("bad:", bad)
