"""Compare registered queries with their SQL: ``python tests/check.py [sf] [name ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from tests.oracle import compare, connect
from tidemark.session import build_session

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            if name in oracles:
                ok, text = compare(fn(spark, sf_dir), con, oracles[name])
            else:
                ok, text = True, f"{fn(spark, sf_dir).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            ok, text = False, f"{type(e).__name__}: {str(e)[:1200]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.2f}s {text[:2500]}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
