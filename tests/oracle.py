"""Run a query on Spark and its SQL on DuckDB and compare them row by row."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b and type(a) is type(b)


def compare(df, con, sql: str, show: int = 5) -> tuple[bool, str]:
    rel = con.sql(sql)
    want_cols, want = rows(list(rel.columns), rel.fetchall())
    got_cols, got = rows(df.columns, df.collect())
    if want_cols != got_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if len(want) != len(got):
        extra = sorted(set(got) - set(want), key=str)[:show]
        missing = sorted(set(want) - set(got), key=str)[:show]
        return False, f"rows {len(got)} != {len(want)}\n  only spark {extra}\n  only sql {missing}"
    bad = [(g, w) for g, w in zip(got, want) if not all(same(x, y) for x, y in zip(g, w))]
    if bad:
        extra = sorted({g for g, _ in bad} - set(want), key=str)[:show]
        missing = sorted({w for _, w in bad} - set(got), key=str)[:show]
        text = "\n".join(str(r)[:300] for r in ["  only spark", *extra, "  only sql", *missing])
        return False, f"{len(bad)} of {len(got)} rows differ ({got_cols}):\n{text}"
    return True, f"{len(got)} rows"
