"""Spark result against DuckDB result, as multisets of rows with columns sorted by name."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def multiset(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = multiset(names, res.fetchall())
    got = multiset(df.columns, [tuple(r) for r in df.collect()])
    out = []
    if sorted(names) != sorted(df.columns):
        out.append(f"columns: spark {sorted(df.columns)} sql {sorted(names)}")
    if got.total() != want.total():
        out.append(f"rows: spark {got.total()} sql {want.total()}")
    if got != want:
        out.append(f"only spark {(got - want).total()}: {list((got - want))[:2]}; only sql {(want - got).total()}: {list((want - got))[:2]}")
    return out
