"""Run a query and its SQL twin and compare names, types and values exactly."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _plain(row):
    return tuple(None if isinstance(v, float) and math.isnan(v) else v for v in row)


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    names = sorted(df.columns)
    result = con.execute(sql)
    cols = {d[0]: str(d[1]) for d in result.description}
    if sorted(cols) != names:
        return f"columns: only Spark {set(names) - set(cols)}, only SQL {set(cols) - set(names)}"
    types = dict(df.dtypes)
    wrong = {n: (types[n], cols[n]) for n in names if KINDS.get(types[n], types[n]) != cols[n]}
    order = [list(cols).index(n) for n in names]
    expected = sorted((_plain([r[i] for i in order]) for r in result.fetchall()), key=_key)
    got = sorted((_plain(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=_key)
    if wrong:
        return f"types: {wrong}"
    if len(got) != len(expected):
        return f"rows: {len(got)} against {len(expected)}"
    bad = [(a, b) for a, b in zip(got, expected) if a != b]
    return f"{len(bad)} rows differ, first {names}: {bad[0]}" if bad else None
