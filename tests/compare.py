"""Order-insensitive comparison of a query with its SQL."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{root}/{name}.parquet'")
    return con


def _normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)):
        return float(value) if isinstance(value, float) else int(value)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(_normal(r[i]) for i in order) for r in rows), key=repr)


def expected(con, sql):
    result = con.execute(sql)
    return rows_of([d[0] for d in result.description], result.fetchall())


def actual(df):
    return rows_of(df.columns, df.collect())


def difference(df, con, sql) -> str | None:
    """None where both agree, else what differs."""
    names, want = expected(con, sql)
    have_names, have = actual(df)
    if names != have_names:
        return f"columns {have_names} instead of {names}"
    if len(want) != len(have):
        return f"{len(have)} rows instead of {len(want)}; only here {sorted(set(have) - set(want), key=repr)[:2]}, only there {sorted(set(want) - set(have), key=repr)[:2]}"
    wrong = [(h, w) for h, w in zip(have, want) if h != w or [type(x) for x in h] != [type(x) for x in w]]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None
