"""Runs a query and its SQL counterpart and compares their rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def rows_of(columns: list[str], rows: list) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def text(v):
        if isinstance(v, float):
            return "null" if math.isnan(v) else f"{v:.4f}"
        return "null" if v is None else str(v)

    return sorted("|".join(text(r[i]) for i in order) for r in rows)


def differences(spark, folder: str, query, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    df = query(spark, folder)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = connect(folder)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if mine != theirs:
        a, b = set(mine) - set(theirs), set(theirs) - set(mine)
        return f"{len(mine)} and {len(theirs)} rows; only here {sorted(a)[:3]}; only there {sorted(b)[:3]}"
    return ""
