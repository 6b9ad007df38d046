"""Side-by-side comparison of a Spark query with its DuckDB oracle."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def duck_rows(sql, sf_dir, threads=4):
    con = duckdb.connect()
    con.execute(f"SET threads={threads}; SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def compare(df, sql, sf_dir):
    """None when equal, else what differs first."""
    a, b = spark_rows(df), duck_rows(sql, sf_dir)
    if a[0] != b[0]:
        return f"columns {a[0]} / {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} / {len(b[1])}"
    for x, y in zip(a[1], b[1], strict=True):
        if x != y:
            return f"{x} / {y}"
    return None
