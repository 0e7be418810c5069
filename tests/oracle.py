"""Compare a query with its SQL, as sets of rows, whatever the order of rows and columns."""

from __future__ import annotations

import datetime
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.replace(tzinfo=None)
    return v


def sort_key(row):
    return [(v is None, str(type(v).__name__), v if v is not None else 0) for v in row]


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def differences(spark, con, query, sql, sf_dir):
    """'' if both give the same, else a description."""
    df = query(spark, sf_dir)
    a_names, a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    b_names, b = rows_of([c[0] for c in cur.description], cur.fetchall())
    if a_names != b_names:
        return f"columns {a_names} {b_names}"
    if len(a) != len(b):
        return f"rows {len(a)} {len(b)}; first of each {a[:2]} {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ: {bad[:3]} {a_names}"
    kinds = {type(v) for r in a for v in r if v is not None}, {type(v) for r in b for v in r if v is not None}
    return "" if not a or kinds[0] <= kinds[1] | {int, float, bool, str} else f"types {kinds}"
