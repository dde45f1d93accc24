"""Side-by-side run of a catalog query and its SQL twin."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, bool):
        return f"bool {value}"
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def run_sql(con, sql):
    cur = con.execute(sql)
    return canonical([d[0] for d in cur.description], cur.fetchall())


def run_query(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def differences(got, want, limit=3):
    """'' when equal, else a short report."""
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return ""
    have, need = set(map(repr, got[1])), set(map(repr, want[1]))
    report = [f"rows {len(got[1])} != {len(want[1])}"] if len(got[1]) != len(want[1]) else ["values differ"]
    report += [f"  only spark: {r[:600]}" for r in sorted(have - need)[:limit]]
    report += [f"  only sql:   {r[:600]}" for r in sorted(need - have)[:limit]]
    return "\n".join(report)
