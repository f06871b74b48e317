"""Compare a registered query with its oracle: column names, row count and every value."""

from __future__ import annotations

import datetime
import decimal

import duckdb

from repotide.fixtures import TABLES


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, float):
        return f"f{value!r}"
    if isinstance(value, (int,)):
        return f"i{value}"
    if isinstance(value, decimal.Decimal):
        return f"d{value.normalize()}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def rows_of(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(con, df, sql: str) -> tuple[int, list[str]]:
    """(row count, problems)."""
    got = rows_of(list(df.columns), [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows_of(list(rel.columns), rel.fetchall())
    problems = []
    if sorted(df.columns) != sorted(rel.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(rel.columns)}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        only_got, only_want = set(got) - set(want), set(want) - set(got)
        problems.append(f"values differ: spark {sorted(only_got)[:2]} oracle {sorted(only_want)[:2]}")
    return len(got), problems
