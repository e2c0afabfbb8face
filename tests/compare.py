"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
from datetime import date, datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def sql_rows(con, sql: str):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def spark_rows(df):
    return df.columns, [tuple(r) for r in df.collect()]


def _cell(value):
    if isinstance(value, bool) or value is None or isinstance(value, (str, date, datetime)):
        return repr(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, int):
        return repr(value)
    return repr(value)


def canonical(names, rows):
    """Column names in order and the sorted rows as text, exact to the last bit."""
    positions = sorted(range(len(names)), key=lambda i: names[i])
    cells = sorted(tuple(_cell(row[i]) for i in positions) for row in rows)
    return [names[i] for i in positions], cells


def difference(left, right) -> str | None:
    """None when equal, else a short description."""
    (ln, lr), (rn, rr) = canonical(*left), canonical(*right)
    if ln != rn:
        return f"columns {ln} and {rn}"
    if len(lr) != len(rr):
        return f"{len(lr)} and {len(rr)} rows"
    bad = [(a, b) for a, b in zip(lr, rr, strict=True) if a != b]
    return f"{len(bad)} of {len(lr)} rows differ, first {bad[0]}" if bad else None
