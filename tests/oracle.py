"""Compares a query with its SQL: names, number of rows, values without regard to order."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def connect(data: Path = DATA):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(data.iterdir()):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows_of(df) -> tuple[list[str], list]:
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)


def sql_rows(con, sql: str) -> tuple[list[str], list]:
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)
