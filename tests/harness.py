"""Compares a query's rows with its SQL's, whatever their order."""

from __future__ import annotations

import math


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "as_tuple"):
        x = float(x)
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, bool):
        return x
    if isinstance(x, int):
        return float(x)
    return x


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in r))


def spark_table(df):
    return table_of(df.columns, [tuple(r) for r in df.collect()])


def duck_table(con, sql):
    rel = con.sql(sql)
    return table_of(rel.columns, rel.fetchall())
