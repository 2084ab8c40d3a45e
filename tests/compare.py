"""Spark and DuckDB rows, made comparable."""

from __future__ import annotations

import datetime
import decimal
import math

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def rows_of_spark(df):
    columns = sorted(df.columns)
    return columns, sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*columns).collect())


def rows_of_duck(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(repr(tuple(plain(r[k]) for k in at)) for r in found.fetchall())
