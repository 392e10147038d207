"""Compare a query's rows with those of its SQL in DuckDB."""

import decimal
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for x in sorted(os.listdir(sf_dir)):
        con.execute(f"create view {x.removesuffix('.parquet')} as select * from '{sf_dir}/{x}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, int)):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if hasattr(v, "isoformat"):  # whole, to the microsecond; a zone is the session's, UTC
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    return str(v)


def rows_of(names, rows, cols):
    at = [names.index(c) for c in cols]
    return sorted(str(tuple(plain(r[i]) for i in at)) for r in rows)


def assert_same(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    assert rows_of(df.columns, df.collect(), cols) == rows_of(names, cur.fetchall(), cols)
