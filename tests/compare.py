"""Compare a registered query with its SQL counterpart, row by row."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

TESTDATA = os.environ.get("VAKANZ_TESTDATA", "/root/testdata")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _value(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def difference(df, con, sql):
    """``(columns equal, rows only in Spark, rows only in SQL, number of rows)``."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    expected = _rows(names, result.fetchall())
    found = _rows(df.columns, [tuple(row) for row in df.collect()])
    return sorted(names) == sorted(df.columns), found - expected, expected - found, found.total()
