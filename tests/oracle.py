"""Compare a query's rows with those of its SQL in DuckDB, in any order."""

import datetime
import os

import duckdb

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or hasattr(value, "dtype") or type(value).__name__ == "Decimal":
        return round(float(value), 6) + 0.0
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


def same(found, expected):
    """Equal, but for what a sum in another order can do to the last rounded digit."""
    if len(found) != len(expected):
        return False
    return all(a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1.1e-6 * max(1, abs(a)) for x, y in zip(found, expected) for a, b in zip(x, y))


def check(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    df = query(spark, sf)
    got = rows_of(df.columns, df.collect())
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(df.columns)
    assert same(got, rows_of(names, answer.fetchall()))
