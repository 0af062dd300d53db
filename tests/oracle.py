"""Holds a query's rows against its SQL in DuckDB."""

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        found = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{found}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(row[k]) for k in order) for row in found)


def compare(spark, name, query, sql, sf_dir):
    df = query(spark, str(sf_dir))
    con = connect(sf_dir)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns), (name, sorted(df.columns), sorted(columns))
    ours, theirs = rows(df.columns, map(tuple, df.collect())), rows(columns, cursor.fetchall())
    assert ours == theirs, (name, list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
    assert ours, name
