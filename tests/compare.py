"""Run a query in Spark and its SQL twin in DuckDB and compare the rows."""

import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(directory):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return con


def _norm(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(float(f"{value:.12g}") + 0.0)
    if isinstance(value, int):
        return repr(float(value)) if abs(value) < 2**53 else repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_norm(v) for v in value) + "]"
    return str(value)


def spark_rows(df):
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    rows = sorted(tuple(_norm(r[i]) for i in order) for r in df.collect())
    return sorted(df.columns), rows


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = sorted(tuple(_norm(r[i]) for i in order) for r in cur.fetchall())
    return sorted(names), rows
