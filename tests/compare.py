"""Rows of a query and of its SQL in one comparable form."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def of_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[c]) for c in names) for r in df.collect())


def of_sql(con, sql):
    found = con.sql(sql)
    at = {c: i for i, c in enumerate(found.columns)}
    names = sorted(at)
    return names, sorted(tuple(plain(r[at[c]]) for c in names) for r in found.fetchall())
