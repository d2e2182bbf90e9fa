"""Compare a Spark query with its SQL in DuckDB: columns by name, rows in any order."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{at}'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if type(v).__module__ == "decimal":
        return float(v)
    return v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in rows)


def spark_bag(df):
    return bag(df.columns, [tuple(r) for r in df.collect()])


def sql_bag(con, sql):
    cur = con.execute(sql)
    return bag([d[0] for d in cur.description], cur.fetchall())


def difference(spark_df, con, sql):
    (c1, a), (c2, b) = spark_bag(spark_df), sql_bag(con, sql)
    if c1 != c2:
        return f"columns {c1} and {c2}"
    if a != b:
        return f"rows {sum(a.values())} and {sum(b.values())}; only Spark {list((a - b).items())[:3]}; only SQL {list((b - a).items())[:3]}"
    return ""
