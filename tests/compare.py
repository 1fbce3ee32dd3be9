"""Compare a query with its SQL in DuckDB: columns by name, rows as a multiset."""

import glob
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            files = sorted(glob.glob(f"{p}/*.parquet")) if os.path.isdir(p) else [p]
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files!r})")
    return con


def normal(v):
    if isinstance(v, float):
        return "null" if v != v else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(normal(x) for x in v) + "]"
    return "null" if v is None else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def differences(df, con, sql):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        odd = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:3]
        return f"{len(got[1])} and {len(want[1])} rows; first differences {odd}"
    return ""
