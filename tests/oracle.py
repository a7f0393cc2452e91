"""Compare registered queries with their DuckDB SQL: columns by name, rows in any order."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(x):
    return round(x, 9) if isinstance(x, float) and not math.isnan(x) else str(x) if isinstance(x, float) else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def both(spark, con, sf_dir, run, sql):
    df = run(spark, sf_dir)
    cur = con.execute(sql)
    return rows(df.columns, df.collect()), rows([d[0] for d in cur.description], cur.fetchall())
