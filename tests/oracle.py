"""Compare a query with its DuckDB equivalent."""

import os

import duckdb


def views(d):
    c = duckdb.connect()
    for f in os.listdir(d):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{d}/{f}'")
    return c


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).lower().startswith(("float", "int", "bool", "uint")):
            df[c] = df[c].astype("Float64").round(9)
        elif str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
    return df.astype(str).replace({"nan": "-", "<NA>": "-", "None": "-", "NaT": "-"}).sort_values(list(df.columns)).reset_index(drop=True)


def same(spark, query, sql, d):
    a, b = query(spark, d).toPandas(), views(d).sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    x, y = normal(a), normal(b)
    assert len(x) == len(y)
    assert x.equals(y), (x[(x != y).any(axis=1)].head(3), y[(x != y).any(axis=1)].head(3))
