"""Runs a query's SQL with DuckDB over the tables of a folder, or over given frames."""

import glob

import duckdb


def rows(sql, sf_dir=None, **tables):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet") if sf_dir else []:
        c.sql(f"CREATE VIEW {f.rsplit('/', 1)[1][:-8]} AS SELECT * FROM read_parquet('{f}')")
    for name, frame in tables.items():
        c.register(name, frame)
    r = c.sql(sql)
    order = sorted(range(len(r.columns)), key=lambda i: r.columns[i])
    return [r.columns[i] for i in order], sorted((tuple(x[i] for i in order) for x in r.fetchall()), key=repr)


def of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
