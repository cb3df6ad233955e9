"""Compare a query's rows with its SQL in DuckDB."""

import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connect(folder=SMALL):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{name}')")
    return con


def rows_of(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)

    def cell(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        return repr(v.tolist() if hasattr(v, "tolist") else v)

    return columns, sorted(tuple(map(cell, row)) for row in plain.itertuples(index=False))


def same(query, sql, spark, folder=SMALL):
    ours = rows_of(query(spark, folder).toPandas())
    theirs = rows_of(connect(folder).sql(sql).df())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]
