"""Run a query's SQL in DuckDB over the same tables, and compare."""

import duckdb

from conftest import DATA

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(data=DATA):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return c


def plain(x):
    if x is None or x != x:
        return ""
    return repr(round(float(x), 6) + 0.0) if isinstance(x, float) else str(x)


def rows_of(frame):
    columns = sorted(frame.columns)
    values = [frame[c].astype(object).where(frame[c].notna(), None) for c in columns]
    return columns, sorted(tuple(map(plain, r)) for r in zip(*values, strict=True))


def frame_of(df):
    """pandas turns whole numbers with nulls into floats; DuckDB's frames keep them whole, so these do too."""
    frame = df.toPandas()
    return frame.astype({c: "Int64" for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint")})


def assert_same(spark, query, sql, data=DATA):
    got, want = rows_of(frame_of(query(spark, data))), rows_of(connect(data).sql(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
