"""Spark's rows against DuckDB's."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/**' if os.path.isdir(p) else ''}')")
    return con


def assert_same(spark_df, con, sql):
    """Equal names and equal rows, nulls and repeats included, in any order."""
    names = sorted(spark_df.columns)
    wanted = con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    assert sorted(d[0] for d in con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description) == names
    got, want = (sorted(tuple(map(repr, r)) for r in found) for found in (spark_df.select(*names).collect(), wanted))
    assert got == want
