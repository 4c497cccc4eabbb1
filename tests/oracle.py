"""Holds a Spark result against SQL that DuckDB runs on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(frame):
    cols = sorted(frame.columns)
    return sorted(map(repr, (tuple(r[c] for c in cols) for r in frame.to_dict("records"))))


def same(spark_df, con, sql):
    got = [tuple(r) for r in spark_df.select(*sorted(spark_df.columns)).collect()]
    rel = con.sql(sql)
    names = sorted(rel.columns)
    assert names == sorted(spark_df.columns)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    assert len(got) == len(want)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
