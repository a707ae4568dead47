"""Runs a query beside its oracle SQL on the same tables."""

import math
import os

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels conversations benchmark pages".split()


def canon(v):
    if v is None:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    return float(v) if type(v).__name__ == "Decimal" else v


def compare(spark, f, sql, data=DATA):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    df = f(spark, data)
    got = df.collect()
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    a = sorted((tuple(canon(x) for x in r) for r in got), key=repr)
    b = sorted((tuple(canon(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b


HAVE_DATA = os.path.isdir(DATA)
