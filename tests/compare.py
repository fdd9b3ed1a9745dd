"""Compares a Spark result with DuckDB SQL over the same tables, like the driver does."""

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def assert_same(df, con, sql):
    relation = con.sql(sql)
    names = list(relation.columns)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = [tuple(_plain(dict(zip(names, r))[c]) for c in order) for r in relation.fetchall()]
    got = [tuple(_plain(r[c]) for c in order) for r in df.collect()]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    want.sort(key=key)
    got.sort(key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b, (dict(zip(order, a)), dict(zip(order, b)))
