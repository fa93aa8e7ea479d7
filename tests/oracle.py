"""Comparing a query's rows with the rows that DuckDB returns for its SQL."""

from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _plain(x):
    return float(x) if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([_plain(r[i]) for i in order]) for r in data)


def same(spark, sf, query, sql):
    got = query(spark, sf)
    answer = connection(sf).execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, answer.fetchall())
