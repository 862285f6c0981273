"""Every query that has SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import duckdb
import pytest

from larkspur.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x.isoformat() if hasattr(x, "isoformat") else repr(x)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(plain, (tuple(r) for r in df.collect()))) == sorted(plain([r[i] for i in order]) for r in want.fetchall())


def test_queries_all_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
