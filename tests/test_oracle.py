"""Every query against its SQL in DuckDB, as multisets of rows."""

import math

import duckdb
import pytest

from corpusloom.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    out = QUERIES[name](spark, sf)
    got = rows_of(out.columns, [tuple(r) for r in out.collect()])
    names = [d[0] for d in duck.execute(SQL[name]).description]
    want = rows_of(names, duck.execute(SQL[name]).fetchall())
    assert sorted(out.columns) == sorted(names)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(1).count() == 1


def test_entry_point_lists_all(spark):
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.oracle_sql())
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
