"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from quarry.plans import registry

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.collect("QUERIES"), registry.collect("SQL")


def plain(x):
    if isinstance(x, float):
        return repr(round(x, 9) + 0.0)
    if isinstance(x, list | tuple):
        return str([plain(y) for y in x])
    return str(x)


def rows_of(rows):
    return sorted(tuple(plain(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    got, columns = found.collect(), found.columns
    result = duck.execute(SQL[name])
    named = [c[0] for c in result.description]
    assert sorted(named) == sorted(columns)
    place = [named.index(c) for c in columns]
    assert rows_of(got) == rows_of([tuple(r[i] for i in place) for r in result.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
