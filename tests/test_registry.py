import duckdb
import pytest

from leafseek import queries

DATA = "/root/testdata/sf0.001"
NAMES = sorted(queries.queries())


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    from leafseek.session import ship

    ship(spark)
    con = duckdb.connect()
    for table in ("documents", "conversations", "benchmark", "pages", "labels"):
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    df = queries.queries()[name](spark, DATA)
    expected = con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    rows = sorted(df.select(columns).collect(), key=repr)
    assert [tuple(r) for r in rows] == sorted(expected.project(", ".join(columns)).fetchall(), key=repr) or sorted(map(repr, map(tuple, rows))) == sorted(map(repr, expected.project(", ".join(columns)).fetchall()))


def test_each_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())
