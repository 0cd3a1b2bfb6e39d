"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import math
import os

import pytest

from tallyloom.plans import registry

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(TABLES):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{TABLES}/{name}'")
    return con


def plain(rows):
    number = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(map(number, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, TABLES)
    columns = sorted(found.columns)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(found.select(*columns).collect()) == plain(want.query("q", f"SELECT {quoted} FROM q").fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, TABLES).limit(1).count() == 1


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
