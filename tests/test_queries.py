"""Each registered query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lakeloom.plans import registry
from lakeloom.session import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(zip(*[table[n].to_pylist() for n in names], strict=True), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).arrow()
        assert rows(got) == rows(want.read_all() if hasattr(want, "read_all") else want)
    else:
        assert got.num_rows >= 0
