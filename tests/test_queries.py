"""Every registered query against its SQL on the smallest data set."""

import duckdb
import pytest

from check import TABLES, kind, rows_of
from souklens.plans import QUERIES

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    q = QUERIES[name]
    got = q.run(spark, ROOT).toArrow()
    if q.sql is None:
        assert got.num_columns > 0
        return
    want = con.execute(q.sql).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    for c in got.column_names:
        assert kind(got.schema.field(c).type) == kind(want.schema.field(c).type), c
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
