"""Every registered query with SQL equals DuckDB on sf0.001, row for row."""

from pathlib import Path

import duckdb
import pytest

from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(catalog.ORACLE[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
