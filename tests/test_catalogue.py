"""Every registered query with SQL gives the SQL's rows; the others give rows."""

import os

import duckdb
import pytest

from palimpsa.plans import catalogue, context, evidence, governed, more, resolution, stores, streams  # noqa: F401

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(PATH):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{PATH}/{name}'")
    return c


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    found = catalogue.QUERIES[name](spark, PATH)
    columns = sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=str)
    if name not in catalogue.SQL:
        assert rows
        return
    result = con.execute(catalogue.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=str)
