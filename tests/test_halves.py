"""Numbers that end in a half go to the even neighbour, as in the SQL of the queries."""

from datetime import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from palimpsa.plans import catalogue, context  # noqa: F401


@pytest.mark.parametrize(("name", "prices"), [("focused_locations", [500, 1500, 2500, 98_500, 99_500]), ("box_duplicates", [50, 10_060, 250, 10_100])])
def test_halves_as_in_sql(spark, tmp_path, name, prices):
    n = len(prices)
    orders = {"o_orderkey": range(n), "o_custkey": [k // 2 for k in range(n)], "o_totalprice": map(float, prices), "o_orderdate": [datetime(1995, 1, 3)] * n}
    lines = {"l_orderkey": [k for k in range(n) for _ in (0, 1)], "l_quantity": [0.125, 2.625] * n}
    con = duckdb.connect()
    for table, columns in (("orders", orders), ("lineitem", lines)):
        pq.write_table(pa.table({c: list(v) for c, v in columns.items()}), f"{tmp_path}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
    found = catalogue.QUERIES[name](spark, str(tmp_path))
    names = ", ".join(f'"{c}"' for c in found.columns)
    expected = con.execute(f"SELECT {names} FROM ({catalogue.SQL[name]})").fetchall()
    assert expected and sorted(map(tuple, found.collect())) == sorted(expected)
