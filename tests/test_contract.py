"""All checked queries against their SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as contract

FOLDER = Path("/root/testdata/sf0.001")
SQL = contract.oracle_sql()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables are absent")


def test_keys_and_flagship(spark):
    assert set(SQL) <= set(contract.queries()) and len(SQL) > 150
    assert contract.entry(spark).columns[:2] == ["o_orderdate_year", "l_returnflag"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def comparable(table):
    plain = lambda v: ("nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0) if isinstance(v, float) else v
    names = sorted(table.column_names)
    rows = [tuple(plain(r[n]) for n in names) for r in table.to_pylist()]
    return names, sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", SQL)
def test_query(spark, duck, name):
    got = comparable(contract.queries()[name](spark, str(FOLDER)).toArrow())
    assert got == comparable(duck.execute(SQL[name]).to_arrow_table())
