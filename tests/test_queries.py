"""Every query of the invoice operators against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from invoicelines.plans.queries import ORACLE_SQL, QUERIES

from .conftest import SMALL


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    assert rows
    if name in ORACLE_SQL:
        want = tables.execute(ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == columns
        assert rows == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in want.fetchall())


def test_no_python_in_plans(spark):
    for name in ("records_modern", "records_v2018", "final_bills"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
