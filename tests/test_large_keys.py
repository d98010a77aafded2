"""The queries against their SQL where order numbers are longer than an account number."""

import datetime

import duckdb

from invoicelines.plans.queries import ORACLE_SQL, QUERIES


def test_stream_of_orders_that_share_an_account_number(spark, tmp_path):
    c = duckdb.connect()
    day = datetime.datetime(1996, 3, 1)
    tables = {
        "nation": spark.createDataFrame([(1, "GREECE")], "n_nationkey long, n_name string"),
        "customer": spark.createDataFrame([(7, "Customer#7", 1, "BUILDING")], "c_custkey long, c_name string, c_nationkey long, c_mktsegment string"),
        "orders": spark.createDataFrame([(k, 7, day, 10.5) for k in range(1234560, 1234580)], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double"),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = QUERIES["stream_extraction"](spark, str(tmp_path))
    rows = sorted(repr(tuple(r)) for r in got.collect())
    want = sorted(map(repr, c.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL['stream_extraction']})").fetchall()))
    assert rows == want and got.where("n > 1").count() > 0
