"""Pages of documents that share files."""

import duckdb

from invoicelines.plans.queries import ORACLE_SQL, QUERIES


def test_every_page_of_every_document(spark, tmp_path):
    rows = [(1, "one\ftwo lines\nof it\f"), (2, None), (3, ""), (4, "\f\f"), (5, "7 1\nlooks like a head"), (12, "x" * 50), (6, "a\fb")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["read_document_files"](spark, str(tmp_path))
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL['read_document_files']})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) == 12
