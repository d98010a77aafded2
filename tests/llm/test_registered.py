"""Every registered operator query on the smallest tables: the columns of its contract, a row for each row of its table, its folds."""

import zlib

import pytest

from invoicelines.llm.queries import QUERIES

from ..conftest import SMALL

COLUMNS = {
    2: ("documents", "doc_id", {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}),
    3: ("documents", "doc_id", {"held_out": "boolean", "lang_pred": "string", "score": "double"}),
    4: ("documents", "doc_id", {"start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}),
    5: ("documents", "doc_id", {"held_out": "boolean", "score": "double", "predicted": "int"}),
    6: ("pages", "page_id", {"url": "string", "text": "string", "n_chars": "bigint"}),
    7: ("documents", "doc_id", {"size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}),
    8: ("documents", "doc_id", {}),
    9: ("embeddings", "vec_id", {"n_links": "bigint", "component_id": "bigint", "kept": "boolean"}),
    10: ("documents", "doc_id", {"fingerprint": "string", "component_id": "bigint"}),
    11: ("documents", "doc_id", {"n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"}),
    12: ("documents", "doc_id", {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}),
}


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_contract(spark, n):
    name = next(q for q in QUERIES if q.startswith(f"op{n}_"))
    table, key, columns = COLUMNS[n]
    source = spark.read.parquet(f"{SMALL}/{table}.parquet")
    df = QUERIES[name](spark, SMALL)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in columns} == columns and key in kinds
    rows = df.collect()
    assert sorted(r[key] for r in rows) == sorted(r[0] for r in source.select(key).collect())
    assert not any(r[c] is None for r in rows for c in columns if c not in ("rank", "lang_pred"))
    if "held_out" in columns:
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows) and all(0 <= r.score <= 1 for r in rows)
    if n == 5:
        assert all(r.predicted == (r.score >= 0.7) for r in rows)
    if n == 3:
        assert {r.lang_pred for r in rows} <= {r[0] for r in source.select("lang").distinct().collect()} | {"und"}
    if n == 6:
        assert all(r.n_chars == len(r.text) for r in rows)
    if n == 4:
        ordered = sorted(rows, key=lambda r: r.doc_id)
        assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:i]) for i in range(len(ordered))]
    if n == 9:
        assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
