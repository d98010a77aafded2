"""The pipeline and the registered queries on the smallest tables."""

import corpus_pipeline
import __spark_entry__
from invoicelines.llm.common import stored

from ..conftest import SMALL


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = stored(stage(spark, docs, SMALL), "test")
        sizes.append(docs.count())
        assert (docs.columns == columns) == (name != corpus_pipeline.STAGES[-1][0])
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] and sizes[4] == sizes[5] > 0
    again = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, docs.collect()))


def test_odd_documents(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, size int"
    rows = [(1, None, None, None, None, 0.0, 1), (2, "", "en", "s", 0, 0.0, 1), (None, "x y z", None, "s", 5, 0.0, 1), (3, "a b " * 9000, "en", None, 1, 0.0, 1), (3, "a b " * 9000, "en", None, 1, 0.0, 1), (4, "a", "en", "s", 1, 0.0, 1)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            docs, _ = stored(stage(spark, docs, SMALL), "test")
            assert docs.columns == [x.split()[0] for x in schema.split(", ")] or name == corpus_pipeline.STAGES[-1][0]
        docs.count()


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
