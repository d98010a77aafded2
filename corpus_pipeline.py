"""From raw documents to a token file, in five stages.

A stage takes (spark, docs, sf_dir) and returns the rows that go on; run() writes
each stage's rows as Parquet in the shared folder and reads them again for the next.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from invoicelines.llm.common import ship, stored, table
from invoicelines.llm.decontaminate import remove_documents
from invoicelines.llm.mixing import mix
from invoicelines.llm.simhash import near_dedup
from invoicelines.llm.tokenfile import token_output
from invoicelines.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: without the documents predicted to be toxic."""
    ship(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each group whose five-word shingles are similar by 0.8 or more."""
    ship(spark)
    return near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: without the documents that hold ten words in a row of a benchmark item."""
    ship(spark)
    return remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: each document as often as its source's target weight asks."""
    ship(spark)
    return mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the token file of all rows; a row for each of them, read back from it."""
    ship(spark)
    return token_output(docs, known_bytes=64 << 20)  # the workers also hold what earlier stages left


STAGES = [("toxicity", toxicity), ("simhash near-dedup", simhash_near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token-ID output", token_ids)]

#: The stages that learn, hash and tokenize can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
