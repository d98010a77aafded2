"""Incremental extraction and running counts with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.layout import route_layout
from ..operators.modern import KEY
from ..operators.records import flag_repeated
from ..plans.pipeline import COLUMNS, REJECT_COLUMNS, parse

DOCUMENT = "doc_id string, text string"


#: Folders of remembered keys; after so many batches they are merged into one part, so that parts, and files of a bucket, stay few.
BUCKETS, MERGE = 64, 32
#: A key with more rows in a batch is first split over tasks.
FREQUENT = 50_000


def _parts(spark: SparkSession, path: str, before: int) -> list[str]:
    """The parts of the key table that hold the keys of the batches before a number: the last merged one and the batches after it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = lambda f: files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))
    names = [f.getPath().getName() for f in files.listStatus(at) if whole(f)] if files.exists(at) else []
    numbers = {kind: [n for n in (int(x[6:]) for x in names if x[5] == kind) if n < before] for kind in "bm"}
    merged = max(numbers["m"], default=-1)
    return [f"{path}/part=m{merged}"] * (merged >= 0) + [f"{path}/part=b{n}" for n in sorted(numbers["b"]) if n > merged]


def _keys(spark: SparkSession, path: str, parts: list[str]) -> DataFrame | None:
    return spark.read.schema("h1 bigint, h2 int, bucket int, part string").option("basePath", path).parquet(*parts) if parts else None


def stream_extract(spark: SparkSession, source: str, out: str, checkpoint: str, keys: tuple[str, ...] = KEY, schema: str = DOCUMENT) -> StreamingQuery:
    """Records and rejects of the documents (doc_id, text) that are new in the folder `source` (Parquet); a key that an earlier record had is a duplicate.

    out/rows: what judged() gives, divided by batch and by output ('record' or
    'reject', 'open' while a batch runs); records_of_stream() and rejects_of_stream() read it. A batch's own
    duplicates keep the first record; only rows of the modern layout, which alone can repeat, are shuffled. The keys of earlier batches are
    remembered as 96 bits of hashes in out/keys, divided by buckets of the hash;
    a batch reads the buckets that its own keys fall into, and nothing of the rows
    written before. A batch that is run again after a failure replaces what it wrote.
    """
    remembered = f"{out}/keys"

    def batch(docs: DataFrame, number: int) -> None:
        part = f"{out}/rows/batch={number}"
        hashed = [F.coalesce(F.col(k).cast("string"), F.lit("\uffff")) for k in keys]
        h1 = F.xxhash64(*hashed)
        # Documents are parsed once; what cannot repeat is settled at once, modern rows are open until they are judged.
        settled = F.when(F.col("layout") == "modern", "open").when(F.col("reject_reason").isNull(), "record").otherwise("reject")
        work = parse(docs).withColumns({"h1": h1, "h2": F.hash(*hashed), "bucket": F.pmod(h1, F.lit(BUCKETS)).cast("int"), "output": settled})
        work.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("output").parquet(part)
        work = spark.read.schema(work.schema).parquet(part).where("output = 'open'").drop("output")
        seen = work.groupBy("h1", "bucket").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.collect_set("bucket").alias("buckets")).first()  # BUCKETS numbers at most
        rows, old = work.withColumn("age", F.lit(1)), _keys(spark, remembered, _parts(spark, remembered, number))
        if old is not None and seen.buckets:
            # An earlier key is a row before those of the batch, so they meet where the batch's own duplicates do.
            old = old.where(F.col("bucket").isin(seen.buckets)).select("h1", "h2", F.lit("modern").alias("layout"), F.lit(0).alias("age"))
            rows = rows.unionByName(old, allowMissingColumns=True)
        rows = flag_repeated(rows, ["h1", "h2"], ["age", "doc_id", "block_no"], "repeated", None, 64 if (seen.most or 0) > FREQUENT else 1)
        rows = rows.where("age = 1").withColumn("reject_reason", F.when(F.col("repeated"), "duplicate")).drop("repeated", "age")
        rows = rows.withColumn("output", F.when(F.col("reject_reason").isNull(), "record").otherwise("reject"))
        rows.write.mode("append").partitionBy("output").parquet(part)
        new = spark.read.schema(rows.schema).parquet(part).where("output = 'record' AND layout = 'modern'").select("h1", "h2", "bucket")
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{remembered}/part=b{number}")
        if number % MERGE == MERGE - 1:
            every = _keys(spark, remembered, _parts(spark, remembered, number + 1)).select("h1", "h2", "bucket")
            every.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{remembered}/part=m{number}")
        judged = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part, "output=open")
        judged.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(judged, True)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def records_of_stream(spark: SparkSession, out: str) -> DataFrame:
    """All records that stream_extract() has written."""
    return spark.read.parquet(f"{out}/rows").where("output = 'record'").select(*COLUMNS)


def rejects_of_stream(spark: SparkSession, out: str) -> DataFrame:
    """All rejects that stream_extract() has written, and the batch that each came with."""
    return spark.read.parquet(f"{out}/rows").where("output = 'reject'").select(*REJECT_COLUMNS, "batch")


def stream_format_counts(spark: SparkSession, source: str, name: str, checkpoint: str | None = None, schema: str = DOCUMENT) -> StreamingQuery:
    """Running counts of documents by layout in the in-memory table `name`."""
    counts = route_layout(spark.readStream.schema(schema).parquet(source)).groupBy("layout").agg(F.count("*").alias("n"))
    writer = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
