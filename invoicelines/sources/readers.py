"""Documents and record files."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """doc_id (the file's path), page_no (from 0), text of every file that matches; a form feed ends a page. No match gives no rows.

    Pages are the source's records, so a large file is read by many tasks. A
    page's number is its place in its split of the file and the pages of the
    splits before, of which only the counts are gathered.
    """
    pages = spark.read.option("pathGlobFilter", glob).option("lineSep", "\f").text(path)
    pages = pages.select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    counts = pages.groupBy(F.col("doc_id").alias("file"), F.col("split").alias("of_split")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("of_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("file", "of_split", (before - F.col("first")).alias("shift"))
    placed = pages.join(shifts, (F.col("doc_id") == F.col("file")) & (F.col("split") == F.col("of_split")))
    return placed.select("doc_id", (F.col("at") + F.col("shift")).cast("int").alias("page_no"), "text")


def _delivered(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """file, n: rows that each file gives when all of its columns are decoded; what can't be read is left out."""
    whole = spark.read.option("ignoreCorruptFiles", "true").schema(rows.schema).parquet(path)
    decoded = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in rows.columns])
    # A plain count would be answered by the footers.
    return whole.select(F.col("_metadata.file_path").alias("file"), decoded.alias("h")).groupBy("file").agg((F.count_if(F.col("h") >= 0) + F.count_if(F.col("h") < 0)).alias("n"))


def broken_files(spark: SparkSession, path: str, rows: DataFrame) -> list[str]:
    """Parquet files below `path` that hold more rows by their footer than can be read. Reads everything once; only broken files' names come to the driver."""
    promised = rows.select(F.col("_metadata.file_path").alias("p_file")).groupBy("p_file").agg(F.count("*").alias("promised"))  # footers alone
    found = promised.join(_delivered(spark, path, rows), F.col("p_file") == F.col("file"), "left")
    return sorted(r.p_file for r in found.where(F.coalesce("n", F.lit(0)) < F.col("promised")).select("p_file").collect())


def read_records(spark: SparkSession, paths: list[str], columns: list[str] | None = None, verify: bool = False) -> tuple[DataFrame, list[tuple[str, str]]]:
    """All rows of CSV (with a header) and Parquet inputs, all columns as text, and source_seq, the input's place; and (path, reason) of inputs that were skipped.

    Blank paths are left out. A path's end decides its format. columns: what an
    empty result has. verify: Parquet files that are broken behind their head are
    found by reading all once more; they are skipped and listed, too. Without it
    such a file makes the reading fail.
    """
    found, skipped = None, []
    for seq, path in enumerate(p.strip() for p in paths):
        if not path:
            continue
        kind = path.rstrip("/").rpartition(".")[2].lower()
        try:
            if kind == "csv":
                rows = spark.read.csv(path, header=True, inferSchema=False)
            elif kind == "parquet":
                rows = spark.read.parquet(path)
                if verify and (bad := broken_files(spark, path, rows)):
                    skipped += [(b, "broken") for b in bad]
                    rows = spark.read.option("ignoreCorruptFiles", "true").parquet(path).where(~F.col("_metadata.file_path").isin(bad))
            else:
                skipped.append((path, "unsupported format"))
                continue
        except (PySparkException, Py4JJavaError) as e:  # missing, or of an unreadable head
            skipped.append((path, (e.getCondition() if isinstance(e, PySparkException) else None) or "unreadable"))
            continue
        rows = rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns], F.lit(seq).alias("source_seq"))
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    if found is None:
        found = spark.createDataFrame([], ", ".join([f"`{c}` string" for c in columns or []] + ["source_seq int"]))
    return found, skipped


def audit_files(spark: SparkSession, path: str, suffix: str = ".pdf", max_bytes: int = 50 * 1024 * 1024, magic: bytes = b"%PDF") -> DataFrame:
    """path, length, ok, reason of every file below the path: its suffix, its size and its first bytes.

    A path that is not there is a row with the reason 'missing'. The source reads
    whole contents, of files up to max_bytes alone.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([(path, None, False, "missing")], "path string, length bigint, ok boolean, reason string")
    named = F.when(~F.lower("path").endswith(suffix), "suffix")
    # The size is a filter of the source: of larger files no content is read.
    small = files.where(F.col("length") <= max_bytes).select("path", "length", F.coalesce(named, F.when(F.substring("content", 1, len(magic)) != F.lit(magic), "not of this format")).alias("reason"))
    large = files.where(F.col("length") > max_bytes).select("path", "length", F.coalesce(named, F.lit("too large")).alias("reason"))
    return small.union(large).select("path", "length", F.col("reason").isNull().alias("ok"), "reason")
