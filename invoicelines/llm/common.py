"""What the operators share: tables, folds, working tables and components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Gives the executors this package's source, once per application, so that their Python finds it wherever it was started."""
    context = spark.sparkContext
    if getattr(context, "_invoicelines_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "invoicelines.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._invoicelines_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds`; 0 for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % F.lit(folds), F.lit(0))


def work_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares for working tables.

    It is spark.checkpoint.dir; only where the session does not name one and runs
    on one machine (tests) a temporary folder is made and put into the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def computed_beside(docs: DataFrame, read: str, keep: list[str] | None, new: dict[str, str], run: Callable, kind: str = "string") -> DataFrame:
    """The columns `keep` (default all) and the new ones (name: type), computed by run(batches, kept).

    A batch's first `kept` columns are to be passed on as they are, the next is
    the column `read` as `kind`. A kept column of a new one's name gives way to it.
    """
    taken = {c.lower() for c in new}
    kept = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in taken]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{read}`").cast(kind).alias("read"))
    fields = [*[f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields[:-1])], *[f"n{i} {t}" for i, t in enumerate(new.values())]]
    names, n = [f.split(" ")[0] for f in fields], len(kept)

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(batches, n):
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(renamed, ", ".join(fields)).toDF(*kept, *new)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{work_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """`df` written as a table in the shared folder and read again, and its path.

    This cuts the lineage: a lost executor costs no more than the tasks that
    were running.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_stored(spark: SparkSession, path: str) -> None:
    """Deletes a working table that nothing will read again."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: columns a, b (bigint, not null), in any order and repeated at will.
    Returns node, component (the smallest node reachable) for every node but
    those that are their own component. Each round is two self-joins; its result is
    stored, so the plan does not grow. Hubs are split by the adaptive join.
    An empty input gives an empty result.
    """
    spark = edges.sparkSession

    def state(e: DataFrame) -> tuple:
        # The exact multiset of edges, but for collisions of two 64-bit sums.
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())

    now, path = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    was = state(now)
    while was[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, large_path = stored(large, "cc")
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new, new_at = stored(small.union(least.select("u", "m")).distinct(), "cc")
        drop_stored(spark, large_path)
        drop_stored(spark, path)
        now, path, before = new, new_at, was
        was = state(now)
        if was == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
