"""Operator 7. Mixing sources to target weights by systematic sampling.

All steps are DataFrame functions. Within a source every document expects the
same number of copies, target / source size. Documents are put in the order of
(source, size, id) by a range shuffle, so a hot source spreads over many
partitions; a document's prefix sum is its rank times the expected copies, and
the rank is its place in its partition plus the counts of the partitions
before it. It is emitted once for each integer that lies between two prefix
sums, both moved by the source's random offset. As sizes ascend, the words
taken differ from the target by no more than about one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

WEIGHTS = (5, 2, 1)
SEED = "mix-1"


def size_of(text: Column) -> Column:
    """Words without the six ASCII white-space characters; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """source, source_size, target from source, source_size (one row per source).

    Sources by code point, null last, take the weights in turn. Targets are
    level * weight, but at most cap * size, and share the sum of all sizes: the
    level is what resharing the excess again and again ends at. The rows are
    one per source, so their two global windows are small.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("bigint"))
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    every = Window.partitionBy()
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "level": (F.sum("source_size").over(every) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
        "place": F.row_number().over(by_need),
    })
    fits = F.col("level") * F.col("weight") <= F.lit(cap) * F.col("source_size")
    ranked = ranked.withColumn("level", F.min_by("level", F.when(fits, F.col("place"))).over(every))
    return ranked.select("source", "source_size", F.least(F.lit(cap) * F.col("source_size"), F.col("level") * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0, id_col: str = "doc_id", source: str = "source", text: str = "text", keep: list[str] | None = None, seed: str = SEED) -> DataFrame:
    """doc (a struct of the columns `keep`, default all), source, size, source_size, target, copies; one row per row of `docs`.

    Null texts and texts without words have the size 0; they may be copied, but
    take nothing. A null source is a source of its own. Rows with null or
    repeated ids are rows like others: equal (source, size, id) are ordered by
    the text's hash. The struct keeps names that clash apart. Where all sizes
    are 0, so are targets and copies. An empty table gives an empty result. The
    offset depends on seed and source alone, so reruns agree.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("doc"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{id_col}`").alias("id"), size_of(F.col(f"`{text}`")).alias("size"), F.xxhash64(F.col(f"`{text}`")).alias("tie"))
    order = [F.col("source").asc_nulls_last(), "size", "id", "tie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, _ = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc", "source", "size", F.monotonically_increasing_id().alias("at")), "mix")
    part = F.shiftright("at", 33).alias("part")
    counts, _ = stored(rows.groupBy("source", part).agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum("size").alias("words")), "mix")
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    goals = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    offsets = offsets.alias("o").join(goals.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select(F.col("o.source").alias("o_source"), F.col("part").alias("o_part"), (F.col("before") - F.col("first") + 1).alias("shift"), "source_size", "target")
    ranked = rows.join(offsets, (part.eqNullSafe(F.col("o_part"))) & F.col("source").eqNullSafe(F.col("o_source")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rank = F.col("at") + F.col("shift")
    copies = F.floor(rank * each + start) - F.floor((rank - 1) * each + start)
    return ranked.select("doc", "source", "size", "source_size", "target", copies.cast("bigint").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0, **kw) -> DataFrame:
    """The mixed rows themselves: each row of `docs` as often as its copies say, columns as in `docs`."""
    plan = mix_plan(docs, weights, cap, **kw).where("copies > 0")
    plan = plan.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return plan.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of each of all documents."""
    plan = mix_plan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return plan.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), r AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS rank FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source
), w AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight FROM s
), l AS (
  SELECT *, row_number() OVER n AS need,
    (CAST(sum(source_size) OVER () AS DOUBLE) - 3.0::DOUBLE * coalesce(sum(source_size) OVER (n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM w WINDOW n AS (ORDER BY source_size::DOUBLE / weight::DOUBLE, place)
), t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * (SELECT arg_min(level, need) FROM l WHERE level * weight <= 3.0::DOUBLE * source_size)) AS target FROM l
), e AS (
  SELECT r.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS each,
    CAST(('0x' || substr(sha256('mix-1|' || coalesce('s' || t.source, 'n')), 1, 8)) AS UBIGINT)::DOUBLE / 4294967296.0::DOUBLE AS start
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(floor(rank * each + start) - floor((rank - 1) * each + start) AS BIGINT) * size AS taken FROM e
"""
