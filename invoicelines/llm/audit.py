"""Operator 13. Filter interaction audit by sorted posting lists.

Every document gets its part (a language) and the filters that it fails. Documents are
sorted by (part, id) in a range shuffle, so that a hot part lies in many tasks and
a task holds ranges of ids. In a range each filter's failing ids are one sorted
posting list for each part, again for the documents labelled good and for those labelled
toxic. The sizes of the lists' unions come from galloping k-way merges: the list
with the least head is followed, in steps that double, up to the next head of another
list, and that whole run is counted at once. A difference is one union less another: what filter
f removes after the filters q is |q and f together| - |q|. Sizes are summed over
the ranges; no list leaves its task.

All orders of the filters and all their steps are read off the summed unions of
the 2^k - 1 sets of filters.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from math import factorial
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, stored, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GAP = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
#: Ids of a range at most; a task's rows are merged range by range.
RANGE_IDS = 1 << 18


def gallop(ids: list[int], start: int, bound: int) -> int:
    """The first place from `start` on whose id is not below `bound`; looked for in steps that double."""
    step, end = 1, len(ids)
    while start + step < end and ids[start + step] < bound:
        start += step
        step *= 2
    return bisect_left(ids, bound, start, min(start + step, end))


def union_size(lists: list[list[int]]) -> int:
    """How many different ids sorted lists of different ids hold together: a galloping k-way merge."""
    live = [[x[0], 0, x] for x in lists if x]
    size = 0
    while len(live) > 1:
        live.sort(key=_head)
        (_, at, ids), bound = live[0], live[1][0]
        to = gallop(ids, at, bound)
        size += to - at
        if to < len(ids) and ids[to] == bound:  # counted with the other list
            to += 1
        if to < len(ids):
            live[0][0], live[0][1] = ids[to], to
        else:
            del live[0]
    return size + sum(len(ids) - at for _, at, ids in live)


_head = itemgetter(0)


def text_failures(text: Column) -> list[Column]:
    """Failures of the filters A to D; null texts are empty.

    A: under 100 words; B: less than 80 % of the words are different; C: more than
    10 % of the characters are A-Z; D: holds any of #$%&*|.
    """
    body = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(body, GAP), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(body) - F.length(F.translate(body, UPPER, ""))
    return [n < 100, 100 * different < 80 * n, 100 * capitals > 10 * F.length(body), body.rlike("[#$%&*|]")]


def failures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """id, part (null: empty), fails (bit 0 to 4 for A to E) and row (a number of its own); one row per row of `docs`.

    E: the text, null as empty, is that of a smaller id, anywhere in the table. Texts
    are told apart by sha256. A null id is neither smaller nor larger than another.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(text_failures(F.col(f"`{text}`").cast("string")))])
    rows, _ = stored(docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), bits.alias("bits"), F.unhex(F.sha2(body, 256)).alias("digest"), F.monotonically_increasing_id().alias("row")), "audit")
    # The first id of each text, counted before the shuffle; joined back by id, so that a text of many copies is not one task.
    first = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).select(F.col("digest").alias("f_digest"), F.col("id").alias("f_id"))
    met = rows.join(first, (F.col("id") == F.col("f_id")) & (F.col("digest") == F.col("f_digest")), "left")
    again = F.when(F.col("id").isNotNull() & F.col("f_id").isNull(), 1 << 4).otherwise(0)
    return met.select("id", "part", F.col("bits").bitwiseOR(again).alias("fails"), "row")


def union_sizes(failed: DataFrame, labels: DataFrame, n: int = 5, id_col: str = "doc_id") -> DataFrame:
    """part, kind ('all', 'good', 'toxic'), set (bits of filters) and size: documents of the kind that fail any filter of the set; of kind 'rows', set 0: all documents.

    failed: id, part, fails, row. A document is good (toxic) if any of its labels says
    so. Rows with the same id are documents of their own: a range numbers its
    documents in the order of ids, and lists hold these numbers.
    """
    spark = failed.sparkSession
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = failed.join(marks, F.col("id") == F.col("l_id"), "left").select("part", "id", "row", F.col("fails").cast("int").alias("fails"), (F.coalesce("good", F.lit(0)) + 2 * F.coalesce("toxic", F.lit(0))).cast("int").alias("marks"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "part", "id", "row").sortWithinPartitions("part", "id", "row").select("part", "fails", "marks")  # the row splits an id of many rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= RANGE_IDS:
                yield sizes(pa.Table.from_batches(held))
                held = []
        if held:
            yield sizes(pa.Table.from_batches(held))

    def sizes(rows: pa.Table) -> pa.RecordBatch:
        coded = pc.dictionary_encode(rows["part"].combine_chunks())
        of, fails, kinds = coded.indices.to_numpy(), rows["fails"].to_numpy(), rows["marks"].to_numpy()
        out = []
        for p, name in enumerate(coded.dictionary.to_pylist()):
            ids = np.flatnonzero(of == p)
            out.append((name, "rows", 0, len(ids)))
            for kind, own in (("all", ids), ("good", ids[kinds[ids] & 1 > 0]), ("toxic", ids[kinds[ids] & 2 > 0])):
                lists = [own[fails[own] >> k & 1 > 0].tolist() for k in range(n)]
                out += [(name, kind, s, union_size([lists[k] for k in range(n) if s >> k & 1])) for s in range(1 << n)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["part", "kind", "set", "size"])

    ship(spark)
    found = rows.mapInArrow(run, "part string, kind string, set int, size bigint")
    return found.groupBy("part", "kind", "set").agg(F.sum("size").alias("size"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang", filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, order of the filters and step.

    Null texts are empty and fail A; a null part is the empty one; columns of
    other names are not read. Labels of ids that are not in `docs` count nothing,
    a null label, or a label of a null id, is none. An empty table has no parts and no rows.
    """
    n, whole = len(filters), (1 << len(filters)) - 1
    sizes = union_sizes(failures(docs, id_col, text, part), labels, n, id_col)
    # 2^n sizes of each kind for each part, by the set's number.
    by_set = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("set", "size")))), lambda x: x["size"]).alias(kind)
    every = sizes.groupBy("part").agg(*map(by_set, ("rows", "all", "good", "toxic")))
    orders = F.array(*[F.lit("".join(o)) for o in permutations(filters)])
    steps = every.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    bit = lambda place: F.element_at(F.create_map(*[F.lit(x) for k, f in enumerate(filters) for x in (f, 1 << k)]), F.substring("filter_order", place, F.lit(1)))
    steps = steps.withColumns({"own": bit(F.col("step")), "before": F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda a, k: a + F.when(k < F.col("step"), bit(k)).otherwise(0))})
    own, before = F.col("own"), F.col("before")
    at = lambda kind, which: F.get(F.col(kind), which)
    gone = lambda kind: at(kind, before + own) - at(kind, before)
    # In how many orders exactly the filters of a set come before a filter.
    times = F.array(*[F.lit(factorial(s.bit_count()) * factorial(max(n - 1 - s.bit_count(), 0))).cast("bigint") for s in range(whole + 1)])
    share = F.aggregate(F.sequence(F.lit(0), F.lit(whole)), F.lit(0).cast("bigint"), lambda a, s: a + F.when(s.bitwiseAND(own) == 0, F.get(times, s) * (at("all", s + own) - at("all", s))).otherwise(0))
    return steps.select(
        "part", "filter_order", "step", (F.get("rows", F.lit(0)) - at("all", before + own)).alias("kept"), gone("all").alias("removed"), (at("all", own) - gone("all")).alias("redundant"),
        (at("all", F.lit(whole)) - at("all", F.lit(whole) - own)).alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), share.alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes in all orders, over all whole documents."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM d
), l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, MAP {
    'A': len(ws) < 100, 'B': 100 * len(list_distinct(ws)) < 80 * len(ws), 'C': 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first, FALSE)} AS fails
  FROM w LEFT JOIN l USING (doc_id)
), c AS (  -- documents by part and by what they fail
  SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[x]) AS failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders
), s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, string_split(substr(filter_order, 1, step - 1), '') AS before FROM steps
), r AS (
  SELECT part, filter_order, step, own,
    sum(n) FILTER (WHERE NOT list_contains(failed, own) AND NOT list_has_any(failed, before)) AS kept,
    sum(n) FILTER (WHERE list_contains(failed, own) AND NOT list_has_any(failed, before)) AS removed,
    sum(n) FILTER (WHERE list_contains(failed, own) AND list_has_any(failed, before)) AS redundant,
    sum(n) FILTER (WHERE failed = [own]) AS unique_fails,
    sum(good) FILTER (WHERE list_contains(failed, own) AND NOT list_has_any(failed, before)) AS good_lost,
    sum(toxic) FILTER (WHERE list_contains(failed, own) AND NOT list_has_any(failed, before)) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""
