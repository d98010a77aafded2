"""Operator 11. Importance resampling towards a target, over words that an Aho-Corasick automaton finds.

A batch's texts become one string of normalised words, each between single blanks.
Its different words, with a blank on both sides, are the dictionary; a word's payload
is the crc32 of its bytes and how many there are. One scan of the automaton emits the
payloads in the order of the words (two neighbours share the blank between them). A
feature of several words is never spelled: the crc32 of 'a b' is composed from the
payloads of 'a' and ' b', as crc32 is linear. The crc32 modulo `buckets` is the
feature's bucket. The end of a document is a word of the dictionary, too.

The buckets of every document are stored once. Counts of all documents and of all target
texts, one number a bucket, give each bucket's gain; a document's weight is the
floored mean of its features' gains. With Gumbel noise from a hash of its id added,
the documents with the highest scores are a draw without replacement in which a
document's chance follows its weight. The draw ranks by a range shuffle and the
counts of the partitions before; no task sees all scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import computed_beside, ship, stored, table

BUCKETS, SEED, MIN_WORDS, PERCENT = 10_000, "2024", 20, 10
#: Bytes of normalised text that share a dictionary; longer words stand in it under a short name.
CHUNK_BYTES, LONG = 8 << 20, 64
#: Buckets at most: their gains go to every task.
MOST_BUCKETS = 1 << 22
#: A-Z in lower case; what is neither 0-9, a-z nor outside ASCII is a blank.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
END, NAME = b"\x01", "\x02"


def _zeros() -> list[np.ndarray]:
    """For k = 0, 1, ...: what 2^k bytes of zero make of a crc32, by each of its four bytes."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, np.uint32(0xEDB88320) ^ (byte >> 1), byte >> 1)
    one = [byte, *[np.arange(256, dtype=np.uint32) << np.uint32(8 * (k - 1)) for k in (1, 2, 3)]]
    steps = [np.stack(one)]
    for _ in range(31):
        last = steps[-1]
        steps.append(np.stack([_passed(last, t) for t in last]))
    return steps


def _passed(step: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return step[0][crc & 255] ^ step[1][crc >> 8 & 255] ^ step[2][crc >> 16 & 255] ^ step[3][crc >> 24]


ZEROS = _zeros()


def composed(crc: np.ndarray, after: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of each text followed by another one, from both crc32 and the other's length in bytes."""
    crc = crc.astype(np.uint32)
    for k in range(int(lengths.max(initial=0)).bit_length()):
        crc = np.where(lengths >> k & 1, _passed(ZEROS[k], crc), crc)
    return crc ^ after.astype(np.uint32)


def scan(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many words each text has, and every word's payload: crc32 and length in bytes."""
    import ahocorasick

    words = (b" " + END + b" ").join([*[t.translate(NORMAL) for t in texts], b""]).split()
    names, automaton = {}, ahocorasick.Automaton(ahocorasick.STORE_INTS)
    different = list(set(words))
    crc, length = np.zeros(len(different), np.int64), np.zeros(len(different), np.int64)
    for i, w in enumerate(different):
        crc[i], length[i] = (zlib.crc32(w), len(w)) if w != END else (0, -1)
        if len(w) > LONG:  # a node for each of its bytes would cost too much
            names[w] = f"{NAME}{i}".encode()
        automaton.add_word(f" {names.get(w, w).decode('latin-1')} ", i)
    if not words:
        return np.zeros(len(texts), np.int64), crc, length
    automaton.make_automaton()
    text = b" ".join([names.get(w, w) for w in words] if names else words).decode("latin-1")
    found = np.fromiter((i for _, i in automaton.iter(f" {text} ")), np.int64, len(words))
    lengths = length[found]
    ends = np.flatnonzero(lengths < 0)
    counts = np.diff(ends, prepend=-1) - 1
    own = lengths >= 0
    return counts, crc[found][own], lengths[own]


def features(counts: np.ndarray, crc: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many features each text has and their crc32, text by text: all runs of 1 to n words, joined by a blank."""
    ends = np.cumsum(counts)
    place = np.arange(len(crc)) - np.repeat(ends - counts, counts)
    left = np.repeat(counts, counts) - place  # words from this one to the text's end
    owner = np.repeat(np.arange(len(counts)), counts)
    # ' b' from ' ' and 'b'
    blank = composed(np.full(len(crc), zlib.crc32(b" ")), crc, lengths) if n > 1 else crc
    runs, owners, now = [crc.astype(np.uint32)], [owner], crc.astype(np.uint32)
    for k in range(1, n):
        at = np.flatnonzero(left > k)
        now[at] = composed(now[at], blank[at + k], lengths[at + k] + 1)
        runs.append(now[at])
        owners.append(owner[at])
    runs, owners = np.concatenate(runs), np.concatenate(owners)
    if n > 1:
        runs = runs[np.argsort(owners, kind="stable")]
    return np.bincount(owners, minlength=len(counts)), runs


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucketed(docs: DataFrame, text: str, keep: list[str], n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """The columns `keep`, n_words and found: the buckets of the text's features, as little-endian unsigned 32-bit (below 65,537 buckets: 16-bit) integers. Null texts have none."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MOST_BUCKETS}")
    ship(docs.sparkSession)
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch], kept: int) -> Iterator[list]:
        for b in batches:
            texts = b.column(kept).cast(pa.binary()).to_pylist()
            sizes, found, at, size = [], [], 0, 0
            for i, t in enumerate(texts):
                size += len(t or b"")
                if size >= CHUNK_BYTES or i == len(texts) - 1:
                    counts, crc, lengths = scan([t or b"" for t in texts[at : i + 1]])
                    each, of = features(counts, crc, lengths, n)
                    cut = (of % np.uint32(buckets)).astype(kind)
                    found += [x.tobytes() for x in np.split(cut, np.cumsum(each)[:-1])]
                    sizes.append(counts)
                    at, size = i + 1, 0
            yield [*b.columns[:kept], pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64), pa.int64()), pa.array(found, pa.binary())]

    return computed_beside(docs, text, keep, {"n_words": "bigint", "found": "binary"}, run)


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n of the column found: summed by task, then over the tasks."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                total += np.bincount(np.frombuffer(b"".join(b.column(0)[s : s + 256].to_pylist()), kind), minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own])], names=["bucket", "n"])

    return found.select("found").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for all buckets from bucket, n of all documents and of all target texts: floor(1000 * ln of the smoothed ratio of their shares)."""
    spark = source.sparkSession
    totals = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).first()[0]
    s_all, t_all = totals(source), totals(target)
    rows = spark.range(buckets).select(F.col("id").alias("bucket"))
    for df, name in ((source, "s"), (target, "t")):
        rows = rows.join(df.select(F.col("bucket").alias(f"{name}_bucket"), F.col("n").alias(name)), F.col("bucket") == F.col(f"{name}_bucket"), "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double") + 1.0
    ratio = count("t") * (s_all + buckets) / (count("s") * (t_all + buckets))
    return rows.select("bucket", F.floor(1000.0 * F.log(ratio)).cast("bigint").alias("gain"))


def noise(id_col: Column, seed: str = SEED) -> Column:
    """floor(-1000 * ln(-ln(u))), u from the first 8 hex digits of sha256('<seed>:<id>'); a null id is the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 1, buckets: int = BUCKETS, seed: str = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT, keep: list[str] | None = None) -> DataFrame:
    """id_col, the columns `keep`, n_words, n_features, weight, score and rank; one row per row of `docs`.

    rank: 1, 2, 3, ... of the drawn documents by score, else null; of the documents
    with at least `min_words` words floor(percent / 100) are drawn, ties to the
    smaller id, then by the text's features. Null and empty texts have no features and
    the weight 0. Null ids share one noise; rows with repeated ids are rows like
    others. Columns of `keep` give way to new ones of the same name; others are
    not read. An empty table gives an empty result; without target texts all
    gains follow the smoothing alone.
    """
    spark = docs.sparkSession
    new = ["n_words", "n_features", "weight", "score", "rank"]
    kept = [c for c in keep or [] if c.lower() not in {id_col.lower(), *new}]
    own = [f"k{i}" for i in range(len(kept))]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").alias(k) for c, k in zip(kept, own, strict=True)], F.col(f"`{text}`").cast("string").alias("text"))
    rows, _ = stored(bucketed(rows, "text", ["id", *own], n, buckets), "importance")
    aims = bucketed(target.select(F.col(f"`{target_text}`").cast("string").alias("text")), "text", [], n, buckets)
    source, _ = stored(bucket_counts(rows, buckets), "importance")
    aim, _ = stored(bucket_counts(aims, buckets), "importance")
    gain = np.zeros(buckets, np.int64)
    for b in gains(source, aim, buckets).collect():  # one number a bucket, MOST_BUCKETS at most
        gain[b.bucket] = b.gain
    kind = _kind(buckets)

    def weigh(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[list]:
        for b in batches:
            found = [np.frombuffer(x, kind) for x in b.column(k).to_pylist()]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            sums = np.fromiter((gain[x].sum() for x in found), np.int64, len(found))
            yield [*b.columns[:k], pa.array(sizes), pa.array(np.floor_divide(sums, np.maximum(sizes, 1)))]

    scored = computed_beside(rows.withColumn("tie", F.xxhash64("found")), "found", ["id", *own, "n_words", "tie"], {"n_features": "bigint", "weight": "bigint"}, weigh, "binary")
    scored, _ = stored(scored.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "importance")
    enough = F.col("n_words") >= min_words
    drawn = scored.where(enough).count() * percent // 100
    # Those that may be drawn come first; a row's place is its place in its partition and the counts of the partitions before.
    order = [F.when(enough, 0).otherwise(1), F.col("score").desc(), F.col("id"), F.col("tie")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_, _ = stored(scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "importance")
    part = F.shiftright("at", 33)
    counts = sorted_.groupBy(part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))  # a row for each partition
    shifts = counts.select(F.col("part").alias("s_part"), (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first") + 1).alias("shift"))
    placed = sorted_.join(F.broadcast(shifts), part == F.col("s_part")).withColumn("place", F.col("at") + F.col("shift"))
    rank = F.when(enough & (F.col("place") <= drawn), F.col("place"))
    return placed.select(F.col("id").alias(id_col), *[F.col(k).alias(c) for c, k in zip(kept, own, strict=True)], "n_words", "n_features", "weight", "score", rank.alias("rank"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole documents weighed by the benchmark's words, a tenth of them drawn."""
    found = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


# crc32 by its 256 constants, byte by byte, once for each different word.
OP11_SQL = r"""
WITH RECURSIVE step(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) AS r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8
), constants AS (SELECT list(v ORDER BY i) AS c FROM step WHERE k = 8
), d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), texts AS (
  SELECT doc_id, FALSE AS aim, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d
  UNION ALL
  SELECT NULL, TRUE, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), words AS (SELECT doc_id, aim, w, count(*) AS n FROM (SELECT doc_id, aim, unnest(ws) AS w FROM texts) GROUP BY ALL
), distinct_words AS (SELECT DISTINCT w FROM words
), coded AS (
  SELECT w, xor(list_reduce(list_transform(range(1, strlen(w) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i::INTEGER - 1, 2))::BIGINT),
    lambda crc, b: xor(crc >> 8, c[1 + (xor(crc, b) & 255)]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM distinct_words, constants
), counted AS (
  SELECT bucket, sum(n) FILTER (WHERE NOT aim)::DOUBLE AS s, sum(n) FILTER (WHERE aim)::DOUBLE AS t FROM words JOIN coded USING (w) GROUP BY bucket
), totals AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM counted
), gains AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1) * (s_all + 10000) / ((coalesce(s, 0) + 1) * (t_all + 10000))))::BIGINT AS gain FROM counted, totals
), weights AS (
  SELECT doc_id, CAST(floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE) AS BIGINT) AS weight FROM words JOIN coded USING (w) JOIN gains USING (bucket) WHERE NOT aim GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (doc_id) WHERE NOT aim
), ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (SELECT count(*) * 10 // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank FROM ranked
"""
