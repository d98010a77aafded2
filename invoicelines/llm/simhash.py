"""Operator 10. SimHash near-duplicates by a byte-position inverted index.

A fingerprint is 8 bytes. Two that differ in at most 3 bits agree in at least
5 byte positions (the guaranteed minimum), so at least 3 of the 4 positions of
one half agree. The index therefore posts every distinct fingerprint under the
8 triples of positions that lie inside a half. Within a posting list shared
positional bytes are tallied for pairs, pairs below the minimum go, and the
rest is verified bit by bit.

A list longer than `block` is not compared but posted again under longer keys:
a triple and two of the five other positions (every link has such a key), then
those five bytes and one of the four 6-bit groups of the rest (three bits cannot
touch all four). A last list holds at most 2**18 different fingerprints, so
work per fingerprint is bounded at each level, and no link is lost.

Long lists give the edges of a spanning forest, not all pairs.

Three of 64 bits hold only nearly equal texts. near_dedup() finds texts by the
similarity of their sets of shingles. Equal sets are one node. Fingerprints of WORDS
words, over distinct shingles, only propose pairs: a similarity s leaves a share
acos(2 s / (1 + s)) / pi of the bits different. The bits are shuffled a few times
and cut into bytes again; each KEY_BITS bits in a row (three bytes) are a posting key,
KEYS in all. Pairs that share one of them and differ in no more bits than four standard
deviations above that share are verified on the shingles themselves before they link.
In simulation a pair of similarity 0.8 shares a key with a chance of 0.94, 0.85: 0.99.
A list of unrelated texts holds one in 2**KEY_BITS of them; where there are so many
texts that this is long, longer keys and more of them are the parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, drop_stored, ship, stored, table

BLOCK = 2048
#: Of near_dedup(): similarity of shingle sets and length of fingerprints.
SIMILARITY, WORDS = 0.8, 8
#: Posting keys of long fingerprints, and bits in each.
KEYS, KEY_BITS = 192, 24
#: Shorter lists are compared many at once; members of a block that come with their sets.
FEW, SETS = 64, 256
BYTES = [0xFF << (8 * i) for i in range(8)]
#: For each value of a byte, a byte for each of its bits, as one number.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
HALVES = [c for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for c in combinations(half, 3)]


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42, words: int = 1) -> tuple[int, ...] | int:
    """The SimHash of a text's word shingles, repeats included: 64 bits, or a tuple of `words` times 64 bits.

    A-Z are lower-cased, words are runs without the six ASCII white-space
    bytes. Fewer words than a shingle make one shingle; null or no word: zero.
    """
    found = _words(text, shingle, seed, words)
    return found[0] if words == 1 else found


def _hashes(text: bytes | None, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles in their order, repeats included, in parts."""
    parts = (text or b"").lower().split()
    if not parts:
        return
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(parts) > shingle:
        starts, ends = starts[: len(parts) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 8192):
        spans = zip(starts[at : at + 8192].tolist(), ends[at : at + 8192].tolist(), strict=True)
        yield np.fromiter((digest(joined[s:e], seed) for s, e in spans), np.uint64)


def _bits(parts: Iterator[np.ndarray], words: int) -> tuple[int, ...]:
    total, n = np.zeros((words, 64), np.int64), 0
    for h in parts:
        n += len(h)
        for k in range(words if len(h) else 0):
            if k:  # further hashes of the shingle from its first
                h = (h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
                h *= np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            # Sums of 255 hashes at a time fit into the bytes of a number.
            lanes = LANES[h.astype(">u8").view(np.uint8).reshape(-1, 8)]
            total[k] += np.add.reduceat(lanes, np.arange(0, len(h), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return tuple(int.from_bytes(np.packbits(2 * t > n).tobytes(), "big") for t in total)


def _words(text: bytes | None, shingle: int, seed: int, words: int) -> tuple[int, ...]:
    return _bits(_hashes(text, shingle, seed), words)


def shingle_set(text: bytes | None, shingle: int, seed: int = 42) -> np.ndarray:
    """The hashes of a text's distinct shingles, sorted; none for null or no word."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_hashes(text, shingle, seed)]))


def _number(found: np.ndarray) -> int:
    """Of a set of shingles, signed."""
    return _signed(xxhash.xxh64_intdigest(found.tobytes(), 7))


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = 3, words: int = 1) -> DataFrame:
    """The columns `keep` and f0, f1, ... (the fingerprint's words as bigint), a row per row."""
    names = [f"f{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(len(keep)).cast(pa.binary()).to_pylist()
            fp = np.array([_words(v, shingle, 42, words) for v in values], np.uint64).reshape(len(values), words).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *map(pa.array, np.ascontiguousarray(fp.T))], names=[*keep, *names])

    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keep)]]
    return picked.mapInArrow(run, ", ".join([*fields, *[f"{c} bigint" for c in names]]))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _posted(rows: DataFrame, masks: dict[int, list[int]], words: list[str], of: dict[int, int] | None = None) -> DataFrame:
    """A posting (slot, key, fp, the words) for each of a row's masks. masks: by the row's slot; of: the word they mask, by that slot."""
    lists = F.create_map(*[x for s, ms in masks.items() for x in (F.lit(s), F.array(*[F.struct(F.lit(s * 64 + j).alias("slot"), F.lit(_signed(m)).cast("bigint").alias("mask")) for j, m in enumerate(ms)]))])
    rows = rows.select("fp", *words, "slot", F.explode(F.element_at(lists, F.col("slot"))).alias("p"))
    masked = F.element_at(F.array(*words), F.element_at(F.create_map(*[F.lit(x) for s, w in of.items() for x in (s, w + 1)]), F.col("slot"))) if of else F.col(words[0])
    return rows.select("p.slot", masked.bitwiseAND(F.col("p.mask")).alias("key"), "fp", *words)


def _linked(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Whether fingerprints (last axis: words) are at most `bits` apart; tally of shared positional bytes first, where it decides."""
    x = a ^ b
    far = np.bitwise_count(x).sum(axis=-1, dtype=np.int32) > bits
    if x.shape[-1] == 1 and bits < 8:
        far |= (x[..., None].view(np.uint8).reshape(*x.shape[:-1], 8) == 0).sum(axis=-1, dtype=np.uint8) < 8 - bits
    return ~far


def _forest(fp: np.ndarray, bits: int) -> np.ndarray:
    """For each fingerprint of a list the number of its component's first one; rows in blocks, so memory is bounded."""
    n = len(fp)
    label, rows = np.arange(n), max(1, (1 << 19) // (n * fp.shape[1]))
    kept = np.concatenate([_linked(fp[at : at + rows, None], fp[None], bits) for at in range(0, n, rows)]) if n <= 4096 else None
    while True:
        new = label.copy()
        for at in range(0, n, max(rows, 1)):
            near = kept[at : at + rows] if kept is not None else _linked(fp[at : at + rows, None], fp[None], bits)
            new[at : at + rows] = np.where(near, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _match(postings: DataFrame, bits: int, block: int | None, slots: int) -> DataFrame:
    """Reads sorted postings as a stream and gives edges (kind 0: a, b) and, of lists longer than `block`, the postings themselves (kind 1: fp, slot)."""
    short = 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last, size, hot = None, 0, False

        def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

        def whole(ids: np.ndarray, fp: np.ndarray, slot: int) -> Iterator[pa.RecordBatch]:
            if block and len(ids) > block:
                yield out(1, ids, np.full(len(ids), slot, np.int64))
            elif len(ids) > 1:
                first = _forest(fp, bits)
                moved = first != np.arange(len(ids))
                yield out(0, ids[moved], ids[first[moved]])

        for b in batches:
            if not b.num_rows:
                continue
            slot, key, ids = (np.asarray(c) for c in b.columns[:3])
            fp = np.stack([np.asarray(c) for c in b.columns[3:]], axis=1).view(np.uint64)
            cuts = np.flatnonzero((slot[1:] != slot[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(ids)]))
            inner = slice(1, -1)  # lists that neither begin before the batch nor end after it
            sizes, closes = (ends - starts)[inner], ends[inner]
            for s, e in zip(starts[inner][sizes > short].tolist(), closes[sizes > short].tolist(), strict=True):
                yield from whole(ids[s:e], fp[s:e], int(slot[s]))
            few = (sizes > 1) & (sizes <= short)
            if few.any():
                stop = np.repeat(closes[few], sizes[few])
                row = stop - np.repeat(sizes[few], sizes[few]) + np.arange(len(stop)) - np.repeat(np.cumsum(sizes[few]) - sizes[few], sizes[few])
                for d in range(1, int(sizes[few].max())):
                    row, stop = row[row + d < stop], stop[row + d < stop]
                    near = row[_linked(fp[row], fp[row + d], bits)]
                    if len(near):
                        yield out(0, ids[near], ids[near + d])
            for s, e in {(int(starts[0]), int(ends[0])): 0, (int(starts[-1]), int(ends[-1])): 0}:
                if (at := (int(slot[s]), int(key[s]))) != last:
                    if held and not hot:
                        yield from whole(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), last[0])
                    held, size, hot, last = [], 0, False, at
                held.append((ids[s:e], fp[s:e]))
                size += e - s
                if block and size > block:  # passed on as it comes
                    hot = True
                    found = np.concatenate([h[0] for h in held])
                    yield out(1, found, np.full(len(found), last[0], np.int64))
                    held = []
        if held and not hot:
            yield from whole(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), last[0])

    dealt = postings.repartition(slots, "slot", "key").sortWithinPartitions("slot", "key")
    return dealt.mapInArrow(run, "kind int, a bigint, b bigint")


def links(distinct: DataFrame, bits: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect what links of at most `bits` (0 to 3) differing bits connect.

    distinct: column fp (bigint), each value once. Lists of more than a few dozen
    give a spanning forest, at most one edge fewer than their members.
    """
    slots = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = {0: [sum(BYTES[i] for i in c) for c in HALVES]}
    second = {j: [m | BYTES[p] | BYTES[q] for p, q in combinations([i for i in range(8) if not m & BYTES[i]], 2)] for j, m in enumerate(first[0])}
    third = {}
    for s, ms in second.items():
        for j, m in enumerate(ms):
            free = [i for i in range(64) if not m >> i & 1]
            third[s * 64 + j] = [m | sum(1 << i for i in free[g : g + 6]) for g in range(0, 24, 6)]
    edges, rows = None, distinct.select("fp", F.lit(0).alias("slot"))
    for masks, limit in ((first, block), (second, block), (third, None)):
        found, _ = stored(_match(_posted(rows.withColumn("f0", F.col("fp")), masks, ["f0"]), bits, limit, slots), "simhash")
        edges = found.where("kind = 0").select("a", "b") if edges is None else edges.union(found.where("kind = 0").select("a", "b"))
        rows = found.where("kind = 1").select(F.col("a").alias("fp"), F.col("b").cast("int").alias("slot")).distinct()
        if rows.isEmpty():
            break
    return edges


def allowed_bits(similarity: float, words: int) -> int:
    """Differing bits at a similarity of shingle sets, and four standard deviations more."""
    share = acos(2 * similarity / (1 + similarity)) / pi
    return int(64 * words * share + 4 * sqrt(64 * words * share * (1 - share)))


def _masks(words: int) -> list[list[int]]:
    """Of each key and word the bits taken: of each shuffle of all bits, as many sets as it has."""
    rng, out = np.random.default_rng(7), []
    while len(out) < KEYS:
        for chosen in rng.permutation(64 * words)[: 64 * words // KEY_BITS * KEY_BITS].reshape(-1, KEY_BITS).tolist():
            out.append([_signed(sum(1 << (c % 64) for c in chosen if c // 64 == k)) for k in range(words)])
    return out[:KEYS]


def _keyed(nodes: DataFrame, names: list[str]) -> DataFrame:
    """key, fp: a posting of each node under each key."""
    masks = F.array(*[F.struct(F.lit(j).alias("slot"), *[F.lit(m).cast("bigint").alias(c) for c, m in zip(names, ms, strict=True)]) for j, ms in enumerate(_masks(len(names)))])
    key = F.xxhash64("p.slot", *[F.col(c).bitwiseAND(F.col(f"p.{c}")) for c in names])
    return nodes.select("fp", *names, F.explode(masks).alias("p")).select(key.alias("key"), "fp")


def _several(postings: DataFrame, block: int) -> DataFrame:
    """key, fp, long: the postings of lists of two or more; long: of more than `block`."""
    slots = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, ids), starts, long in _lists(batches, block):
            kept = np.repeat(np.diff(starts) > 1, np.diff(starts)) | long
            yield pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array(ids[kept]), pa.array(np.full(int(kept.sum()), long))], names=["key", "fp", "long"])

    return postings.repartition(slots, "key").sortWithinPartitions("key").mapInArrow(run, "key bigint, fp bigint, long boolean")


def _lists(batches: Iterator[pa.RecordBatch], block: int | None) -> Iterator[tuple[list[np.ndarray], np.ndarray, bool]]:
    """Sorted rows (key, others) as (columns, starts of whole lists, long). A list of more than `block` rows comes in parts as it is read, with long true."""
    held: list[list[np.ndarray]] = []
    size, hot = 0, False
    for b in batches:
        if not b.num_rows:
            continue
        columns = [np.asarray(c) for c in b.columns]
        cuts = np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [b.num_rows]))
        if len(starts) > 2:
            s, e = int(starts[1]), int(ends[-2])
            sizes = ends[1:-1] - starts[1:-1]
            yield [c[s:e] for c in columns], np.append(0, np.cumsum(sizes)), False
        for s, e in {(int(starts[0]), int(ends[0])): 0, (int(starts[-1]), int(ends[-1])): 0}:
            if held and held[0][0][0] != columns[0][s] or hot and not held and last != columns[0][s]:
                if held:
                    yield [np.concatenate(c) for c in zip(*held, strict=True)], np.array([0, size]), hot
                held, size, hot = [], 0, False
            last = columns[0][s]
            held.append([c[s:e] for c in columns])
            size += e - s
            if block and (hot or size > block):
                hot = True
                yield [np.concatenate(c) for c in zip(*held, strict=True)], np.array([0, size]), True
                held, size = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)], np.array([0, size]), hot


def _pairs(fp: np.ndarray, starts: np.ndarray, bits: int, rest: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions i < j of one list that are at most `bits` apart, in parts of long lists or many short lists at once; rest: one of the two must be marked."""
    sizes = np.diff(starts)
    few = (sizes > 1) & (sizes <= FEW)
    if few.any():
        stop = np.repeat(starts[1:][few], sizes[few])
        row = stop - np.repeat(sizes[few], sizes[few]) + np.arange(len(stop)) - np.repeat(np.cumsum(sizes[few]) - sizes[few], sizes[few])
        found = []
        for d in range(1, int(sizes[few].max())):
            row, stop = row[row + d < stop], stop[row + d < stop]
            near = row[_linked(fp[row], fp[row + d], bits)]
            found.append(np.stack((near, near + d)))
        i, j = np.concatenate(found, axis=1)
        if rest is not None:
            i, j = i[rest[i] | rest[j]], j[rest[i] | rest[j]]
        yield i, j
    for s, e in zip(starts[:-1][sizes > FEW].tolist(), starts[1:][sizes > FEW].tolist(), strict=True):
        mine = np.arange(s, e) if rest is None else s + np.flatnonzero(rest[s:e])
        step = max(1, (1 << 19) // ((e - s) * fp.shape[1]))
        for at in range(0, len(mine), step):  # each step's pairs by themselves: all of a list would be too many
            i, j = np.nonzero(_linked(fp[mine[at : at + step], None], fp[None, s:e], bits))
            i, j = mine[at : at + step][i], j + s
            kept = i < j if rest is None else (i < j) | (~rest[j] & (i != j))
            yield np.minimum(i, j)[kept], np.maximum(i, j)[kept]


def _sized(n: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two sets of such sizes can have the similarity at all."""
    return np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9


def _roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's component, with the pairs (i, j) added to what `root` already joins."""
    while len(i):
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], least)
        np.minimum.at(new, root[j], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _proposed(postings: DataFrame, by: list[str], bits: int, similarity: float) -> DataFrame:
    """Of each member a of a list (rows of equal columns `by`) that is near another: b, the first one before it that is near, c, the nearest one, at d bits, and r, the first one that a chain of near ones leads to."""
    slots = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c for c in postings.columns if c not in (*by, "fp", "n")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, starts, _ in _lists(batches, None):
            ids, n, fp = columns[1], columns[2], np.stack(columns[3:], axis=1).view(np.uint64)
            none = 1 << 62
            first, nearest, root = np.full(len(ids), len(ids)), np.full(len(ids), none), np.arange(len(ids))
            for i, j in _pairs(fp, starts, bits):
                can = _sized(n, i, j, similarity)
                i, j = i[can], j[can]
                root = _roots(root, i, j)
                far = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=-1, dtype=np.int64) << 32
                np.minimum.at(first, j, i)
                np.minimum.at(nearest, j, far | i)
                np.minimum.at(nearest, i, far | j)
            own = np.flatnonzero(nearest < none)
            before = first[own] < len(ids)
            b = np.where(before, ids[np.minimum(first[own], len(ids) - 1)], 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(b, mask=~before), pa.array(ids[nearest[own] & 0xFFFFFFFF]), pa.array(nearest[own] >> 32), pa.array(ids[root[own]])], names=["a", "b", "c", "d", "r"])

    key = F.col(by[0]) if len(by) == 1 else F.xxhash64(*by)
    dealt = postings.select(key.alias("key"), "fp", "n", *names).repartition(slots, "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(run, "a bigint, b bigint, c bigint, d bigint, r bigint")


def _cells(rows: DataFrame, block: int) -> DataFrame:
    """rows (key, fp, label, others) once for each cell of its key's grid: cell, fp, label, other, others.

    Members outside a key's largest label are compared with all members, in a
    grid of blocks, so a task holds about two blocks however many members a key has.
    """
    payload = [c for c in rows.columns if c not in ("key", "fp", "label")]
    parts = rows.groupBy("key", "label").agg(F.count("*").alias("m"))
    parts = parts.groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "label")).alias("most")).where("n > most.m")
    grid = parts.select("key", F.col("most.label").alias("main"), F.ceil(F.col("n") / block).cast("int").alias("wide"), F.ceil((F.col("n") - F.col("most.m")) / block).cast("int").alias("high"))
    rows = rows.join(grid, "key").withColumn("other", F.col("label") != F.col("main"))
    own = F.pmod(F.xxhash64("fp"), F.col("wide")).cast("int")
    own_high = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("high")).cast("int")
    places = F.array(F.struct(F.lit(False).alias("other"), own.alias("x"), F.sequence(F.lit(0), F.col("high") - 1).alias("ys")))
    of_other = F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda x: F.struct(F.lit(True).alias("other"), x.alias("x"), F.array(own_high).alias("ys")))
    rows = rows.select("key", "fp", "label", *payload, F.explode(F.when(F.col("other"), F.concat(places, of_other)).otherwise(places)).alias("at"))
    rows = rows.select("key", "fp", "label", *payload, "at.other", "at.x", F.explode("at.ys").alias("y"))
    return rows.select(F.xxhash64("key", "x", "y").alias("cell"), "fp", "label", F.col("other").cast("int").alias("other"), *payload)


def _near_others(rows: DataFrame, names: list[str], bits: int, block: int, similarity: float) -> DataFrame:
    """fp of the members of a key that have a near one of another label in it. rows: key, fp, label, n, the words."""
    slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, starts, _ in _lists(batches, None):
            ids, labels, other, n = columns[1:5]
            met = np.zeros(len(ids), bool)
            for i, j in _pairs(np.stack(columns[5:], axis=1).view(np.uint64), starts, bits, other.astype(bool)):
                kept = (labels[i] != labels[j]) & _sized(n, i, j, similarity)
                met[i[kept]] = met[j[kept]] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(ids[met]))], names=["fp"])

    cells = _cells(rows, block).select("cell", "fp", "label", "other", "n", *names)
    return cells.repartition(slots, "cell").sortWithinPartitions("cell").mapInArrow(run, "fp bigint").distinct()


def _across(rows: DataFrame, names: list[str], bits: int, block: int, similarity: float) -> DataFrame:
    """Links (a, b) between labels of a key: of members that are near and whose sets have the similarity, as many as connect the labels of each cell. rows: key, fp, label, n, held (the set), the words."""
    slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, starts, _ in _lists(batches, None):
            ids, labels, other, n, held = columns[1:6]
            cell = np.searchsorted(starts, np.arange(len(ids)), side="right")
            above: dict[tuple[int, int], tuple[int, int]] = {}  # labels of a cell that are linked
            a, b = [], []

            def top(label: tuple[int, int], above=above) -> tuple[int, int]:
                while label in above:
                    label = above[label]
                return label

            for i, j in _pairs(np.stack(columns[6:], axis=1).view(np.uint64), starts, bits, other.astype(bool)):
                kept = (labels[i] != labels[j]) & _sized(n, i, j, similarity)
                for x, y in zip(i[kept].tolist(), j[kept].tolist(), strict=True):
                    p, q = top((int(cell[x]), int(labels[x]))), top((int(cell[y]), int(labels[y])))
                    if p != q and _similar(held[x], held[y], similarity):
                        above[max(p, q)] = min(p, q)
                        a.append(max(ids[x], ids[y]))
                        b.append(min(ids[x], ids[y]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    cells = _cells(rows, block).select("cell", "fp", "label", "other", "n", "held", *names)
    return cells.repartition(slots, "cell").sortWithinPartitions("cell").mapInArrow(run, "a bigint, b bigint").distinct()


def _similar(x: bytes, y: bytes, similarity: float) -> bool:
    """Of two sets, as sorted 64-bit numbers."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if not len(x) or not len(y):
        return len(x) == len(y)
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return common >= similarity * (len(x) + len(y) - common) - 1e-9


def shingle_sets(wanted: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """fp, held (its shingles' hashes, sorted, as 64-bit numbers) of the nodes in `wanted` (fp). nodes: fp, least (id and body, a hash of the text, of one of its texts); texts: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_number(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["fp", "held"])

    least = nodes.join(wanted, "fp", "left_semi").select(F.col("least.id").alias("w_id"), F.col("least.body").alias("w_body"))
    picked = texts.join(least, F.col("id").eqNullSafe(F.col("w_id")) & (F.xxhash64("text") == F.col("w_body")), "left_semi")
    picked = picked.groupBy("id", F.xxhash64("text")).agg(F.first("text").alias("text")).select("text")
    return stored(picked.mapInArrow(run, "fp bigint, held binary"), "simhash")[0]


def verified(edges: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The edges (a, b) whose sets of shingles have the similarity; see shingle_sets()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = pa.array([_similar(x, y, similarity) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(kept)

    ends = edges.select(F.col("a").alias("fp")).union(edges.select(F.col("b").alias("fp"))).distinct()
    sets = shingle_sets(ends, nodes, texts, shingle)
    both = edges.join(sets.select(F.col("fp").alias("a"), F.col("held").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("held").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def near_components(nodes: DataFrame, texts: DataFrame, similarity: float, shingle: int, words: int, block: int = BLOCK) -> DataFrame:
    """node, component as components() gives them, of links verified on the texts' shingles.

    nodes: fp, least, n (shingles), f0, f1, ..., a row for each set of shingles; texts: id, text. Each
    node is first verified against one that is near in some list and against the nearest
    (lists longer than `block` are dealt in blocks that share their first member). What
    chains of near nodes connect is a cluster, and a whole list longer than `block`
    is in one. In clusters that these links leave in several components, members that are near
    one of another component meet in a grid of blocks, their sets with them, and are
    verified there: rows follow the members, not their pairs.
    Pairs whose sizes rule the similarity out are never looked at.
    """
    bits, names, spark = allowed_bits(similarity, words), [f"f{k}" for k in range(words)], nodes.sparkSession
    shared, shared_at = stored(_several(_keyed(nodes, names), block), "simhash")
    with_words = nodes.select("fp", "n", *names)
    near = _proposed(shared.where("NOT long").select("key", "fp").join(with_words, "fp").select("key", "fp", "n", *names), ["key"], bits, similarity)
    long = shared.where("long").select("key", "fp")
    chains = None
    if not long.isEmpty():
        sizes = long.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("wide"), F.min("fp").alias("hub"))
        own = F.array(F.pmod(F.xxhash64("fp"), F.col("wide")).cast("int"))
        dealt = long.join(sizes, "key")
        chains = dealt.select(F.col("fp").alias("a"), F.col("hub").alias("r"))
        dealt = dealt.withColumn("x", F.explode(F.when(F.col("fp") == F.col("hub"), F.sequence(F.lit(0), F.col("wide") - 1)).otherwise(own)))
        near = near.union(_proposed(dealt.join(with_words, "fp").select("key", "x", "fp", "n", *names), ["key", "x"], bits, similarity))
    near, near_at = stored(near, "simhash")
    pairs = near.groupBy("a").agg(F.min("b").alias("b"), F.min(F.struct("d", "c")).alias("nearest"))
    pairs = pairs.select("a", F.explode(F.array("b", "nearest.c")).alias("b")).where("b IS NOT NULL")
    first, _ = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "simhash")
    links, _ = stored(verified(first, nodes, texts, similarity, shingle), "simhash")
    found, _ = stored(components(links), "simhash")
    # Chains between different components, by the components.
    chains = near.select("a", "r") if chains is None else near.select("a", "r").union(chains)
    named = lambda df, c: df.join(found.select(F.col("node").alias(f"{c}_node"), F.col("component").alias(f"{c}_label")), F.col(c) == F.col(f"{c}_node"), "left").withColumn(c, F.coalesce(f"{c}_label", c)).select("a", "r")
    crossing, _ = stored(named(named(chains.where("a <> r").distinct(), "a"), "r").where("a <> r").distinct(), "simhash")
    drop_stored(spark, near_at)
    drop_stored(spark, shared_at)
    if not crossing.isEmpty():
        clusters = components(crossing.select("a", F.col("r").alias("b")))
        labels = crossing.select(F.col("a").alias("label")).union(crossing.select(F.col("r").alias("label"))).distinct()
        labels = labels.join(clusters, F.col("label") == F.col("node"), "left").select(F.col("label").alias("of"), F.coalesce("component", "label").alias("key"))
        rows = with_words.join(found, F.col("fp") == F.col("node"), "left").withColumn("label", F.coalesce("component", "fp"))
        rows, _ = stored(rows.join(labels, F.col("label") == F.col("of")).select("key", "fp", "label", "n", *names), "simhash")
        met, _ = stored(_near_others(rows, names, bits, block, similarity), "simhash")
        if not met.isEmpty():
            rows, _ = stored(rows.join(shingle_sets(met, nodes, texts, shingle), "fp").select("key", "fp", "label", "n", "held", *names), "simhash")
            links, _ = stored(links.union(_across(rows, names, bits, SETS, similarity)), "simhash")
            return components(links)
    return found


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 3, block: int = BLOCK) -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id; one row per row of `docs`.

    component_id is the smallest id whose fingerprint can be reached by links
    of at most `bits` bits, the row's own included. Null and empty texts have
    the fingerprint zero and link like any other. Rows with a null id get a
    fingerprint and group, but are never a group's id (null if a group has no
    other). Repeated rows stay repeated. Other columns of `docs` are not read.
    An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    marked = fingerprints(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")), keep=("id",), shingle=shingle)
    marked, _ = stored(marked.withColumnRenamed("f0", "fp"), "simhash")
    by_fp = marked.groupBy("fp").agg(F.min("id").alias("least"))
    final = _least(by_fp, components(links(by_fp.select("fp"), bits, block)))
    return marked.join(final, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _least(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """fp, component_id: the least id of a node's component. nodes: fp, least; found: node, component."""
    named = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    # Groups of one fingerprint need no second look; the others are few.
    several = named.join(found.select(F.col("component").alias("top")).distinct(), F.col("component") == F.col("top"), "left_semi")
    least = several.groupBy("component").agg(F.min("least").alias("group_least"))
    return named.join(least, "component", "left").select("fp", F.when(F.col("group_least").isNull(), F.col("least")).otherwise(F.col("group_least")).alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = 5, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """`docs` with one row of each group of similar texts.

    Texts whose sets of shingles have the similarity or more are similar, and what
    they connect is a group. Texts without words, null ones too, are one group. Of a
    group the row of the smallest id stays (null ids last, ties by the text's
    hash, then by the row's). Rows are judged one by one, so a repeated id may
    stay with different texts. Columns are as in `docs`, whatever their names; an
    empty table gives an empty result.
    """
    ship(docs.sparkSession)
    spark, names = docs.sparkSession, [f"f{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b.column(2).cast(pa.binary()).to_pylist()]
            f = np.array([_bits(iter((x,)), words) for x in sets], np.uint64).reshape(len(sets), words).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_number(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), *map(pa.array, np.ascontiguousarray(f.T))], names=["id", "body", "fp", "n", *names])

    plain = [f"c{i}" for i in range(len(docs.columns))]  # none can clash with what is computed here
    rows = docs.toDF(*plain)
    id_, body = F.col(plain[docs.columns.index(id_col)]), F.col(plain[docs.columns.index(text)]).cast("string")
    fields = [f"id {rows.select(id_).schema[0].dataType.simpleString()}", "body bigint", "fp bigint", "n bigint", *[f"{c} bigint" for c in names]]
    marked, marked_at = stored(rows.select(id_.alias("id"), F.xxhash64(body).alias("body"), body.alias("text")).mapInArrow(run, ", ".join(fields)), "simhash")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "body"))
    nodes, _ = stored(marked.groupBy("fp").agg(least.alias("least"), *[F.first(c).alias(c) for c in ("n", *names)]), "simhash")
    drop_stored(spark, marked_at)
    found = near_components(nodes, rows.select(id_.alias("id"), body.alias("text")), similarity, shingle, words, block)
    kept = _least(nodes, found).select("component_id.id", "component_id.body").distinct().toDF("kept_id", "kept_body")
    hashed = F.xxhash64(*[c for c, f in zip(plain, docs.schema.fields, strict=True) if "map<" not in f.dataType.simpleString()])
    picked = rows.withColumns({"body": F.xxhash64(body), "tie": hashed}).join(kept, id_.eqNullSafe(F.col("kept_id")) & (F.col("body") == F.col("kept_body")), "left_semi")
    only = Window.partitionBy(id_, "body").orderBy("tie")
    return picked.withColumn("place", F.row_number().over(only)).where("place = 1").select(*plain).toDF(*docs.columns)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and groups of all whole documents."""
    return simhash_groups(table(spark, sf_dir, "documents"))

