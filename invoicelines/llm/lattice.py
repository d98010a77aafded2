"""Operator 9. Near-duplicate embeddings by E8 lattice hashing.

Each of `tables` tables projects a unit vector to 16 random dimensions and
decodes both halves to their nearest E8 lattice point; the pair of points is the
vector's cell. A vector is stored under its own cell and probes that cell and the
`probes` neighbouring cells whose walls are nearest. Vectors that meet are
candidates; their cosine decides. Only keys and ids are shuffled to find
candidates. Equal vectors are collapsed to one first.

A cell of m vectors does not give all its pairs. First each is compared with the
cell's first one; of what is then not connected, the members outside the cell's
largest component are compared with all. Links are counted at the end, by comparing
all members of a component in blocks, so a large group costs products of matrices in
many tasks, and rows in proportion to its members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_stored, ship, stored, table

THRESHOLD = 0.93
TABLES, PROBES, SCALE, SEED = 8, 16, 0.6, 9
#: Components of at most FEW vectors are compared as pairs, larger ones in blocks.
FEW, BLOCK = 16, 1024
#: Vectors whose largest component is beyond this, or below its inverse, are scaled.
HUGE = 1e100


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [[s if k == i else t if k == j else 0.0 for k in range(8)] for i, j in combinations(range(8), 2) for s, t in product((1.0, -1.0), repeat=2)]
    half = [list(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the better of the nearest points of D8 and of D8 moved by a half."""

    def d8(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        odd = np.flatnonzero(r.sum(axis=1) % 2)
        off = y[odd] - r[odd]
        worst = np.abs(off).argmax(axis=1)
        r[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


class Hasher:
    """Cells and probes of unit vectors of one dimension; the same wherever it is made."""

    def __init__(self, dim: int, tables: int, probes: int, scale: float, seed: int) -> None:
        rng = np.random.default_rng([seed, dim])
        self.tables, self.probes = tables, probes
        self.planes = rng.normal(size=(tables, dim, 16)) * scale
        self.factors = rng.integers(1, 1 << 63, size=(tables, 16), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.steps = neighbours()

    def keys(self, unit: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + probes) keys; the first is the own cell. salt: what must be equal besides."""
        out = np.empty((len(unit), self.tables, 1 + self.probes), np.uint64)
        near = 8
        rows = np.arange(len(unit))[:, None]
        for t in range(self.tables):
            x = unit @ self.planes[t]
            factors = self.factors[t]
            own, cost, moved = [], [], []
            for half in (0, 8):
                c = nearest(x[:, half : half + 8])
                wall = 1.0 - (x[:, half : half + 8] - c) @ self.steps.T  # distance to the wall, times the square root of 2
                best = np.argpartition(wall, near, axis=1)[:, :near]
                f = factors[half : half + 8]
                own.append(((2 * c).astype(np.int64).astype(np.uint64) * f).sum(axis=1, dtype=np.uint64))
                moves = ((2 * self.steps).astype(np.int64).astype(np.uint64) * f).sum(axis=1, dtype=np.uint64)
                cost.append(np.concatenate((np.zeros((len(unit), 1)), wall[rows, best] ** 2), axis=1))
                moved.append(np.concatenate((np.zeros((len(unit), 1), np.uint64), moves[best]), axis=1))
            both = (cost[0][:, :, None] + cost[1][:, None, :]).reshape(len(unit), -1)
            shift = (moved[0][:, :, None] + moved[1][:, None, :]).reshape(len(unit), -1)
            both[:, 0] = -1.0  # the own cell
            pick = np.argpartition(both, self.probes, axis=1)[:, : self.probes + 1]
            pick = np.take_along_axis(pick, np.argsort(both[rows, pick], axis=1), axis=1)
            key = (own[0] + own[1])[:, None] + shift[rows, pick]
            key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + salt[:, None] + np.uint64(t)
            out[:, t] = key ^ (key >> np.uint64(29))
        return out


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1)[:, None]


def cells(distinct: DataFrame, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """key, cid, own (stored there, not only probing). distinct: cid, label, vector (array<double>), each vector once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Hasher] = {}
        for b in batches:
            ids, labels = np.asarray(b.column(0)), np.asarray(b.column(1))
            for rows, vectors in _by_length(b.column(2)):
                for at in range(0, len(rows), 2048):
                    own, dim = rows[at : at + 2048], vectors.shape[1]
                    hasher = made.setdefault(dim, Hasher(dim, tables, probes, scale, seed))
                    salt = (labels[own].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim)) * np.uint64(0xBF58476D1CE4E5B9)
                    keys = hasher.keys(_unit(vectors[at : at + 2048]), salt).reshape(len(own), -1)
                    stored_under = np.zeros(keys.shape, bool)
                    stored_under.reshape(len(own), tables, -1)[:, :, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids[own], keys.shape[1])), pa.array(stored_under.ravel())], names=["key", "cid", "own"])

    return distinct.select("cid", F.xxhash64("label"), "vector").mapInArrow(run, "key bigint, cid bigint, own boolean")


def _by_length(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length, and their vectors as a matrix."""
    lengths = np.asarray(lists.value_lengths())
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        yield rows, lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n)


def verified(pairs: DataFrame, distinct: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose labels and lengths are equal and whose cosine, in double precision, is `threshold` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [np.zeros(0, np.int64)]
            for rows, x in _by_length(b.column(2)):
                y = next(_by_length(b.column(3).take(pa.array(rows))))[1]
                cos = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
                kept.append(rows[cos >= threshold])
            keep = pa.array(np.concatenate(kept))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], names=["a", "b"])

    left = distinct.select(F.col("cid").alias("a"), F.col("label").alias("p"), F.col("vector").alias("x"))
    right = distinct.select(F.col("cid").alias("b"), F.col("label").alias("q"), F.col("vector").alias("y"))
    both = pairs.join(left, "a").join(right, "b").where((F.col("p") == F.col("q")) & (F.size("x") == F.size("y")))
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _pair(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def linked(distinct: DataFrame, threshold: float = THRESHOLD, **kw) -> DataFrame:
    """node, component as components() gives them, of true links between vectors that meet in a cell."""
    spark = distinct.sparkSession
    found, found_at = stored(cells(distinct, **kw), "lattice")
    hubs = found.where("own").groupBy("key").agg(F.min("cid").alias("hub"))
    met, met_at = stored(found.join(hubs, "key"), "lattice")
    drop_stored(spark, found_at)
    first, _ = stored(met.where("cid <> hub").select(*_pair("cid", "hub")).distinct(), "lattice")
    links, _ = stored(verified(first, distinct, threshold), "lattice")
    now = components(links)
    # What is not connected yet: in each cell, those outside its largest component with all others.
    rows = met.join(now, F.col("cid") == F.col("node"), "left").select("key", "cid", "own", F.coalesce("component", "cid").alias("label"))
    rows, _ = stored(rows, "lattice")
    parts = rows.groupBy("key", "label").agg(F.count("*").alias("m"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("m", "label")).alias("most")).where("labels > 1").select("key", F.col("most.label").alias("main"))
    rows = rows.join(mixed, "key")
    others = rows.where("label <> main").select("key", F.col("cid").alias("c"), F.col("own").alias("c_own"), F.col("label").alias("c_label"))
    more = rows.join(others, "key").where("label <> c_label AND (own OR c_own)").select(*_pair("cid", "c")).distinct()
    tried, _ = stored(more.join(first, ["a", "b"], "left_anti"), "lattice")
    links, _ = stored(links.union(verified(tried, distinct, threshold)), "lattice")
    drop_stored(spark, met_at)
    return components(links)


def link_counts(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """cid, linked: how many rows the other vectors stand for that are linked with it. members: cid, component, vector, n (rows), all of a component."""
    spark = members.sparkSession
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes, _ = stored(members.groupBy("component").agg(F.count("*").alias("m")), "lattice")
    few = members.join(sizes.where(F.col("m") <= FEW), "component")
    pairs = few.select("component", F.col("cid").alias("a")).join(few.select("component", F.col("cid").alias("b")), "component").where("a > b").select("a", "b")
    near = verified(pairs, members.withColumn("label", F.lit(0)), threshold)
    near, _ = stored(near.union(near.select("b", "a")).toDF("cid", "other"), "lattice")
    counted = near.join(members.select(F.col("cid").alias("other"), "n"), "other").groupBy("cid").agg(F.sum("n").alias("linked"))
    # Each pair of blocks of a component is one cell; a member goes to the cells of its own block.
    many = members.join(sizes.where(F.col("m") > FEW), "component").withColumn("wide", F.ceil(F.col("m") / BLOCK).cast("int"))
    many = many.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("wide")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
    many = many.select("component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "cid", "n", "vector")

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        own, ids, n = (np.asarray(cell.column(k)) for k in ("own", "cid", "n"))
        x, y = cell.column("x")[0].as_py(), cell.column("y")[0].as_py()
        vectors = cell.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        square = np.einsum("ij,ij->i", vectors, vectors)
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        total = np.zeros(len(ids), np.int64)
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            near = (vectors[rows] @ vectors[right].T) / np.sqrt(square[rows, None] * square[None, right]) >= threshold
            near &= rows[:, None] != right[None, :]
            total[rows] += near @ n[right]
            if x != y:
                total[right] += n[rows] @ near
        return pa.table({"cid": pa.array(ids), "linked": pa.array(total)})

    by_blocks = many.repartition(slots, "component", "x", "y").groupBy("component", "x", "y").applyInArrow(run, "cid bigint, linked bigint")
    return counted.unionByName(by_blocks.groupBy("cid").agg(F.sum("linked").alias("linked")))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, **kw) -> DataFrame:
    """id_col, n_links, component_id, kept; one row per row of `vectors`.

    Only vectors with equal labels and equal lengths are compared. A row with a
    null id or label, or a vector that is null, empty, all zeros or holds a null
    or non-finite component, links with nothing and is its own component.
    n_links counts rows, equal vectors and repeated ids included (equal label and
    vector: told by a 64-bit hash). Every link is true, and all links inside a
    component are counted; vectors that never meet in a cell, directly or by
    others, are missed. Other columns are not read. An empty table gives an empty
    result.
    """
    ship(vectors.sparkSession)
    v = F.col("vector")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    # Squares of such components would overflow or vanish; the cosine has no scale.
    most = F.array_max(F.transform(v, F.abs))
    rows = rows.withColumn("vector", F.when(good & ((most > HUGE) | (most < 1 / HUGE)), F.transform(v, lambda x: x / most)).otherwise(v))
    rows = rows.withColumn("cid", F.when(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(good, F.lit(False)), F.xxhash64("label", "vector")))
    classes, _ = stored(rows.where("cid IS NOT NULL").groupBy("cid").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.min("id").alias("least"), F.count("*").alias("n")), "lattice")
    groups, _ = stored(linked(classes, threshold, **kw), "lattice")
    tops_of = groups.select("node", "component").union(groups.select("component", "component").distinct())
    members, _ = stored(classes.join(tops_of, F.col("cid") == F.col("node")).select("cid", "component", "vector", "n"), "lattice")
    direct = link_counts(members, threshold)
    named = classes.select("cid", "n", "least").join(groups, F.col("cid") == F.col("node"), "left").join(direct, "cid", "left")
    named = named.select("cid", "n", "least", F.coalesce("component", "cid").alias("component"), F.coalesce("linked", F.lit(0)).alias("linked"))
    tops = named.join(groups.select(F.col("component").alias("top")).distinct(), F.col("component") == F.col("top"), "left_semi").groupBy("component").agg(F.min("least").alias("group_least"))
    final = named.join(tops, "component", "left").select("cid", (F.col("linked") + F.col("n") - 1).alias("n_links"), F.coalesce("group_least", "least").alias("component_id"))
    ok = rows.where("cid IS NOT NULL").select("id", "cid").join(final, "cid").select("id", "n_links", "component_id")
    alone = rows.where("cid IS NULL").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return ok.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_lattice(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
