"""Operator 1. Text scores by a hierarchical Pitman-Yor language model.

A text is its words and one end. The model of the next token given the last one:

* The SYMBOLS most frequent tokens are dishes of their own, all others share
  the dish RARE. Every word of the corpus, however rare, is a context and has a
  restaurant of these dishes; the context restaurants share one parent without
  context, whose base is uniform.
* Which rare word it is depends on the context too: what rare words follow a context
  is a restaurant of its own, below one restaurant of all rare words, whose base spells
  words byte by byte: restaurants for contexts of up to ORDER bytes (a blank marks
  the word's beginning), the parent of a context being the one without its first
  byte, down to the empty one, whose base is uniform over 256 bytes and an end.
  So every word has a probability, seen or not; what all unknown words have together
  is the probability of the event `unknown`.

Seating is Chinese-restaurant with discounts. A table sends a customer to the
parent restaurant (a table of rare words sends its spelling). A Gibbs sweep reseats
the customers of every dish, one dish at a time as a block, given the tables of the
restaurant's other dishes and the parent's probabilities as the last sweep (of word
contexts: the last round of sweeps) left them; dishes are independent then. The word contexts and the spelling share nothing
but the counts, so each has its own sweeps; predictive probabilities are averaged
over the sweeps after burn-in. Random numbers are hashes of restaurant, dish and
sweep, so they do not depend on partitions or batches.

A word context is one row (r, s, n, t, ...) with arrays of at most SYMBOLS + 2
dishes; a round maps these rows, and only the tables of each dish go up. Spelling
restaurants are rows of (level, r, s, c, t), and their sweeps joins level by level.
Rare words of a context are rows of (r, w, n, t), a row a pair; a pair seen once has one
table, so only the others are seated, by joins with their context and their word.
Words are known as contexts, and rare words in pairs, by 60 bits of their XXH64.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stored, fold, ship, stored, table

SYMBOLS, ORDER = 1000, 4
#: Sweeps of the spelling, and of the word contexts.
BURN_IN, SAMPLES = 1, 2
CONTEXT_BURN_IN, CONTEXT_SAMPLES = 4, 3
#: Sweeps of the contexts for one seating of their parent, before the samples.
CONTEXT_ROUND = 3
#: Discounts of spelling by the context's bytes, of symbols without and with context, and of rare words; one strength.
SPELLING, PAIRS, WORDS, STRENGTH = (0.5, 0.6, 0.7, 0.75, 0.8), (0.5, 0.75), 0.7, 1.0
#: Words whose numbers every scoring task holds; the others' are joined.
HELD_WORDS = 100_000
#: Pairs of context and dish whose probabilities every scoring task holds (the most frequent); the others' are joined.
HELD_PAIRS = 2_000_000
#: Rows of spelling probabilities that are broadcast at most (16 bytes each); more are joined.
HELD_GRAMS = 4_000_000
END_BYTE = 256
#: A worker's counts are handed on when they have so many words.
FLUSH = 400_000
#: Tokens that a task works on at once; words it has numbers for at once.
CHUNK, KNOWN = 500_000, 300_000
CONTEXT_BITS = (1 << 60) - 1
#: Customers of a dish that sit down one by one; then in groups, each a GROUP-th of those seated.
ALONE, GROUP = 64, 16
#: Contexts that a sweep's task seats at once.
TOGETHER = 100_000


def tokens(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, runs without the six ASCII white-space bytes."""
    return (text or b"").lower().split()


class Draws:
    """Uniform numbers in (0, 1), for each key a sequence of its own."""

    def __init__(self, *parts: np.ndarray | int) -> None:
        key = np.zeros(1, np.uint64)
        for part in parts:
            key = self._mixed(key ^ np.asarray(part).astype(np.int64).view(np.uint64))
        self.key, self.drawn = key, np.zeros(len(key), np.uint64)

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        """The finaliser of SplitMix64."""
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def next(self, at: np.ndarray) -> np.ndarray:
        self.drawn[at] += np.uint64(1)
        return ((self._mixed(self.key[at] ^ self._mixed(self.drawn[at])) >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52

    def log_gamma(self, shape: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Logarithms of gamma numbers, by rejection from a cubed normal number; a shape below 1 is drawn as one more and shrunk."""
        d = np.where(shape < 1, shape + 1, shape) - 1.0 / 3
        out, todo = np.empty(len(shape)), np.arange(len(shape))
        while len(todo):
            x = np.sqrt(-2 * np.log(self.next(at[todo]))) * np.cos(2 * np.pi * self.next(at[todo]))
            v = (1 + x / np.sqrt(9 * d[todo])) ** 3
            log_v = np.log(np.maximum(v, 1e-300))
            good = (v > 0) & (np.log(self.next(at[todo])) < x * x / 2 + d[todo] * (1 - v + log_v))
            out[todo[good]] = np.log(d[todo[good]]) + log_v[good]
            todo = todo[~good]
        small = np.flatnonzero(shape < 1)
        out[small] += np.log(self.next(at[small])) / shape[small]
        return out


def seat(customers: np.ndarray, others: np.ndarray, base: np.ndarray, discount: np.ndarray, draws: Draws) -> np.ndarray:
    """Tables after each dish's customers have sat down one after another.

    others: strength + discount * tables of the other dishes. The n-th customer
    opens table t + 1 with odds (others + discount * t) * base to n - discount * t.
    How many sit down before that is a geometric number whose chance is a beta
    number, so the work is a step per table. After ALONE customers whole groups
    sit down at one chance, an approximation, so that a hot dish takes steps by the
    logarithm of its customers.
    """
    t, n = np.minimum(customers, 1).astype(float), np.ones(len(customers))
    first = np.minimum(customers, ALONE)
    active = np.flatnonzero(customers > 1)
    while len(active):
        open_, sit = (others[active] + discount[active] * t[active]) * base[active], n[active] - discount[active] * t[active]
        odds = draws.log_gamma(np.maximum(open_, 1e-300), active) - draws.log_gamma(sit, active)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            wait = np.floor(np.log(draws.next(active)) / -np.logaddexp(0, odds))
        n[active] += np.where(np.isfinite(wait), wait, np.inf) + 1
        active = active[n[active] <= first[active]]
        t[active] += 1
    # Groups: the chance of a new table is the one expected at the group's middle, the number of new tables close to binomial.
    active = np.flatnonzero(customers > ALONE)
    n[active] = ALONE
    while len(active):
        group = np.minimum(np.ceil(n[active] / GROUP), customers[active] - n[active])
        half, tables = (group - 1) / 2, t[active]
        for _ in range(2):
            open_ = (others[active] + discount[active] * tables) * base[active]
            chance = open_ / (open_ + n[active] + half - discount[active] * tables)
            tables = t[active] + half * chance
        mean = group * chance
        new, many = np.zeros(len(active)), mean > 9
        wide, few = active[many], active[~many]
        normal = np.sqrt(-2 * np.log(draws.next(wide))) * np.cos(2 * np.pi * draws.next(wide))
        new[many] = np.floor(mean[many] + np.sqrt(mean[many] * (1 - chance[many])) * normal + draws.next(wide))
        for _ in range(GROUP):
            new[~many] += draws.next(few) < mean[~many] / GROUP
        t[active] += np.clip(new, 0, group)
        n[active] += group
        active = active[n[active] < customers[active]]
    return t


def grams(words: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each word and its end the key, context * 512 + byte, and the word's number.

    A context is 1 followed by its last bytes, at most `order`, the blank before
    the word included.
    """
    text = np.frombuffer(b"".join(b" " + w for w in words), np.uint8).astype(np.int64)
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    context, length = np.zeros(len(text), np.int64), np.minimum(place + 1, order)
    for k in range(order):
        use = length > k
        back = np.flatnonzero(use) - k
        context[use] |= text[back] << (8 * k)
    context |= np.int64(1) << (8 * length)
    follow = np.append(text[1:], END_BYTE)
    follow[np.cumsum(sizes) - 1] = END_BYTE
    return context * 512 + follow, owner


def _parent(r: Column, level: int) -> Column:
    """The restaurant above: the context without its first byte."""
    keep = 1 << (8 * (level - 1))
    return r.bitwiseAND(F.lit(keep - 1).cast("bigint")).bitwiseOR(F.lit(keep).cast("bigint"))


@dataclass
class Sizes:
    """What all of the corpus adds up to."""

    tokens: int
    types: int
    texts: int
    symbols: dict[bytes, int]
    unknown: float = 1.0


@dataclass
class Contexts:
    """The word contexts: rows r, s, n, p (arrays by dish; p averaged) and ways (of each sample), the parent's probabilities by sample and dish, and the log-likelihood a token before each sweep."""

    rows: DataFrame
    roots: np.ndarray
    trace: list[float]
    #: r, w, known, base_n, total, spelled of all pairs of context and rare word in the texts (followers()); None: rare words don't depend on contexts.
    pairs: DataFrame | None = None


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each word of any text is in texts to learn from. docs: learn (boolean), text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, every = Counter(), set()

        def out() -> pa.RecordBatch:
            words = list(every.union(learned))
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([learned[w] for w in words], pa.int64())], names=["word", "n"])

        for b in batches:
            for learn, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                (learned if learn else every).update(tokens(text))
                if len(learned) + len(every) > FLUSH:
                    yield out()
                    learned, every = Counter(), set()
        yield out()

    return docs.select("learn", "text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Numbered(dict):
    """Words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


def chunks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[Numbered, list, np.ndarray, np.ndarray]]:
    """About CHUNK tokens at a time: the words so far, the texts' (batch, place), their sizes with the end, and all tokens' word numbers.

    An end is the empty word, number 0. The words start anew when there are more than KNOWN.
    """
    words, held, sizes, rows, waiting = Numbered({b"": 0}), [], [], [], 0
    for b in batches:
        for place, x in enumerate(b.column(text).cast(pa.binary()).to_pylist()):
            ws = tokens(x)
            ws.append(b"")
            held.append(np.fromiter(map(words.__getitem__, ws), np.int64, len(ws)))
            sizes.append(len(ws))
            rows.append((b, place))
            waiting += len(ws)
            if waiting >= CHUNK:
                yield words, rows, np.array(sizes), np.concatenate(held)
                held, sizes, rows, waiting = [], [], [], 0
                if len(words) > KNOWN:
                    words = Numbered({b"": 0})
    if rows:
        yield words, rows, np.array(sizes), np.concatenate(held)


def context_ids(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, 42) & CONTEXT_BITS for w in words], np.int64)


def before(of: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each: the one to its left, and the end (0) before a text's first."""
    out = np.empty_like(of)
    out[1:] = of[:-1]
    out[np.cumsum(sizes) - sizes] = 0
    return out


def pair_counts(docs: DataFrame, symbols: dict[bytes, int], size: int) -> DataFrame:
    """r, s, n: how often dish s follows the context r in texts to learn from. Dishes: 0 end, 1 RARE, then the symbols; the context before a text's first word is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_words, r, s = None, None, None
        for words, _, sizes, of in chunks(batches, 0):
            if words is not of_words:
                of_words, r, s = words, np.zeros(0, np.int64), np.zeros(0, np.int64)
            fresh = list(islice(words, len(r), None))
            r = np.concatenate((r, context_ids(fresh)))
            s = np.concatenate((s, np.array([0 if w == b"" else symbols.get(w, 1) for w in fresh], np.int64)))
            pair, n = np.unique(before(of, sizes) * size + s[of], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(r[pair // size]), pa.array((pair % size).astype(np.int32)), pa.array(n)], names=["r", "s", "n"])

    return docs.where("learn").select("text").mapInArrow(run, "r bigint, s int, n bigint").groupBy("r", "s").agg(F.sum("n").alias("n"))


def rare_pair_counts(docs: DataFrame, symbols: dict[bytes, int]) -> DataFrame:
    """r, w, n: how often the rare word w follows the context r in texts to learn from, for all pairs of any text. docs: learn (boolean), text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_words, ids, rare = None, None, None
        for words, rows, sizes, of in chunks(batches, 1):
            if words is not of_words:
                of_words, ids, rare = words, np.zeros(0, np.int64), np.zeros(0, bool)
            fresh = list(islice(words, len(ids), None))
            ids = np.concatenate((ids, context_ids(fresh)))
            rare = np.concatenate((rare, np.array([w != b"" and w not in symbols for w in fresh], bool)))
            learn = np.repeat(np.array([b.column(0)[k].as_py() for b, k in rows], bool), sizes)
            at = np.flatnonzero(rare[of])
            pair, place = np.unique(before(of, sizes)[at] * len(ids) + of[at], return_inverse=True)
            n = np.bincount(place, learn[at], len(pair)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[pair // len(ids)]), pa.array(ids[pair % len(ids)]), pa.array(n)], names=["r", "w", "n"])

    return docs.select("learn", "text").mapInArrow(run, "r bigint, w bigint, n bigint").groupBy("r", "w").agg(F.sum("n").alias("n"))


def word_id(word: str) -> Column:
    """context_ids() of a column."""
    return F.xxhash64(word).bitwiseAND(F.lit(CONTEXT_BITS))


class Followers:
    """The restaurants of the rare words that follow each context. Nothing of them is held whole: all are rows, and sums by context and by word."""

    def __init__(self, docs: DataFrame, symbols: dict[bytes, int]) -> None:
        self.spark = docs.sparkSession
        self.every, _ = stored(rare_pair_counts(docs, symbols), "pitman-yor")
        # Pairs seen once have one table for ever.
        self.still = self.every.where("n <= 1").withColumn("t", F.col("n"))
        self.seated, self.at = stored(self.every.where("n > 1").withColumn("t", F.lit(1).cast("bigint")), "pitman-yor")

    def sums(self, by: str) -> DataFrame:
        """by, customers, tables."""
        return self.still.where("n > 0").unionByName(self.seated).groupBy(by).agg(F.sum("n").alias("customers"), F.sum("t").alias("tables"))

    def reseat(self, parent: DataFrame, seed: int) -> None:
        """A sweep. parent: w, p."""
        d = PAIRS[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in gathered(batches):
                n, t, tables, p = (np.asarray(b.column(k)).astype(float) for k in (2, 3, 4, 5))
                new = seat(n, STRENGTH + d * (tables - t), p, np.full(len(n), d), Draws(seed, np.asarray(b.column(0)), np.asarray(b.column(1))))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(new.astype(np.int64))], names=["r", "w", "n", "t"])

        rows = self.seated.join(self.sums("r").select("r", "tables"), "r").join(parent.select("w", "p"), "w")
        new, at = stored(rows.select("r", "w", "n", "t", "tables", "p").mapInArrow(run, "r bigint, w bigint, n bigint, t bigint"), "pitman-yor")
        drop_stored(self.spark, self.at)
        self.seated, self.at = new, at

    def logs(self, words: DataFrame, unknown: float) -> DataFrame:
        """r, w, known, base_n, total, spelled: the log10 probabilities of all pairs; total has the unknown words' together. words: word, n, p of the rare ones."""
        rooms = self.sums("r").select("r", "customers", (STRENGTH + PAIRS[1] * F.col("tables")).alias("open"))
        rows = self.still.unionByName(self.seated).join(rooms, "r", "left").join(words.select(word_id("word").alias("w"), F.col("n").alias("base_n"), "p"), "w")
        all_ = STRENGTH + F.coalesce(F.col("customers"), F.lit(0))
        of = lambda p: F.log10((F.col("n") - PAIRS[1] * F.col("t") + F.coalesce(F.col("open"), F.lit(STRENGTH)) * p) / all_)
        known = F.col("base_n") > 0
        return rows.select("r", "w", known.cast("bigint").alias("known"), "base_n", of(F.when(known, F.col("p")).otherwise(unknown)).alias("total"), of(F.col("p")).alias("spelled"))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at least TOGETHER, the last one smaller; none is empty."""
    held, rows = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= TOGETHER:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if held:
        yield pa.concat_batches(held)


def context_round(rows: DataFrame, parents: np.ndarray, first: int, samples: bool) -> DataFrame:
    """A sweep of the contexts under each of the `parents` (rows of probabilities by dish). rows: r, s, n, and t, without which a dish has one table.

    Returns r, s, n, t; if `samples` instead of t the averaged predictive
    probabilities p and the ways up of each sample. likelihood: of the context's
    customers before each sweep. first: the number of the first sweep.
    """
    shared = rows.sparkSession.sparkContext.broadcast(parents)
    seated = "t" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parents, d = shared.value, PAIRS[1]
        for b in gathered(batches):
            r, sizes = np.asarray(b.column(0)), np.asarray(b.column(1).value_lengths())
            s, n = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2))
            t = b.column(3).flatten().to_numpy(zero_copy_only=False) if seated else np.ones(len(n), np.int64)
            start, many = np.cumsum(sizes) - sizes, np.flatnonzero(n > 1)
            owner = np.repeat(np.arange(len(r)), sizes)
            all_ = np.add.reduceat(n, start) + STRENGTH
            likelihood, ways, p = np.empty((len(r), len(parents))), np.empty((len(r), len(parents))), np.zeros(len(n))
            for k, parent in enumerate(parents):
                open_ = STRENGTH + d * np.add.reduceat(t, start)
                now = (n - d * t + open_[owner] * parent[s]) / all_[owner]
                p += now
                ways[:, k], likelihood[:, k] = open_ / all_, np.add.reduceat(n * np.log(now), start)
                if not samples or k + 1 < len(parents):
                    others = open_[owner[many]] - d * t[many]
                    t = np.ones(len(n), np.int64)
                    t[many] = seat(n[many].astype(float), others, parent[s[many]], np.full(len(many), d), Draws(first + k, r[owner[many]], s[many]))
            by_dish, by_parent = pa.array(np.append(start, len(n)).astype(np.int32)), pa.array(np.arange(len(r) + 1, dtype=np.int32) * len(parents))
            of_dishes = {"s": s.astype(np.int32), "n": n} | ({"p": p / len(parents)} if samples else {"t": t})
            of_parents = ({"ways": ways.ravel()} if samples else {}) | {"likelihood": likelihood.ravel()}
            lists = [pa.ListArray.from_arrays(by_dish, pa.array(x)) for x in of_dishes.values()] + [pa.ListArray.from_arrays(by_parent, pa.array(x)) for x in of_parents.values()]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["r", *of_dishes, *of_parents])

    last = "p array<double>, ways array<double>" if samples else "t array<bigint>"
    return rows.select("r", "s", "n", *["t"] * seated).mapInArrow(run, f"r bigint, s array<int>, n array<bigint>, {last}, likelihood array<double>")


def train_contexts(pairs: DataFrame, size: int, burn_in: int = CONTEXT_BURN_IN, samples: int = CONTEXT_SAMPLES, together: int = CONTEXT_ROUND) -> Contexts:
    """pairs: r, s, n. The parent's counts, at most `size` numbers, are all that leaves the executors.

    All begins with one table per dish, then there are burn_in + 1 sweeps before the
    first sample. They go in rounds of up to `together`: the parent is seated for each
    sweep, by the tables that the round before sent up, so a round reads and writes
    the contexts once. The last round has the samples.
    """
    spark = pairs.sparkSession

    def by_dish(tables: DataFrame) -> np.ndarray:
        out = np.zeros(size)
        for s, t in tables.groupBy("s").agg(F.sum("t")).collect():
            out[s] = t
        return out

    pairs, at = stored(pairs, "pitman-yor")
    entry = F.sort_array(F.collect_list(F.struct("s", "n")))
    rows = pairs.groupBy("r").agg(entry.alias("e")).select("r", F.col("e.s").alias("s"), F.col("e.n").alias("n"))
    customers = by_dish(pairs.select("s", F.lit(1).alias("t")))
    base, own, trace, done = np.full(size, 1.0 / size), np.zeros(size), [], 0
    while done < burn_in + 1 + samples:
        last = done > burn_in
        parents = []
        for k in range(done, done + (samples if last else min(together, burn_in + 1 - done))):
            own = seat(customers, STRENGTH + PAIRS[0] * (own.sum() - own), base, np.full(size, PAIRS[0]), Draws(k, np.arange(size))) if k else np.minimum(customers, 1)
            parents.append((customers - PAIRS[0] * own + (STRENGTH + PAIRS[0] * own.sum()) * base) / (customers.sum() + STRENGTH))
        new, new_at = stored(context_round(rows, np.array(parents), done, last), "pitman-yor")
        drop_stored(spark, at)
        rows, at, done = new, new_at, done + len(parents)
        sums = [F.sum(F.get("likelihood", F.lit(k))) for k in range(len(parents))]
        *logs, n = rows.agg(*sums, F.sum(F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()
        trace += [x / n if n else 0.0 for x in logs]
        if not last:
            customers = by_dish(rows.select(F.explode(F.arrays_zip("s", "t")).alias("e")).select("e.*"))
    return Contexts(rows.drop("likelihood"), np.array(parents), trace)


def spelled_counts(words: DataFrame) -> DataFrame:
    """r, s, n of the spelling restaurants: the grams of each word once for each of its tables. words: word, t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, owner = grams(b.column(0).cast(pa.binary()).to_pylist())
            keys, where = np.unique(key, return_inverse=True)
            n = np.bincount(where, np.asarray(b.column(1))[owner], len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys // 512), pa.array((keys % 512).astype(np.int32)), pa.array(n)], names=["r", "s", "n"])

    return words.where("t > 0").select("word", "t").mapInArrow(run, "r bigint, s int, n bigint").groupBy("r", "s").agg(F.sum("n").alias("n"))


def _level(r: Column) -> Column:
    """Bytes of a context."""
    return F.floor(F.log2(r.cast("double") + 0.5) / 8).cast("int")


def sweep(own: DataFrame, last: DataFrame | None, seed: int) -> tuple[DataFrame, list[str]]:
    """One Gibbs sweep over all spelling restaurants, from the longest contexts up.

    own: level, r, s, n (customers from outside); last: the result of the sweep
    before (None: every dish sits at one table). Returns level, r, s, c, t, above
    (the parent's probability), p (the predictive probability), and all and open
    of the restaurant (strength + customers, strength + discount * tables); and
    the paths of its tables, one for each level, so no level is computed twice.
    """
    spark = own.sparkSession
    seated, below, paths, left = {}, None, [], []
    for level in range(ORDER, -1, -1):
        here = own.where(F.col("level") == level).select("r", "s", "n")
        if below is not None:
            here = here.union(below)
        here = here.groupBy("r", "s").agg(F.sum("n").alias("c"))
        if last is None:
            here = here.withColumn("t", F.lit(1).cast("bigint"))
        else:
            before = last.where(F.col("level") == level).select("r", "s", F.col("t").alias("was"), F.col("open").alias("opened"), "above")
            here = _reseated(here.join(before, ["r", "s"]), level, seed)
        seated[level], at = stored(here, "pitman-yor")
        left.append(at)
        if level:
            below = seated[level].select(_parent(F.col("r"), level).alias("r"), "s", F.col("t").alias("n"))
    base = F.lit(1.0 / 257)
    room, found, upper = Window.partitionBy("r"), None, None
    for level in range(ORDER + 1):
        d = SPELLING[level]
        here = seated[level].withColumns({"level": F.lit(level), "all": F.sum("c").over(room) + STRENGTH, "open": F.sum("t").over(room) * d + STRENGTH})
        if level == 0:
            here = here.withColumn("above", base)
        else:
            here = here.withColumn("r_above", _parent(F.col("r"), level)).join(upper, ["r_above", "s"]).drop("r_above")
        here = here.withColumn("p", (F.col("c") - d * F.col("t") + F.col("open") * F.col("above")) / F.col("all"))
        here, at = stored(here.select("level", "r", "s", "c", "t", "above", "p", "all", "open"), "pitman-yor")
        paths.append(at)
        upper = here.select(F.col("r").alias("r_above"), "s", F.col("p").alias("above"))
        found = here if found is None else found.unionByName(here)
    for at in left:
        drop_stored(spark, at)
    return found, paths


def _reseated(rows: DataFrame, level: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = SPELLING[level]
        for b in batches:
            c, was, opened, above = (np.asarray(b.column(k)).astype(float) for k in (2, 3, 4, 5))
            draws = Draws(seed, np.asarray(b.column(0)), np.asarray(b.column(1)))
            t = seat(c, opened - d * was, above, np.full(len(c), d), draws)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(t.astype(np.int64))], names=["r", "s", "c", "t"])

    return rows.select("r", "s", "c", "was", "opened", "above").mapInArrow(run, "r bigint, s int, c bigint, t bigint")


def _spelling_table(state: DataFrame) -> DataFrame:
    """Longest-context probabilities (key, p) and, for what a context never had, its way up (key of byte 511: open / all)."""
    seen = state.select((F.col("r") * 512 + F.col("s")).alias("key"), "p")
    ways = state.groupBy("r").agg(F.first(F.col("open") / F.col("all")).alias("p")).select((F.col("r") * 512 + 511).alias("key"), "p")
    return seen.union(ways)


def _walk(key: np.ndarray, get) -> np.ndarray:
    """Log probability of each key: up from its context until the byte was seen there. get(keys) gives p, or nan."""
    r, s = key // 512, key % 512
    log, open_ = np.zeros(len(key)), np.arange(len(key))
    while len(open_):
        p = get(r[open_] * 512 + s[open_])
        seen = ~np.isnan(p)
        log[open_[seen]] += np.log(p[seen])
        open_ = open_[~seen]
        top = r[open_] == 1
        way = get(r[open_] * 512 + 511)
        way[np.isnan(way)] = 1.0  # a context that nothing followed
        log[open_] += np.log(way)
        log[open_[top]] += np.log(1.0 / 257)
        open_ = open_[~top]
        up = r[open_]
        keep = np.int64(1) << (8 * (np.floor(np.log2(up + 0.5)).astype(np.int64) // 8 - 1))
        r[open_] = (up & (keep - 1)) | keep
    return log


def respelled(words: DataFrame, state: DataFrame, tables: int, seed: int, held_grams: int = HELD_GRAMS) -> DataFrame:
    """words with new tables t and the probability `spell` of the spelling.

    words: word, n, t, p_sum (passed on); tables: the restaurant's sum so far.
    The spelling probabilities are broadcast if they are few enough; else every
    gram with all its ways up is joined.
    """
    known = _spelling_table(state)
    spark = words.sparkSession

    fields = "word string, n bigint, t bigint, p_sum double, spell double"
    if known.count() <= held_grams:
        got = known.toArrow().sort_by("key")
        shared = spark.sparkContext.broadcast((np.asarray(got.column("key")), np.asarray(got.column("p"))))

        def logs(batch_words: list[bytes]) -> np.ndarray:
            keys, p = shared.value

            def get(k: np.ndarray) -> np.ndarray:
                at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                return np.where(keys[at] == k, p[at], np.nan) if len(keys) else np.full(len(k), np.nan)

            key, owner = grams(batch_words)
            some, where = np.unique(key, return_inverse=True)
            return np.bincount(owner, _walk(some, get)[where], len(batch_words))

        source = words.select("word", "n", "t", "p_sum")
    else:
        # Each gram's ways up: a row for every level of its context.
        def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                key, owner = grams(b.column(0).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(b.column(1))[owner]), pa.array(key)], names=["id", "key"])

        ids = words.withColumn("id", F.xxhash64("word"))
        rows = ids.select("word", "id").mapInArrow(ways, "id bigint, key bigint")
        uniq = rows.select("key").distinct()
        steps = uniq.select("key", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("up")).withColumn("r", F.shiftright("key", 9))
        level = _level(F.col("r"))
        keep = F.expr("shiftleft(cast(1 as bigint), 8 * (lv - up))")
        steps = steps.withColumn("lv", level).where("up <= lv").withColumn("r", F.col("r").bitwiseAND(keep - 1).bitwiseOR(keep))
        seen = steps.withColumn("k", F.col("r") * 512 + F.col("key") % 512).join(known.select(F.col("key").alias("k"), F.col("p").alias("p_seen")), "k", "left")
        seen = seen.withColumn("k", F.col("r") * 512 + 511).join(known.select(F.col("key").alias("k"), F.col("p").alias("p_way")), "k", "left")
        path = seen.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("up", "p_seen", "p_way"))).alias("path"))
        start = F.struct(F.lit(0.0).alias("log"), F.lit(False).alias("done"))
        walked = F.aggregate("path", start, lambda a, x: F.when(a["done"], a).when(x["p_seen"].isNotNull(), F.struct((a["log"] + F.log(x["p_seen"])).alias("log"), F.lit(True).alias("done"))).otherwise(F.struct((a["log"] + F.log(F.coalesce(x["p_way"], F.lit(1.0)))).alias("log"), F.lit(False).alias("done"))))
        found = path.select("key", (walked["log"] + F.when(walked["done"], 0.0).otherwise(float(np.log(1.0 / 257)))).alias("log"))
        by_word = rows.join(found, "key").groupBy("id").agg(F.sum("log").alias("log"))
        source = ids.join(by_word, "id").select("word", "n", "t", "p_sum", "log")
        logs = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            n, t = (np.asarray(b.column(k)).astype(float) for k in (1, 2))
            spell = np.exp(logs(b.column(0).cast(pa.binary()).to_pylist()) if logs else np.asarray(b.column(4)))
            draws = Draws(seed, context_ids([w.encode() for w in b.column(0).to_pylist()]))
            new = seat(n, STRENGTH + WORDS * (tables - t), spell, np.full(len(n), WORDS), draws)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new.astype(np.int64)), b.column(3), pa.array(spell)], names=["word", "n", "t", "p_sum", "spell"])

    return source.mapInArrow(run, fields)


def train(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES, n_symbols: int = SYMBOLS, held_grams: int = HELD_GRAMS, followers: bool = False) -> tuple[Sizes, Contexts, DataFrame]:
    """Sizes, the word contexts, and the table of all words: word, n, p (rare words: the averaged probability among rare ones).

    docs: learn (boolean), text. Words of texts not to learn from are rows too,
    with n = 0, so that they have a probability. followers: which rare word it is
    depends on the context; the customers of the restaurant of rare words are then the
    tables of the contexts' ones, which are seated once after each of its seatings.
    """
    spark = docs.sparkSession
    ship(spark)
    words, _ = stored(word_counts(docs), "pitman-yor")
    totals = words.agg(F.sum("n"), F.count_if(F.col("n") > 0)).first()
    texts = docs.where("learn").count()
    top = words.where("n > 0").orderBy(F.desc("n"), "word").limit(n_symbols).select("word", "n").collect()
    symbols = {r[0].encode(): k + 2 for k, r in enumerate(top)}
    sizes = Sizes((totals[0] or 0) + texts, totals[1] + (texts > 0), texts, symbols)
    contexts = train_contexts(pair_counts(docs, symbols, n_symbols + 2), n_symbols + 2)
    hot = spark.createDataFrame([(w.decode(),) for w in symbols], "word string")
    rare = words.join(F.broadcast(hot), "word", "left_anti")  # at most n_symbols rows
    below = Followers(docs, symbols) if followers else None

    def sent_up(rare: DataFrame) -> DataFrame:
        """rare with the tables of its followers as customers n."""
        sums = below.sums("w").select("w", F.col("tables").alias("n"))
        return rare.drop("n").withColumn("w", word_id("word")).join(sums, "w", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))

    own_rare = sent_up(rare) if below else rare
    rare, at = stored(own_rare.select("word", "n", F.least("n", F.lit(1)).alias("t"), F.lit(0.0).alias("p_sum")), "pitman-yor")
    state, unknown = None, 0.0
    customers = totals[0] - sum(n for _, n in top) if top else 0
    for k in range(burn_in + samples):
        own, own_at = stored(spelled_counts(rare).withColumn("level", _level(F.col("r"))), "pitman-yor")
        if state is None:
            state, old = sweep(own, None, 0)
        state, paths = sweep(own, state, k + 1)
        for path in [own_at, *old]:
            drop_stored(spark, path)
        old = paths
        tables = rare.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
        new, new_at = stored(respelled(rare, state, tables, k + 1, held_grams), "pitman-yor")
        drop_stored(spark, at)
        rare, at = new, new_at
        if below:
            customers = rare.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if k >= burn_in or below:
            tables, known = rare.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("spell"))), F.lit(0.0))).first()
            way = (STRENGTH + WORDS * tables) / (STRENGTH + customers)
            p = (F.col("n") - WORDS * F.col("t")) / (STRENGTH + customers) + way * F.col("spell")
        if k >= burn_in:
            unknown += way * max(1e-12, 1.0 - known)
            rare = rare.withColumn("p_sum", F.col("p_sum") + p)
        if below:
            below.reseat(new.select(word_id("word").alias("w"), p.alias("p")), k + 1)
            if k + 1 < burn_in + samples:
                new, new_at = stored(sent_up(rare).select("word", "n", "t", "p_sum"), "pitman-yor")
                drop_stored(spark, at)
                rare, at = new, new_at
    rare = rare.select("word", "n", (F.col("p_sum") / samples).alias("p"))
    if below:
        rare = rare.drop("n").join(words, "word").select("word", "n", "p")
        contexts.pairs = below.logs(rare, unknown / samples)
    every = rare.unionByName(words.join(F.broadcast(hot), "word").select("word", "n", F.lit(None).cast("double").alias("p")))
    sizes.unknown = unknown / samples
    return sizes, contexts, every


def held_pairs(contexts: Contexts, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts (sorted) of the most frequent pairs, the pairs as place of context * dishes + dish (sorted), and their log10 probabilities."""
    pairs = contexts.rows.select("r", F.explode(F.arrays_zip("s", "n", "p")).alias("e")).select("r", "e.s", "e.n", "e.p")
    least, room = None, most
    for n, k in pairs.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().orderBy(F.desc("n")).collect():
        room -= k
        if room < 0:
            break
        least = n
    got = pairs.where(F.lit(False) if least is None else F.col("n") >= least).select("r", "s", "p").toArrow()
    r, s, p = (np.asarray(got.column(k)) for k in range(3))
    held, place = np.unique(r, return_inverse=True)
    key = place * contexts.roots.shape[1] + s
    order = np.argsort(key)
    return held, key[order], np.log10(p[order])


def score(docs: DataFrame, model: tuple[Sizes, Contexts, DataFrame], held_words: int = HELD_WORDS, most_pairs: int = HELD_PAIRS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, open_score, perplexity; one row per row of docs.

    score has the base's events, the known types and one for all unknown words
    (what the model leaves for them together); open_score has every word's own
    probability by its spelling.

    docs: doc_id, learn, text. The numbers of the `held_words` most frequent
    words and of up to `most_pairs` pairs are in every task, those of the others
    are joined to the texts' rows of them. Rare words whose probability depends on the
    context are joined all of them.
    """
    sizes, contexts, words = model
    spark = docs.sparkSession
    pairs = contexts.pairs
    held = (words.where("p IS NULL") if pairs is not None else words.orderBy(F.desc("n"), "word").limit(held_words)).toArrow()
    log_base = -np.log10(sizes.tokens + sizes.types + 1)
    n = np.asarray(held.column("n")).astype(float)
    p = np.asarray(held.column("p").to_numpy(), float)
    open_logs = np.where(np.isnan(p), 0.0, np.log10(np.where(p > 0, p, 1.0)))
    log_unknown = float(np.log10(sizes.unknown))
    logs = np.where((n == 0) & ~np.isnan(p), log_unknown, open_logs)
    lookup = dict(zip([w.encode() for w in held.column("word").to_pylist()], range(held.num_rows), strict=True))
    # Columns: base, total, known, spelled; then the end, and a word that is joined.
    end = [np.log10(sizes.texts + 1) + log_base, 0.0, float(sizes.texts > 0), 0.0]
    numbers = np.vstack((np.stack((np.log10(n + 1) + log_base, logs, n > 0, open_logs), 1), end, np.zeros(4)))
    shared = spark.sparkContext.broadcast((sizes.symbols, lookup, numbers, held_pairs(contexts, most_pairs)))
    size = contexts.roots.shape[1]
    fields = f"row bigint, id {docs.schema['doc_id'].dataType.simpleString()}, learn boolean, word string, r bigint, s int, w bigint, n bigint, known bigint, base double, total double, spelled double"

    followed = pairs is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, lookup, numbers, (held_contexts, keys, p) = shared.value
        of_words = None
        for words, rows, sizes, of in chunks(batches, 1):
            if words is not of_words:
                of_words, r, s, at, place = words, *(np.zeros(0, np.int64) for _ in range(4))
            fresh = list(islice(words, len(r), None))
            new = context_ids(fresh)
            if len(held_contexts):
                near = np.minimum(np.searchsorted(held_contexts, new), len(held_contexts) - 1)
                near[held_contexts[near] != new] = -1
            else:
                near = np.full(len(new), -1)
            r, place = np.concatenate((r, new)), np.concatenate((place, near))
            s = np.concatenate((s, np.array([0 if w == b"" else symbols.get(w, 1) for w in fresh], np.int64)))
            at = np.concatenate((at, np.array([len(numbers) - 2 if w == b"" else lookup.get(w, len(numbers) - 1) for w in fresh], np.int64)))
            start, last = np.cumsum(sizes) - sizes, before(of, sizes)
            sums = np.add.reduceat(numbers[at[of]], start)
            # Pairs: held ones are added up, the others handed on.
            key, logs = place[last] * size + s[of], np.zeros(len(of))
            if len(keys):
                order = np.argsort(key)  # sorted keys are looked up side by side
                found = np.empty(len(key), np.int64)
                found[order] = np.minimum(np.searchsorted(keys, key[order]), len(keys) - 1)
                hit = keys[found] == key
                logs[hit] = p[found[hit]]
            else:
                hit = np.zeros(len(of), bool)
            pairs = np.add.reduceat(logs, start)
            row = np.array([b.column(0)[k].as_py() for b, k in rows], np.int64)
            rows_of, id_type = np.repeat(row, sizes), rows[0][0].schema.field(2).type
            ids, learn = (pa.array([b.column(c)[k].as_py() for b, k in rows], t) for c, t in ((2, id_type), (3, pa.bool_())))
            yield _scored(row, id_type, id=ids, learn=learn, n=sizes, known=sums[:, 2].astype(np.int64), base=sums[:, 0], total=sums[:, 1] + pairs, spelled=sums[:, 3] + pairs)
            missed = np.flatnonzero(~hit)
            yield _scored(rows_of[missed], id_type, r=r[last[missed]], s=s[of[missed]].astype(np.int32))
            other = np.flatnonzero(at[of] == len(numbers) - 1)
            if len(other) and followed:
                yield _scored(rows_of[other], id_type, r=r[last[other]], w=r[of[other]])
            elif len(other):
                names = list(words)
                yield _scored(rows_of[other], id_type, word=pa.array([names[i] for i in of[other].tolist()], pa.binary()).cast(pa.string()))

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "text", "doc_id", "learn")
    scored, _ = stored(numbered.mapInArrow(run, fields), "pitman-yor")
    totals = ("n", "known", "base", "total", "spelled")
    whole = scored.where("n IS NOT NULL").select("row", "id", "learn", *totals)
    if followed:
        one = scored.where("w IS NOT NULL").select("row", "r", "w").join(pairs, ["r", "w"])
        one = one.select("row", F.lit(0).cast("bigint").alias("n"), "known", (F.log10(F.col("base_n") + 1.0) + float(log_base)).alias("base"), "total", "spelled")
    else:
        one = _joined_words(scored, words, log_base, log_unknown)
    # A pair that was never seen has the averaged product of its context's way and the parent's probability.
    parent = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(contexts.roots.T)], "s int, root array<double>")
    two = scored.where("s IS NOT NULL").select("row", "r", "s").join(contexts.rows.select("r", F.col("s").alias("dishes"), "p", "ways"), "r", "left").join(F.broadcast(parent), "s")  # size rows
    seen = F.get("p", F.array_position("dishes", F.col("s")).cast("int") - 1)
    products = F.when(F.col("ways").isNull(), F.col("root")).otherwise(F.zip_with("ways", "root", lambda a, b: a * b))
    log = F.log10(F.coalesce(seen, F.aggregate(products, F.lit(0.0), lambda a, x: a + x) / len(contexts.roots)))
    two = two.select("row", *[F.lit(0).cast("bigint").alias(c) for c in totals[:2]], F.lit(0.0).alias("base"), log.alias("total"), log.alias("spelled"))
    rows = whole.unionByName(one, allowMissingColumns=True).unionByName(two, allowMissingColumns=True)
    rows = rows.groupBy("row").agg(F.max("id").alias("doc_id"), F.max("learn").alias("learn"), *[F.sum(c).alias(c) for c in totals])
    return rows.select("doc_id", (~F.col("learn")).alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(sizes.tokens).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), F.col("total").alias("score"), F.col("spelled").alias("open_score"), F.pow(10.0, -F.col("total") / F.col("n")).alias("perplexity"))


def _joined_words(scored: DataFrame, words: DataFrame, log_base: float, log_unknown: float) -> DataFrame:
    """The numbers of words that no task holds, by their rows of `scored`."""
    unknown = F.col("n") == 0
    one = scored.where("word IS NOT NULL").select("row", "word").join(words, "word")
    return one.select("row", F.lit(0).cast("bigint").alias("n"), F.when(unknown, 0).otherwise(1).cast("bigint").alias("known"), (F.log10(F.col("n") + 1.0) + float(log_base)).alias("base"), F.when(unknown, log_unknown).otherwise(F.log10("p")).alias("total"), F.log10("p").alias("spelled"))


def _scored(row: np.ndarray, id_type: pa.DataType, **columns) -> pa.RecordBatch:
    """A batch of the rows that score() stores, whose other columns are null."""
    types = {"id": id_type, "learn": pa.bool_(), "word": pa.string(), "r": pa.int64(), "s": pa.int32(), "w": pa.int64(), "n": pa.int64(), "known": pa.int64(), "base": pa.float64(), "total": pa.float64(), "spelled": pa.float64()}
    arrays = [pa.array(columns[c], t) if c in columns else pa.nulls(len(row), t) for c, t in types.items()]
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), *arrays], names=["row", *types])


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text: str = "text", folds: int = 7, held_out: int = 2, **kw) -> DataFrame:
    """Scores of all whole texts by a model of those whose id's crc32 modulo `folds` is not `held_out`.

    Null and empty texts are one end. Rows with a null id are learned from.
    Repeated rows count as often as they are there. Other columns are not read.
    Where there is nothing to learn from, all probabilities are the bases'. An
    empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (fold(F.col(f"`{id_col}`"), folds) != held_out).alias("learn"), F.col(f"`{text}`").alias("text"))
    return score(rows, train(rows, **{"followers": True} | kw)).withColumnRenamed("doc_id", id_col)


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model scores and unigram base scores of all whole documents."""
    return language_model_scores(table(spark, sf_dir, "documents"))
