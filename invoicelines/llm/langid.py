"""Operator 3. Language identification by sparse multinomial logistic regression.

Features are character n-grams of one to four letters, with word boundaries,
hashed to BUCKETS; their weights are TF-IDF, scaled to unit length. Document
frequencies count all learning documents. The model is trained by
follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties, so most
weights are zero) on a bounded sample of labelled rows (SAMPLE per language), and
a temperature is then fitted to a part of the sample that was kept out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import computed_beside, fold, ship, table

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Most learning documents of each language; one in five calibrates.
SAMPLE = 1200
#: Most n-grams of the sample, each counted once a text; 8 bytes each.
SAMPLE_GRAMS = 32 << 20
UNKNOWN = "und"
#: Follow-the-regularised-leader: rate, smoothing, L1 and L2 penalties, rounds over the sample; the bias's rate.
RATE, SMOOTH, L1, L2, ROUNDS, BIAS_RATE = 1.0, 1.0, 0.2, 0.5, 3, 0.1
NOT_LETTERS = regex.compile(r"\P{L}+")
#: The same for Spark: letters, and characters newer than Java's tables.
LETTER = r"[\p{L}\p{Cn}]"


def buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (text, bucket, count) of all n-grams of whole texts; texts without a letter have none.

    Lower-cased runs of letters are joined and framed by single blanks.
    """
    clean = []
    for t in texts:
        words = NOT_LETTERS.sub(" ", t.lower()).strip() if t else ""
        clean.append(f" {words} " if words else "")
    sizes = np.array([len(c) for c in clean], np.int64)
    chars = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(clean), dtype=np.int64), sizes)
    found = []
    for n in ORDERS:
        if len(chars) < n:
            continue
        h = np.full(len(chars) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ chars[k : len(chars) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = owner[: len(h)] == owner[n - 1 :]
        if n == 1:
            inside &= chars != 32
        found.append(owner[: len(h)][inside] * BUCKETS + (h[inside] % np.uint64(BUCKETS)).astype(np.int64))
    pairs, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
    return pairs // BUCKETS, pairs % BUCKETS, counts


@dataclass
class Model:
    """languages; weights (bucket, language); idf by bucket; temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, bucket, value): TF-IDF of unit length."""
        doc, bucket, count = buckets(texts)
        value = (1 + np.log(count)) * self.idf[bucket]
        length = np.sqrt(np.bincount(doc, value * value, len(texts)))
        return doc, bucket, value / np.maximum(length[doc], 1e-12)

    def logits(self, doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(doc, value * self.weights[bucket, k], n) + self.bias[k] for k in range(len(self.languages))], axis=1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated probability; UNKNOWN and 0 for a text without a letter, or if nothing was learned."""
        doc, bucket, value = self.vectors(texts)
        some = np.zeros(len(texts), bool)
        some[doc] = True
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        p = softmax(self.logits(doc, bucket, value, len(texts)) / self.temperature)
        best = p.argmax(axis=1)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, p.max(axis=1), 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], idf: np.ndarray) -> Model:
    """rows: (buckets, counts) of the sample's documents."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels], int)
    model = Model(languages, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)), idf)
    data = []
    for bucket, count in rows:
        v = (1 + np.log(count)) * idf[bucket]
        length = np.sqrt((v * v).sum())
        data.append((bucket, v / length if length else v))
    order = np.random.default_rng(3).permutation(len(data))
    kept_out, learn = order[: len(data) // 5], order[len(data) // 5 :]
    z, n = np.zeros((BUCKETS, len(languages))), np.zeros((BUCKETS, len(languages)))
    # The bias's own, without penalties.
    z0, n0 = np.zeros(len(languages)), np.zeros(len(languages))
    for _ in range(ROUNDS):
        for i in learn.tolist():
            b, v = data[i]
            zb, nb = z[b], n[b]
            w = np.where(np.abs(zb) > L1, -(zb - np.sign(zb) * L1) / ((SMOOTH + np.sqrt(nb)) / RATE + L2), 0.0)
            bias = -z0 / ((SMOOTH + np.sqrt(n0)) / BIAS_RATE)
            p = softmax((v @ w + bias)[None])[0]
            p[y[i]] -= 1.0
            g = v[:, None] * p
            grown = nb + g * g
            z[b] = zb + g - (np.sqrt(grown) - np.sqrt(nb)) / RATE * w
            n[b] = grown
            z0, n0 = z0 + p - (np.sqrt(n0 + p * p) - np.sqrt(n0)) / BIAS_RATE * bias, n0 + p * p
    model.bias = -z0 / ((SMOOTH + np.sqrt(n0)) / BIAS_RATE)
    model.weights = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((SMOOTH + np.sqrt(n)) / RATE + L2), 0.0)
    held = kept_out if len(kept_out) else learn
    logits = np.stack([data[i][1] @ model.weights[data[i][0]] + model.bias for i in held.tolist()])
    # Labels are smoothed by one document in all: a part without errors can't show that there are none.
    steps, slack = np.geomspace(0.02, 5.0, 120), 1.0 / (len(held) + 2)
    target = np.full(logits.shape, slack / logits.shape[1])
    target[np.arange(len(held)), y[held]] += 1 - slack
    loss = [-(target * np.log(softmax(logits / t) + 1e-300)).sum(axis=1).mean() for t in steps]
    model.temperature = float(steps[int(np.argmin(loss))])
    return model


def sampled(rows: DataFrame, sample: int) -> DataFrame:
    """body, lang, order: of each language the `sample` different texts with a letter that have the least hashes. rows: body, lang, order (the text's hash)."""
    # Limited before and after its shuffle, so a common language sends `sample` rows a task.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    usable = rows.where(F.col("body").rlike(LETTER)).select("lang", "order").distinct()
    chosen = usable.withColumn("place", place).where(F.col("place") <= sample).select("lang", "order")
    return rows.join(F.broadcast(chosen), ["lang", "order"]).dropDuplicates(["lang", "order"]).select("body", "lang", "order")


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 3, held_out: int = 1, sample: int = SAMPLE, most: int = SAMPLE_GRAMS) -> Model:
    """Learns from text and non-null lang of rows whose id's crc32 modulo `folds` is not `held_out`.

    The sample: of each language the `sample` different texts with a letter that
    have the least hashes. Copies and texts without a letter take no place. Beyond
    `most` n-grams (8 bytes each) over all languages the language with the most
    of them gives up its texts of the greatest hashes.
    """
    ship(docs.sparkSession)
    rows = docs.where(fold(F.col(f"`{id_col}`"), folds) != held_out).where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    rows = rows.select(F.col(f"`{text}`").alias("body"), F.col(f"`{lang}`").alias("lang"), F.xxhash64(F.col(f"`{text}`")).alias("order"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            texts = b.column(0).to_pylist()
            for at, to in _groups(texts):
                doc, bucket, _ = buckets(texts[at:to])
                total += np.bincount(bucket, minlength=BUCKETS)
                seen += len(np.unique(doc))
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(own, BUCKETS)), pa.array(np.append(total[own], seen))], names=["bucket", "n"])

    counted = rows.select("body").mapInArrow(frequencies, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS + 1 rows at most
    counts = np.zeros(BUCKETS + 1, np.int64)
    counts[np.asarray(counted.column("bucket"))] = np.asarray(counted.column("n"))
    idf = np.log((1 + counts[BUCKETS]) / (1 + counts[:BUCKETS])) + 1.0

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for at, to in _groups(texts):
                doc, bucket, count = buckets(texts[at:to])
                cuts = np.searchsorted(doc, np.arange(to - at + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (bucket, count)]
                yield pa.RecordBatch.from_arrays([b.column(1)[at:to], b.column(2)[at:to], *lists], names=["lang", "order", "buckets", "counts"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size: dict[str, int] = {}
        for b in batches:
            for name, order, bucket, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if len(bucket):
                    held.setdefault(name, []).append((order, bucket.values.to_numpy().copy(), count.values.to_numpy().copy()))
                    size[name] = size.get(name, 0) + len(bucket)
                while sum(size.values()) > most:  # rows come by their hashes: the last ones go
                    large = max(size, key=lambda x: (size[x], x))
                    size[large] -= len(held[large].pop()[1])
        data = [(b, c, x) for x in sorted(held) for _, b, c in sorted(held[x], key=lambda r: r[0])]
        model = fit([(b, c) for b, c, _ in data], [x for _, _, x in data], idf) if data else Model([], np.zeros((BUCKETS, 0)), np.zeros(0), idf)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = sampled(rows, sample).mapInArrow(grams, "lang string, order bigint, buckets array<int>, counts array<int>")
    # The sample is bounded in rows a language and in n-grams over all, so one task fits it; the driver gets the model alone.
    made = found.repartition(1).sortWithinPartitions("order", "lang").mapInArrow(learn, "model binary").collect()
    return pickle.loads(made[0].model) if made else Model([], np.zeros((BUCKETS, 0)), np.zeros(0), idf)


def _groups(texts: list[str | None], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default all), lang_pred and score; one row per row of `docs`.

    Null texts and texts without a letter get UNKNOWN and 0. Only the text is
    looked at. A column named lang_pred or score gives way to the new one.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def run(batches: Iterator[pa.RecordBatch], kept: int) -> Iterator[list]:
        model = shared.value
        for b in batches:
            texts = b.column(kept).to_pylist()
            langs, scores = [], [np.zeros(0)]
            for at, to in _groups(texts):
                x, s = model.predict(texts[at:to])
                langs += x
                scores.append(s)
            yield [*b.columns[:kept], pa.array(langs, pa.string()), pa.array(np.concatenate(scores))]

    return computed_beside(docs, text, keep, {"lang_pred": "string", "score": "double"}, run)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of all whole documents."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs), keep=["doc_id"])
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
