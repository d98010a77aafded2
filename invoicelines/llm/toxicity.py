"""Operator 5. Toxic spans by a linear-chain conditional random field.

Tokens are tagged 0 or 1. A token's emission is a sum of weights of its lower-case
form, its beginnings and its endings; a tag also depends on the one before. Only
documents are labelled, so the labelled tokens are derived: a token of a toxic
document is 1 if its form or one of its beginnings is much more common in the
toxic documents of the training sample than in the others, counted by different
neighbours, so that copies count once; all other tokens are 0.
The field is fitted to them by gradient ascent on the penalised likelihood, with
forward-backward marginals as expectations.

A document's score is a logistic function, fitted to the sample's labels, of what
its tokens' marginals add up to. Spans of tokens with marginals of a half or more
are the offending offsets.

Fitting takes a bounded sample of labelled rows (SAMPLE and SAMPLE_BYTES per label)
in one task; everything else streams over all rows, whole texts, without a shuffle.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import computed_beside, fold, ship, table

#: Most documents of each label that the field is fitted to.
SAMPLE = {1: 1000, 0: 2500}
#: Most bytes of the texts of each label; texts are taken in the order of their ids' hashes as long as they fit.
SAMPLE_BYTES = {1: 4 << 20, 0: 8 << 20}
CUT = 0.7
#: Longer words are told apart by a hash, and are not remembered.
LONG = 40
WORD = re.compile(r"\w+")
HEADS, TAILS = range(2, 9), range(2, 5)
#: Forward-backward runs over this many tokens at a time, whole documents.
CHUNK = 1 << 18


def features(word: str) -> list[str]:
    """What a token's emission is made of; ^ marks a beginning, $ an ending, = the whole form."""
    w = word.lower()
    whole = w if len(w) <= LONG else f"{w[:LONG]}#{xxhash.xxh64_hexdigest(w)}"
    return ["=" + whole, *["^" + w[:k] for k in HEADS if k <= len(w)], *["$" + w[-k:] for k in TAILS if k <= len(w)]]


@dataclass
class Model:
    """Weights of features, bias, transitions (from, to), start weight, and the logistic function's weights; constant: the score where nothing could be learned."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    moves: tuple = (0.0, 0.0, 0.0)
    document: tuple = ()
    constant: float = 0.0

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))


def _products(t: list[np.ndarray], backwards: bool) -> list[np.ndarray]:
    """Running products of the 2 x 2 matrices t (entries 00, 01, 10, 11; axes place, lane), in all lanes at once, scaled now and then."""
    out = [np.empty_like(x) for x in t]
    places = range(len(t[0]) - 1, -1, -1) if backwards else range(len(t[0]))
    m = [np.ones(t[0].shape[1]), np.zeros(t[0].shape[1]), np.zeros(t[0].shape[1]), np.ones(t[0].shape[1])]
    for k, i in enumerate(places):
        x, y = ([c[i] for c in t], m) if backwards else (m, [c[i] for c in t])
        m = [x[0] * y[0] + x[1] * y[2], x[0] * y[1] + x[1] * y[3], x[2] * y[0] + x[3] * y[2], x[2] * y[1] + x[3] * y[3]]
        if k % 12 == 11:
            top = np.maximum(np.maximum(m[0], m[1]), np.maximum(m[2], m[3]))
            m = [c / top for c in m]
        for o, c in zip(out, m, strict=True):
            o[i] = c
    return out


def marginals(emission: np.ndarray, first: np.ndarray, moves: tuple, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """P(tag 1) of each token by forward-backward, and the sums of P(tag before, tag).

    emission: weight of tag 1 over tag 0; first: whether a token begins a
    document, which is as if a tag 0 came before; moves: weights of the steps
    0-1, 1-0 and 1-1 over 0-0. The tokens are cut into lanes of equal length:
    products of step matrices run in all lanes at once and are then carried from
    lane to lane.
    """
    n, length = len(emission), 64
    lanes = max(1, -(-n // length))
    pad = lanes * length - n
    e = np.concatenate((emission, np.zeros(pad))).reshape(lanes, length).T
    f = np.concatenate((first, np.ones(pad, bool))).reshape(lanes, length).T
    step = np.exp(np.array([[0.0, moves[0]], [moves[1], moves[2]]]))
    top = np.maximum(e, 0.0)
    node = [np.exp(-top), np.exp(e - top)]
    # Into a token: from the tag before, or from a 0 where a document begins.
    into = [step[0, 0] * node[0], step[0, 1] * node[1], np.where(f, step[0, 0], step[1, 0]) * node[0], np.where(f, step[0, 1], step[1, 1]) * node[1]]
    # Out of a token: into the next one, or alike for both tags where the next begins a document.
    flat = [c.T.ravel() for c in into]
    cut = np.append(f.T.ravel()[1:], True)
    out = [np.where(cut, 1.0, np.append(c[1:], 1.0)).reshape(lanes, length).T for c in flat]
    ahead, behind = _products(into, False), _products(out, True)
    came, v = [], (1.0, 0.0)
    for a, b, c, d in zip(*[x[-1].tolist() for x in ahead], strict=True):
        came.append(v)
        v = (v[0] * a + v[1] * c, v[0] * b + v[1] * d)
        v = (v[0] / (v[0] + v[1]), v[1] / (v[0] + v[1]))
    came = np.array(came)
    alpha = [came[:, 0] * ahead[0] + came[:, 1] * ahead[2], came[:, 0] * ahead[1] + came[:, 1] * ahead[3]]
    came, v = [], (1.0, 1.0)
    for a, b, c, d in zip(*[x[0].tolist()[::-1] for x in behind], strict=True):
        came.append(v)
        v = (a * v[0] + b * v[1], c * v[0] + d * v[1])
        v = (v[0] / (v[0] + v[1]), v[1] / (v[0] + v[1]))
    came = np.array(came[::-1])
    beta = [behind[0] * came[:, 0] + behind[1] * came[:, 1], behind[2] * came[:, 0] + behind[3] * came[:, 1]]
    both = alpha[1] * beta[1]
    one = (both / (alpha[0] * beta[0] + both)).T.ravel()[:n]
    if not pairs:
        return one, None
    al, be, no = ([x.T.ravel()[:n] for x in y] for y in (alpha, beta, node))
    inside = ~first[1:]
    joint = np.array([[al[s][:-1][inside] * step[s, t] * (no[t] * be[t])[1:][inside] for t in (0, 1)] for s in (0, 1)])
    return one, (joint / joint.sum(axis=(0, 1))).sum(axis=2)


def document_numbers(one: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each document: log-odds that any token is toxic, log of 1 + their expected number, and of 1 + all tokens."""
    ends = np.cumsum(sizes)
    none = np.concatenate(([0.0], np.cumsum(np.log1p(-np.minimum(one, 1 - 1e-9)))))
    many = np.concatenate(([0.0], np.cumsum(one)))
    log_none = np.minimum(none[ends] - none[ends - sizes], -1e-7)
    expected = many[ends] - many[ends - sizes]
    odds = np.log(-np.expm1(log_none)) - log_none
    return np.stack((np.clip(odds, -12, 12), np.log1p(expected), np.log1p(sizes)), axis=1)


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    at, total = 0, 0
    for i, s in enumerate(sizes):
        total += s
        if total >= CHUNK:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def _marginals_by_chunk(emission: np.ndarray, sizes: np.ndarray, moves: tuple, pairs: bool = False):
    first = np.zeros(len(emission), bool)
    starts = np.cumsum(sizes) - sizes
    first[starts[sizes > 0]] = True
    one, steps = np.zeros(len(emission)), np.zeros((2, 2))
    for s, e in _chunks(sizes.tolist()):
        lo, hi = starts[s], starts[e - 1] + sizes[e - 1]
        if hi > lo:
            one[lo:hi], found = marginals(emission[lo:hi], first[lo:hi], moves, pairs)
            steps += found if pairs else 0.0
    return one, first, steps


def _ascend(theta: np.ndarray, gradient, rounds: int, rate: float) -> np.ndarray:
    """Adam on a penalised likelihood."""
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        g = gradient(theta)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return theta


def fit(texts: list[str], labels: np.ndarray, share: float, rounds: int = 40) -> Model:
    """texts and labels (0 or 1) of the sample; share: of label 1 among all labelled rows."""
    labels = np.asarray(labels)
    if not len(labels) or labels.all() or not labels.any():
        return Model(constant=float(share))
    number: dict[str, int] = {}
    words = [[number.setdefault(w.lower(), len(number)) for w in WORD.findall(t or "")] for t in texts]
    sizes = np.array([len(w) for w in words])
    tokens = np.fromiter(chain.from_iterable(words), np.int32, sizes.sum())
    del words
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    # A word counts once for each pair of neighbours, so that copies of a document count as one.
    inner = np.concatenate(([0], tokens, [0])).astype(np.int64)
    around = (inner[:-2] * 1_000_003 + inner[2:]) * 1_000_003 + tokens
    _, once = np.unique(around * 2 + labels[owner], return_index=True)
    # Features by their hashes; only the names of those that get a weight are made again.
    sizes_of = np.fromiter((1 + min(len(HEADS), max(0, len(w) - 1)) + min(len(TAILS), max(0, len(w) - 1)) for w in number), np.int64, len(number))
    of_word = np.repeat(np.arange(len(number)), sizes_of)
    hashes = np.fromiter((xxhash.xxh64_intdigest(f) for w in number for f in features(w)), np.uint64, len(of_word))
    tails = np.fromiter((f[0] == "$" for w in number for f in features(w)), bool, len(of_word))
    names, some, of_feature = np.unique(hashes, return_index=True, return_inverse=True)
    del hashes
    by_word = [np.bincount(tokens[once[labels[owner[once]] == c]], minlength=len(number)) for c in (0, 1)]
    by_feature = [np.bincount(of_feature, by_word[c][of_word], len(names)) for c in (0, 1)]
    n = [max(1, int((labels == c).sum())) for c in (0, 1)]
    total = [max(1, int(by_word[c].sum())) for c in (0, 1)]
    more = np.log((by_feature[1] + 0.5) / total[1]) - np.log((by_feature[0] + 1.0) / total[0])
    # Rare enough for chance: so many of a feature's occurrences in toxic documents alone.
    least = max(3.0, np.log(1e5) / np.log(sum(total) / total[1]))
    label_names = ~tails[some]
    strong = (by_feature[1] >= least) & (more > np.log(12)) & label_names
    cue = np.bincount(of_word, strong[of_feature], len(number)) > 0
    tags = cue[tokens] & (labels[owner] == 1)
    # Features of a few documents only have no weight.
    used = np.flatnonzero(by_feature[0] + by_feature[1] >= 3)
    place = np.full(len(names), -1)
    place[used] = np.arange(len(used))
    keep = place[of_feature] >= 0
    word_of = of_word
    of_word, of_feature = of_word[keep], place[of_feature[keep]]
    first = np.zeros(len(tokens), bool)
    starts = np.cumsum(sizes) - sizes
    first[starts[sizes > 0]] = True
    inside = ~first[1:]
    seen_steps = np.zeros((2, 2))
    np.add.at(seen_steps, (tags[:-1][inside].astype(int), tags[1:][inside].astype(int)), 1)
    begun = float(tags[first].sum())
    k, scale = len(used), 1.0 / max(1, int(tags.sum()))

    def gradient(theta: np.ndarray) -> np.ndarray:
        by = theta[k] + np.bincount(of_word, theta[of_feature], len(number))
        one, _, steps = _marginals_by_chunk(by[tokens], sizes, tuple(theta[k + 1 :]), True)
        off = np.bincount(tokens, tags - one, len(number))
        g = np.empty_like(theta)
        g[:k] = np.bincount(of_feature, off[of_word], k) - 0.05 * theta[:k]
        g[k] = off.sum()
        g[k + 1] = seen_steps[0, 1] - steps[0, 1] + begun - one[first].sum()  # a document begins as after a 0
        g[k + 2], g[k + 3] = seen_steps[1, 0] - steps[1, 0], seen_steps[1, 1] - steps[1, 1]
        g[k + 1 :] -= 1.0 * theta[k + 1 :]
        return g * scale

    theta = np.zeros(k + 4)
    theta[k] = -4.0
    theta = _ascend(theta, gradient, rounds, 0.25)
    by = theta[k] + np.bincount(of_word, theta[of_feature], len(number))
    one, _, _ = _marginals_by_chunk(by[tokens], sizes, tuple(theta[k + 1 :]))
    x = document_numbers(one, sizes)
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    weight = np.where(labels == 1, share / n[1], (1 - share) / n[0]) * len(labels)

    def slope(w: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-x @ w))
        return (x * (weight * (labels - p))[:, None]).mean(axis=0) - 1e-4 * w

    w = _ascend(np.zeros(4), slope, 1500, 0.05)
    every, first_of = list(number), np.cumsum(sizes_of) - sizes_of
    weights = {}
    for f, t in zip(used.tolist(), theta[:k].tolist(), strict=True):
        if abs(t) > 0.02:
            of = int(word_of[some[f]])
            weights[features(every[of])[int(some[f] - first_of[of])]] = float(t)
    return Model(weights, float(theta[k]), tuple(theta[k + 1 :].tolist()), tuple(w.tolist()))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, held_out: int = 1, sample: dict[int, int] | None = None) -> Model:
    """Learns from rows whose id's crc32 modulo `folds` is not `held_out`.

    The sample: of each label the `sample` ids with the least hashes, and of their
    texts, in that order, those that fit into SAMPLE_BYTES, none longer than a
    sixteenth of that. Labels of null ids and
    null labels are left out; an id with several labels has the greatest, one with
    several texts the text of the least hash. Without both labels the model is a
    constant.
    """
    ship(docs.sparkSession)
    marks = labels.select(F.col(f"`{id_col}`").alias("m_id"), F.col(f"`{label}`").cast("int").alias("mark")).where("m_id IS NOT NULL AND mark IN (0, 1)").where(fold(F.col("m_id"), folds) != held_out)
    marks = marks.groupBy("m_id").agg(F.max("mark").alias("mark"))
    counts = dict(marks.groupBy("mark").count().collect())
    order = F.xxhash64("m_id")
    chosen = None
    for c, most in (sample or SAMPLE).items():
        part = marks.where(F.col("mark") == c).orderBy(order, "m_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body")).join(F.broadcast(chosen), F.col("id") == F.col("m_id")).select("m_id", "body", "mark", F.xxhash64("body").alias("tie"))
    rows = rows.groupBy("m_id").agg(F.min_by("body", "tie").alias("body"), F.first("mark").alias("mark"))  # one row per chosen id
    so_far = F.sum(F.octet_length("body")).over(Window.partitionBy("mark").orderBy(order, "m_id"))  # at most `sample` rows each
    most = F.element_at(F.create_map(*[F.lit(x) for pair in SAMPLE_BYTES.items() for x in pair]), F.col("mark"))
    found = rows.where(F.octet_length("body") <= most / 16).withColumn("so_far", so_far).where(F.col("so_far") <= most).select("m_id", "body", "mark")
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = sorted(chain.from_iterable(zip(*b.to_pydict().values(), strict=True) for b in batches))
        model = fit([t for _, t, _ in texts], np.array([m for _, _, m in texts], int), share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # The sample is bounded, so one task fits it; the driver gets the model alone.
    rows = found.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(rows[0][0]) if rows else Model(constant=share)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, spans: bool = True, cut: float = CUT) -> DataFrame:
    """The columns `keep` (default all), score, predicted and, if asked for, spans: (start, end, marginal) character offsets of runs of toxic tokens.

    Null and empty texts have no tokens and get the score of such a text. A column
    of `docs` that is named score, predicted or spans gives way to the new one.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch], kept: int) -> Iterator[list]:
        model = shared.value

        class Emissions(dict):
            def __missing__(self, word: str) -> float:
                out = model.emission(word)
                if len(word) <= LONG:
                    if len(self) > 200_000:
                        self.clear()
                    self[word] = out
                return out

        known = Emissions()
        for b in batches:
            texts = b.column(kept).to_pylist()
            scores, found = np.full(len(texts), model.constant), [[] for _ in texts]
            if model.document:
                for s, e in _chunks([len(t or "") // 6 for t in texts]):
                    words = [WORD.findall(t) if t else [] for t in texts[s:e]]
                    sizes = np.array([len(w) for w in words])
                    emission = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.float64, sizes.sum())
                    del words
                    one, _, _ = _marginals_by_chunk(emission, sizes, model.moves)
                    x = document_numbers(one, sizes)
                    scores[s:e] = 1 / (1 + np.exp(-(x @ np.array(model.document[:3]) + model.document[3])))
                    if spans:
                        ends = np.cumsum(sizes)
                        for d in np.unique(np.searchsorted(ends, np.flatnonzero(one >= 0.5), side="right")).tolist():
                            p = one[ends[d] - sizes[d] : ends[d]]
                            for m, q in zip(WORD.finditer(texts[s + d]), p.tolist(), strict=True):
                                if q >= 0.5:
                                    last = found[s + d][-1] if found[s + d] else None
                                    if last and not texts[s + d][last["end"] : m.start()].strip():
                                        last["end"], last["marginal"] = m.end(), max(last["marginal"], q)
                                    else:
                                        found[s + d].append({"start": m.start(), "end": m.end(), "marginal": q})
            columns = [*b.columns[:kept], pa.array(scores), pa.array((scores >= cut).astype(np.int32))]
            if spans:
                columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))))
            yield columns

    new = {"score": "double", "predicted": "int"} | ({"spans": "array<struct<start: int, end: int, marginal: double>>"} if spans else {})
    return computed_beside(docs, text, keep, new, run)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """`docs` without the rows that the field predicts to be toxic; columns as in `docs`, whatever their names."""
    model = train(docs, labels, id_col, text, **kw)
    names = [f"c{i}" for i in range(len(docs.columns))]  # none can clash with the score's
    scored = score(docs.toDF(*names), model, names[docs.columns.index(text)], names, spans=False)
    return scored.where("predicted = 0").select(*names).toDF(*docs.columns)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores and offending offsets of all whole documents."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model, keep=["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", "spans")
