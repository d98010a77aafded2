"""Operator 1: which rare word it is depends on the word before it."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from invoicelines.llm import pitman_yor

SYMBOLS = {b"ka": 2, b"lo": 3}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    names = [a + b for a in ("mi", "ter", "on", "ba") for b in ("ka", "lo", "su", "ne", "ri")]
    return [" ".join(x for _ in range(30) for k in [rng.randrange(10)] for x in (rng.choice(["ka", "lo"]), names[k], names[k + 10])) for _ in range(40)]


def test_all_rare_pairs_are_counted(spark, texts):
    rows = [(i % 4 > 0, t) for i, t in enumerate([*texts, "", None, "zzz yy", "ka"])]
    docs = spark.createDataFrame(rows, "learn boolean, text string").repartition(5)
    got = {(r.r, r.w): r.n for r in pitman_yor.rare_pair_counts(docs, SYMBOLS).collect()}
    want = Counter()
    for learn, t in rows:
        ws = (t or "").encode().split()
        for last, w in zip([b"", *ws], ws, strict=False):
            if w not in SYMBOLS:
                want[tuple(pitman_yor.context_ids([last, w]).tolist())] += learn
    assert got == want
    assert spark.createDataFrame([("mika",)], "word string").select(pitman_yor.word_id("word")).first()[0] == pitman_yor.context_ids([b"mika"])[0]


def test_rare_words_of_a_context_sum_to_one(spark, texts):
    every = sorted({w for t in texts for w in t.split()} - {"ka", "lo"})
    asked = " ".join(f"{c} {w}" for c in ("mika", "ka", "never") for w in [*every, "zzz"])
    docs = spark.createDataFrame([*[(True, t) for t in texts], (False, asked)], "learn boolean, text string")
    model = pitman_yor.train(docs.repartition(3), 1, 1, 2, followers=True)
    pairs = {(r.r, r.w): r for r in model[1].pairs.collect()}
    assert all(r.known == (r.base_n > 0) for r in pairs.values())
    for c in ("mika", "ka", "never"):
        ids = pitman_yor.context_ids([c.encode(), *map(str.encode, every), b"zzz"]).tolist()
        assert sum(10 ** pairs[ids[0], w].total for w in ids[1:]) == pytest.approx(1, abs=1e-6)
        assert pairs[ids[0], ids[-1]].spelled < pairs[ids[0], ids[-1]].total
    again = pitman_yor.train(docs.repartition(16), 1, 1, 2, followers=True)
    assert {(r.r, r.w): r.total for r in again[1].pairs.collect()} == pytest.approx({k: r.total for k, r in pairs.items()})


def test_rare_words_are_predicted_by_the_one_before(spark, texts):
    """Each second name follows from the first, which the model without context for rare words can't know."""
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    now = {r.doc_id: r for r in pitman_yor.language_model_scores(rows, n_symbols=2, burn_in=0, samples=1).where("held_out").collect()}
    flat = {r.doc_id: r for r in pitman_yor.language_model_scores(rows, n_symbols=2, burn_in=0, samples=1, followers=False).where("held_out").collect()}
    names = sum(30 for _ in now)
    assert len(now) > 2 and sum(now[i].score - flat[i].score for i in now) > 0.7 * names
    assert all((now[i].n_tokens, now[i].n_known, now[i].base_score) == pytest.approx((flat[i].n_tokens, flat[i].n_known, flat[i].base_score)) for i in now)
