"""Importance resampling, byte-level BPE and the filter audit against plain versions."""

import base64
import hashlib
import math
import os
import random
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from invoicelines.llm import audit, bpe, importance
from invoicelines.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import SMALL


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return c


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_filter_audit"])
def test_queries_equal_their_sql(spark, tables, name):
    got = QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = tables.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    rows = sorted(repr([r[c] for c in columns]) for r in got.collect())
    assert sorted(names) == columns and rows == sorted(repr([r[names.index(c)] for c in columns]) for r in want.fetchall())


# Operator 11


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def grams(text, n):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def resampled(rows, target, n, buckets, seed="2024", min_words=20, percent=10):
    count = lambda texts: np.bincount([zlib.crc32(g.encode()) % buckets for t in texts for g in grams(t, n)], minlength=buckets)
    s, t = count([x for _, x in rows]), count(target)
    gain = [math.floor(1000.0 * math.log((float(t[b]) + 1) * (float(s.sum()) + buckets) / ((float(s[b]) + 1) * (float(t.sum()) + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        g = grams(x, n)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words_of(x)), len(g), weight, weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0))), None])
    drawn = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0]))
    for place, r in enumerate(drawn[: percent * len(drawn) // 100], 1):
        r[5] = place
    return sorted(map(repr, out))


@pytest.mark.parametrize(("n", "buckets", "percent"), [(1, 997, 10), (3, 70_001, 40)])
def test_resampling_by_hand(spark, n, buckets, percent):
    rng = random.Random(n)
    pool = ["a", "Bb", "ccc", "ü", "日本", "x" * 70, "0", "Z9"] + [f"w{i}" for i in range(300)]
    rows = [(i, rng.choice(["", " ", "\t-"]) + rng.choice([" ", ", ", "\n--"]).join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 30_000), (1003, "y" * 200_000), (1004, "\x01 \x02 a\x01b " * 10), (1005, rows[0][1])]
    target = ["a ccc w1 w2 w3", None, "日本 a Bb", ""]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("weight", F.lit("x")).withColumn("lang", F.lit("en")).repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.importance_resample(docs, aim, n=n, buckets=buckets, percent=percent, keep=["lang", "weight"])
    assert got.columns == ["doc_id", "lang", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(repr(list(r)) for r in got.drop("lang").collect()) == resampled(rows, target, n, buckets, percent=percent)


def test_resampling_of_odd_tables(spark):
    aim = spark.createDataFrame([], "text string")
    none = importance.importance_resample(spark.createDataFrame([], "doc_id bigint, text string"), aim)
    assert none.count() == 0
    rows = [(None, "a " * 25), (None, "a " * 25), (7, "b " * 25), (7, "b " * 25)]
    got = importance.importance_resample(spark.createDataFrame(rows, "doc_id bigint, text string"), aim, percent=100).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4] and len({r.score for r in got}) == 2
    with pytest.raises(ValueError):
        importance.importance_resample(spark.createDataFrame(rows, "doc_id bigint, text string"), aim, buckets=0)


def test_composed_checksums():
    rng = random.Random(2)
    pairs = [(rng.randbytes(rng.randint(0, 40)), rng.randbytes(rng.randint(0, 300))) for _ in range(500)] + [(b"a", b""), (b"", b"b"), (b"x", b"y" * 100_000)]
    crc = lambda x: np.array([zlib.crc32(v) for v in x], np.int64)
    found = importance.composed(crc(a for a, _ in pairs), crc(b for _, b in pairs), np.array([len(b) for _, b in pairs]))
    assert found.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_automaton_gives_every_word_in_order():
    texts = ["A b a", "", "b" * 300 + " b " + "b" * 65, "é\x01A", "  "]
    counts, crc, lengths = importance.scan([t.encode() for t in texts])
    words = [[w.encode() for w in words_of(t)] for t in texts]
    assert counts.tolist() == list(map(len, words))
    flat = [w for ws in words for w in ws]
    assert crc.tolist() == [zlib.crc32(w) for w in flat] and lengths.tolist() == list(map(len, flat))
    assert importance.scan([])[0].tolist() == [] and importance.scan([b""])[0].tolist() == [0]


# Operator 12


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(5)
    points = [c for c in range(0x20000) if not 0xD800 <= c <= 0xDFFF]
    pool = [chr(rng.choice(points)) for _ in range(800)] + list(" \n\t\r 　'sdtrevml123aBcé  ") * 16
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["", " ", None, "a" * 30_000, "x  y\n\n z ", "don't I'll 'sx ''re", "the cat " * 3000, "ACGT" * 400 + "GATTACA", "é" * 700, "࢏ a࢏ 1౜", "<|endoftext|>"]
    texts += ["".join(rng.choice("ACGT") for _ in range(1500)), "".join(rng.choice("abcdeéα") for _ in range(700)), "aab" * 500]
    return texts


def test_bpe_is_the_library_s(spark, library):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "id int, text string, IDS string").repartition(3)
    encoded = bpe.bpe_encode(docs)
    assert encoded.columns == ["id", "text", "ids"]
    for r in encoded.collect():
        assert r.ids == library.encode_ordinary(texts[r.id] or "")
    back = bpe.bpe_decode(encoded.withColumn("decoded", F.lit(1)), keep=["id", "decoded"])
    assert back.columns == ["id", "decoded"] and all(bytes(r.decoded) == (texts[r.id] or "").encode() for r in back.collect())
    for r in bpe.bpe_digests(docs, keep=["id"]).collect():
        ids = library.encode_ordinary(texts[r.id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.id] or "").encode()).hexdigest()


def test_bpe_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op12_byte_bpe"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_bpe_of_odd_rows(spark):
    none = spark.createDataFrame([], "id int, text string")
    assert bpe.bpe_encode(none).count() == bpe.bpe_digests(none).count() == 0
    ids = spark.createDataFrame([(1, None), (2, []), (3, [72, 10**6, 105]), (4, [72])], "id int, ids array<int>")
    got = {r.id: bytes(r.decoded) for r in bpe.bpe_decode(ids).collect()}
    assert got[1] == got[2] == b"" and len(got[3]) == 2 and got[3][:1] == got[4]


def test_parts_of_long_texts(library, monkeypatch):
    c = bpe.Codec(public_tokenizers.path(bpe.VOCABULARY), bpe.pattern(), 1 << 20)
    monkeypatch.setattr(bpe, "WHOLE_PART", 50)
    monkeypatch.setattr(bpe, "DECODED_IDS", 37)
    texts = ["one  two three's " * 40 + "\n\n x" * 30, "", "abc " * 200, "é日 " * 99]
    ids = c.encode(pa.array(texts))
    assert [x.tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
    assert [c.whole(t).tolist() for t in texts] == [x.tolist() for x in ids] and c.decode(ids) == [t.encode() for t in texts]


def test_what_is_forgotten_changes_nothing(library):
    c = bpe.Codec(public_tokenizers.path(bpe.VOCABULARY), bpe.pattern(), 1)
    texts = [t for t in odd_texts() if t][:80]
    for k in range(0, 80, 8):  # forgets before each batch
        for t, ids in zip(texts[k : k + 8], c.encode(pa.array(texts[k : k + 8])), strict=True):
            assert ids.tolist() == library.encode_ordinary(t)


def test_long_words_like_short_ones():
    c = bpe.Codec(public_tokenizers.path(bpe.VOCABULARY), bpe.pattern(), 1 << 20)
    rng = random.Random(4)
    words = ["".join(rng.choice(abc) for _ in range(rng.randint(1, 90))) for abc in ("ab", "ACGT", "aeiouy", "αβγ") for _ in range(60)]
    words = list(dict.fromkeys(words))
    starts, lengths, ids = c.contract(words)
    limit, bpe.LONG = bpe.LONG, 0
    try:
        other = c.contract(words)
    finally:
        bpe.LONG = limit
    for i in range(len(words)):
        assert ids[starts[i] : starts[i] + lengths[i]].tolist() == other[2][other[0][i] : other[0][i] + other[1][i]].tolist()


# Operator 13


def test_galloping_unions():
    rng = random.Random(6)
    for _ in range(400):
        lists = [sorted(rng.sample(range(rng.choice([5, 50, 1000])), rng.randint(0, 5))) for _ in range(rng.randint(0, 5))]
        assert audit.union_size(lists) == len(set().union(*lists))
    long = [list(range(0, 30_000, 3)), list(range(50_000)), list(range(49_000, 60_000)), []]
    assert audit.union_size(long) == 60_000
    ids = sorted(rng.sample(range(1000), 200))
    for start in range(0, 200, 7):
        for bound in range(ids[start], 1003, 13):
            assert audit.gallop(ids, start, bound) == max(start, next((i for i, x in enumerate(ids) if x >= bound), 200))


def audited(rows, labels):
    first, facts = {}, []
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    for i, text, part in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and first[text] < i}
        facts.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shares = [], {}
    for part in {f[0] for f in facts}:
        mine = [f for f in facts if f[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                fail = [x for x in mine if f in x[1]]
                out.append([part, "".join(order), k + 1, len(left), len(gone), len(fail) - len(gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)])
                shares[part, f] = shares.get((part, f), 0) + len(gone)
    return sorted(repr([*r, shares[r[0], r[1][r[2] - 1]]]) for r in out)


def test_audit_by_hand(spark):
    rng = random.Random(8)
    rows = []
    for i in range(260):
        text = " ".join(rng.choice(["a", "B", "CC", "x#", f"w{rng.randint(0, 400)}", f"v{rng.randint(0, 400)}", f"u{i}"]) for _ in range(rng.choice([0, 5, 99, 100, 140])))
        rows.append((i * 3, rng.choice([text, text, rows[rng.randrange(len(rows))][1] if rows else text, None, ""]), rng.choice(["en", "en", "fr", None, ""])))
    rows += [(None, rows[5][1], "en"), (None, None, None), (30, rows[10][1], "en"), (30, rows[10][1], "en"), (9000, "word " * 40_000, "long"), (9001, "Z" * 100_000, "long")]
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for r in rows[::2]] + [(0, 1, 1), (123456, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("part", F.lit("x")).withColumn("fails", F.lit(1)).repartition(7)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = audit.filter_audit(docs, marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(repr(list(r)) for r in got.collect()) == audited(rows, labels)


def test_audit_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit.filter_audit(none, marks).count() == 0
    one = spark.createDataFrame([(None, None, None)], "doc_id bigint, text string, lang string")
    got = audit.filter_audit(one, marks).collect()
    assert len(got) == 600 and {(r.part, r.shapley) for r in got if r.filter_order[r.step - 1] == "A"} == {("", 120)}


def test_ranges_of_a_part_add_up(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id"), F.lit("p").alias("part"), (F.col("id") % 32).cast("int").alias("fails"), F.col("id").alias("row"))
    marks = spark.range(0, 3000, 5).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    got = {(r.kind, r.set): r["size"] for r in audit.union_sizes(rows, marks).collect()}
    for s in range(32):
        assert got["all", s] == sum(1 for i in range(3000) if i % 32 & s) and got["good", s] == sum(1 for i in range(0, 3000, 5) if i % 32 & s) and got["toxic", s] == 0
    assert got["rows", 0] == 3000
