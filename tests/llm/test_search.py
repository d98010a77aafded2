"""Operators 2, 7, 9, 10: native and pair operators against brute force, and odd inputs."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from invoicelines.llm import decontaminate, lattice, mixing, simhash
from invoicelines.llm.common import components

DOCS = "doc_id bigint, text string, source string, size string, row string, id string, fp string, word string"


def docs_of(spark, texts, sources=None):
    return spark.createDataFrame([(None if t == "no id" else i, t, (sources or ["s"] * len(texts))[i], "a", "b", "c", "d", "e") for i, t in enumerate(texts)], DOCS)


def random_words(rng, n, vocabulary=40):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {x: find(x) for e in edges for x in e if x != find(x)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def fingerprint_by_hand(text, n=3):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(values, bits=3):
    fp, ids = np.array(values, np.uint64), np.arange(len(values))
    near, label = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= bits, ids.copy()
    while True:
        new = np.where(near, label[None, :], 10**9).min(axis=1)
        if (new == label).all():
            return label.tolist()
        label = new


def test_simhash_groups(spark):
    rng = random.Random(3)
    base = random_words(rng, 400, 1000)
    texts = [None, "", "  \t\n", "One", "one", "ÉCOLE a b", "x " * 30_000, *(" ".join(base) for _ in range(5))]
    for _ in range(60):
        w = base.copy()
        w[rng.randrange(400)] = "changed"
        texts.append(" ".join(w))
    texts += [" ".join(random_words(rng, 50, 500)) for _ in range(60)]
    got = {r.doc_id: r for r in simhash.simhash_groups(docs_of(spark, texts)).collect()}
    by_hand = [fingerprint_by_hand(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in by_hand]
    assert [got[i].component_id for i in range(len(texts))] == brute_components(by_hand)
    assert simhash.simhash_groups(docs_of(spark, texts).limit(0)).count() == 0
    again = docs_of(spark, ["a b c d"]).union(docs_of(spark, ["a b c d"])).union(docs_of(spark, ["x", "no id"]).where("doc_id IS NULL"))
    assert sorted(map(str, (r.component_id for r in simhash.simhash_groups(again).collect()))) == ["0", "0", "None"]


@pytest.mark.parametrize("block", [1, 3, 2048])
def test_links_at_every_level(spark, block):
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values)[:60]:
        for _ in range(4):
            x = v
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            values.add(x)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), block=block)
    found = {r.node: r.component for r in components(edges).collect()}
    groups = {}
    for i, v in enumerate(signed):
        groups.setdefault(found.get(v, v), set()).add(i)
    expected = {}
    for i, c in enumerate(brute_components(values)):
        expected.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_near_dedup(spark):
    rng = random.Random(5)
    base = random_words(rng, 500, 5000)
    near = [" ".join(base)]
    for _ in range(20):
        w = base.copy()
        for _ in range(5):
            w[rng.randrange(500)] = "new"
        near.append(" ".join(w))
    far = [" ".join(base[:200] + random_words(rng, 300, 5000)), *(" ".join(random_words(rng, 80, 5000)) for _ in range(20))]
    docs = docs_of(spark, [*near, *far, None, "", "no id"])
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    ids = sorted((-1 if r.doc_id is None else r.doc_id) for r in kept.collect())
    assert ids == [-1, 0, *range(len(near), len(near) + len(far) + 1)]
    assert simhash.near_dedup(docs.union(docs.where("doc_id = 25"))).where("doc_id = 25").count() == 1
    twice = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "g h i j k l", "x"), (1, "g h i j k l", "x"), (None, "a b c d e f", "x"), (None, "m n o p q r", "x")], "doc_id bigint, text string, _row_no string")
    assert sorted((str(r.doc_id), r.text[0]) for r in simhash.near_dedup(twice).collect()) == [("1", "a"), ("1", "g"), ("None", "m")]
    assert simhash.near_dedup(docs.limit(0)).count() == 0


def words_by_hand(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(1, " ".join(random_words(rng, 25))), (2, "Short ITEM, here"), (3, ""), (4, None), (10, " ".join(random_words(rng, 12))), (2, "other text of two"), (None, "w1 w2"), (11, "é È ß one")]
    texts = [None, "", "!!!", "a short item here b", "É é È ß one", items[0][1].upper() + "!", "x " * 20_000 + items[4][1], *(" ".join(random_words(rng, 300, 6)) for _ in range(5)), items[0][1][:25], "no id"]
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")
    expected = []
    for t in texts:
        w, hit, found = words_by_hand(t), set(), set()
        for item, body in items:
            b = words_by_hand(body)
            if not b:
                continue
            n = min(10, len(b))
            windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= {str(item)} - {"None"}
        expected.append((len(w), len(hit), sorted(found)))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in (0, 10**6):  # joined by a shuffle, and broadcast
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1" if not limit else threshold)
        got = decontaminate.contamination(docs, bench, broadcast_windows=limit).collect()
        rows = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got}
        assert len(got) == len(texts)
        assert [rows[None if t == "no id" else i] for i, t in enumerate(texts)] == expected
        clean = decontaminate.remove_documents(docs, bench, broadcast_windows=limit, broadcast_texts=limit)
        assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {None if t == "no id" else i for i, t in enumerate(texts) if not expected[i][1]}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert any(e[1] for e in expected)
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs.where("doc_id IS NOT NULL"), bench).collect()}
    mixed = spark.createDataFrame([(None, "a short item here", 1), (None, "clean", 2), (7, "clean too", 3), (7, "short item here", 4), (7, None, 5)], "doc_id bigint, text string, body int")
    assert sorted(r.body for r in decontaminate.remove_documents(mixed, bench).collect()) == [2, 3, 5]
    assert sorted((r.body, r.text) for r in decontaminate.remove_spans(mixed, bench).collect() if r.text is not None) == [(1, "a "), (2, "clean"), (3, "clean too"), (4, "")]
    assert cut[3] == "a b" and cut[5] == "" and cut[0] is None and cut[12] == texts[12]
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0 and decontaminate.contamination(docs.limit(0), bench).count() == 0
    op = decontaminate.contamination(docs, bench).where("doc_id = 3").select(F.sha2(F.array_join("items", ","), 256)).first()[0]
    assert op == hashlib.sha256(b"2").hexdigest()


def test_mixing(spark):
    rng = random.Random(7)
    sizes, sources = [], []
    for s, n in (("a", 400), ("b", 60), ("é", 3), (None, 30), ("Z", 1)):
        for _ in range(n):
            sizes.append(rng.randint(0, 60))
            sources.append(s)
    docs = docs_of(spark, [" ".join(["w"] * n) if n else None for n in sizes], sources)
    rows = mixing.mix_plan(docs).select("doc.doc_id", "source", "size", "source_size", "target", "copies").collect()
    assert len(rows) == len(sizes) and all(r.size == sizes[r.doc_id] for r in rows)
    total, names = sum(sizes), ["Z", "a", "b", "é", None]
    own = {s: sum(n for n, x in zip(sizes, sources, strict=True) if x == s) for s in names}
    weight, target, left, free = dict(zip(names, (5, 2, 1, 5, 2), strict=True)), {}, float(total), set(names)
    while True:  # share, cap, share the excess again
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * own[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * own[s]
            left -= target[s]
        free -= over
    for s in names:
        mine = [r for r in rows if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == own[s] for r in mine)
        assert abs(sum(r.copies * r.size for r in mine) - target[s]) <= 61
    assert all(0 <= r.copies <= 3 for r in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in rows for _ in range(r.copies))
    assert mixing.mix(docs.limit(0)).count() == 0
    empty = mixing.mix_plan(docs_of(spark, [None, "", " "])).collect()
    assert [(r.target, r.copies) for r in empty] == [(0.0, 0)] * 3
    twice = mixing.mix_plan(docs.union(docs))
    assert twice.count() == 2 * len(sizes)


def test_lattice_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=(150, 64))
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    share = np.repeat([0.931, 0.95, 0.99, 0.929, 0.6], 30)
    y = share[:, None] * x + np.sqrt(1 - share**2)[:, None] * z
    rows = [(i, v.tolist(), 1, "k") for i, v in enumerate(np.concatenate((x, y)))]
    odd = [(900, None, 1, "k"), (901, [0.0] * 64, 1, "k"), (902, [float("nan")] * 64, 1, "k"), (903, [None] + [1.0] * 63, 1, "k"), (904, rows[0][1], None, "k"), (905, rows[0][1], 2, "k"), (906, [], 1, "k"), (907, [float("inf")] * 64, 1, "k"), (908, rows[0][1][:8], 1, "k"), (None, rows[0][1], 1, "k")]
    copies = [(910, rows[5][1], 1, "k"), (911, rows[5][1], 1, "k"), (911, rows[5][1], 1, "k")]
    frame = spark.createDataFrame(rows + odd + copies, "vec_id bigint, embedding array<double>, label int, key string")
    got = lattice.near_duplicates(frame).collect()
    assert len(got) == len(rows) + len(odd) + len(copies)
    by = {r.vec_id: r for r in got}
    linked = [by[150 + i].component_id == i for i in range(150)]
    assert np.mean(linked[:90]) >= 0.95 and not any(linked[90:])
    assert all(by[o[0]].n_links == 0 and by[o[0]].component_id == o[0] for o in odd)
    assert by[911].component_id == 5 and by[911].n_links == 4 == by[5].n_links and not by[910].kept
    assert lattice.near_duplicates(frame.limit(0)).count() == 0


def test_lattice_of_huge_and_tiny_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=64)
    y = x + 0.01 * rng.normal(size=64)
    rows = [(i, (v * scale).tolist(), k) for k, scale in enumerate((1.0, 1e160, 1e300, 1e-170, 1e-290)) for i, v in ((2 * k, x), (2 * k + 1, y))]
    rows += [(20, (x * 1e160).tolist(), 9), (21, (-x * 1e-170).tolist(), 9), (22, (y * 1e-170).tolist(), 9)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert all(got[i] == (1, i // 2 * 2) for i in range(10)) and got[21] == (0, 21) and got[20] == got[22] == (1, 20)


@pytest.mark.parametrize("block", [100, 1024])
def test_links_against_all_pairs(spark, monkeypatch, block):
    """A large group of near vectors, chains, pairs and strangers: links and components of 1,300 vectors by brute force."""
    monkeypatch.setattr(lattice, "BLOCK", block)
    rng = np.random.default_rng(10)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    centre = unit(rng.normal(size=(1, 64)))
    group = unit(centre + 0.3 * unit(rng.normal(size=(400, 64))))
    some = unit(rng.normal(size=(200, 64)))
    near = unit(some + 0.25 * unit(rng.normal(size=(200, 64))))
    chain = [centre[0]]
    for _ in range(100):
        chain.append(unit(chain[-1][None] + 0.33 * unit(rng.normal(size=(1, 64))))[0])
    x = np.concatenate((group, some, near, np.array(chain), unit(rng.normal(size=(399, 64)))))
    label = rng.integers(0, 2, len(x)) * (np.arange(len(x)) > 350)
    cos = unit(x) @ unit(x).T
    links = (cos >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    least = np.arange(len(x))
    while True:
        new = np.minimum(least, np.where(links, least[None, :], len(x)).min(axis=1))
        if (new == least).all():
            break
        least = new
    assert links.sum() > 10_000 and len(np.unique(least)) < 1000
    frame = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r for r in lattice.near_duplicates(frame).collect()}
    assert np.mean([got[i].component_id == least[i] for i in range(len(x))]) > 0.98
    assert sum(got[i].n_links for i in range(len(x))) >= 0.99 * links.sum() and all(got[i].n_links <= links[i].sum() for i in range(len(x)))


def test_e8_points():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 8)) * 2
    points, steps = lattice.nearest(x), lattice.neighbours()
    assert len(np.unique(steps, axis=0)) == 240 and np.allclose((steps**2).sum(axis=1), 2)
    twice = 2 * points
    assert np.allclose(twice, np.rint(twice)) and (np.abs(twice % 2 - (twice % 2)[:, :1]) < 1e-9).all() and np.allclose(points.sum(axis=1) % 2, 0)
    own = ((x - points) ** 2).sum(axis=1)
    assert (own[:, None] <= ((x[:, None] - points[:, None] - steps[None]) ** 2).sum(axis=2) + 1e-9).all()


def kept_by_hand(texts, similarity=0.8, shingle=5):
    sets = [set(zip(*[t.split()[k:] for k in range(shingle)], strict=False)) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                least, most = sorted((group[i], group[j]))
                group = [least if g == most else g for g in group]
    return sorted(set(group))


@pytest.mark.parametrize("block", [4, 2048])
def test_near_dedup_by_true_similarity(spark, block):
    """Pairs of similarity 0.80 to 0.84 go, those of 0.75 to 0.79 stay, also where one line is repeated; lists of all lengths."""
    rng = random.Random(6)
    texts = []
    for change in [20, 21, 22, 24, 26, 28] * 12:  # words replaced at the end of 200 (shingles: 196)
        base = random_words(rng, 200, 10**6)
        texts += [" ".join(base), " ".join(base[:-change] + random_words(rng, change, 10**6))]
    line = "this one line comes again and again "
    texts += [line * 60 + " ".join(random_words(rng, 100, 10**6)) for _ in range(3)]
    many = random_words(rng, 300, 10**6)
    for _ in range(90):
        w = many.copy()
        w[rng.randrange(300)] = "changed"
        texts.append(" ".join(w))
    by_hand = kept_by_hand(texts)
    assert len(by_hand) not in (72 + 4, 144 + 4)
    kept = sorted(r.doc_id for r in simhash.near_dedup(docs_of(spark, texts), block=block).collect())
    missed, false = set(kept) - set(by_hand), set(by_hand) - set(kept)
    assert not false and len(missed) <= 1


def test_rows_of_a_near_group_are_linear(spark):
    """A group of near copies proposes at most one pair for each posting, and no pair of one component is looked at again."""
    rng = random.Random(7)
    base, n = random_words(rng, 300, 10**6), 700
    texts = []
    for _ in range(n):
        w = base.copy()
        w[rng.randrange(300)] = "changed"
        texts.append(" ".join(w))
    names = [f"f{k}" for k in range(simhash.WORDS)]
    sets = [simhash.shingle_set(t.encode(), 5) for t in texts]
    rows = {simhash._number(x): (simhash._number(x), len(x), *[simhash._signed(v) for v in simhash._bits(iter((x,)), simhash.WORDS)]) for x in sets}
    nodes = spark.createDataFrame(list(rows.values()), ", ".join(f"{c} bigint" for c in ["fp", "n", *names]))
    several = simhash._several(simhash._keyed(nodes, names), 64).cache()
    postings = several.count()
    assert postings <= simhash.KEYS * len(rows) and {r.long for r in several.select("long").distinct().collect()} == {True, False}
    found = simhash._proposed(several.select("key", "fp").join(nodes, "fp").select("key", "fp", "n", *names), ["key"], simhash.allowed_bits(0.8, simhash.WORDS), 0.8)
    assert 0 < found.count() <= postings
    one = nodes.select(F.lit(1).alias("key"), "fp", F.lit(min(rows)).alias("label"), "n", *names)
    assert simhash._near_others(one, names, 110, 64, 0.8).count() == 0


def test_near_but_not_similar_texts_are_no_pairs_of_rows(spark):
    """Texts of a pairwise similarity of 0.6 to 0.8 are near by their bits; what is dealt follows them and their blocks, and nothing links."""
    rng, base = random.Random(17), random_words(random.Random(16), 300, 10**6)
    names, made = [f"f{k}" for k in range(simhash.WORDS)], {}
    for n in (150, 300):
        texts = []
        for i in range(n):
            w = base.copy()
            for p in rng.sample(range(5, 295, 6), 6):
                w[p] = f"own{i}x{p}"
            texts.append(" ".join(w))
        sets = [simhash.shingle_set(t.encode(), 5) for t in texts]
        held = np.stack([np.isin(np.unique(np.concatenate(sets)), x) for x in sets]).astype(np.float32)
        common = held @ held.T
        share = (common / (held.sum(axis=1)[:, None] + held.sum(axis=1)[None] - common))[np.triu_indices(n, 1)]
        assert 0.6 < share.min() < share.max() < 0.8
        rows = [(1, simhash._number(x), simhash._number(x), len(x), x.tobytes(), *[simhash._signed(v) for v in simhash._bits(iter((x,)), simhash.WORDS)]) for x in sets]
        frame = spark.createDataFrame(rows, "key bigint, fp bigint, label bigint, n bigint, held binary, " + ", ".join(f"{c} bigint" for c in names))
        bits = simhash.allowed_bits(0.8, simhash.WORDS)
        made[n] = simhash._cells(frame.drop("held"), simhash.BLOCK).count()
        assert 0.9 * n <= simhash._near_others(frame.drop("held"), names, bits, simhash.BLOCK, 0.8).count() <= n
        assert simhash._across(frame, names, bits, 64, 0.8).count() == 0
        some = simhash._across(frame, names, bits, 64, 0.6)
        assert n - 1 <= some.count() <= 25 * n and simhash.components(some).count() == n - 1
    assert made[300] <= 2 * made[150] + 2
    docs = docs_of(spark, texts + texts[:3])
    assert simhash.near_dedup(docs).count() == 300
