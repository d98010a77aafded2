"""Operators 1, 3, 4, 5, 6, 8: models and encodings against brute force or held-out rows, and odd inputs."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from invoicelines.llm import dom, langid, pitman_yor, tokenfile, toxicity, trie_counts

CLASH = "score string, word string, learn string, row string, n string, spans string, lang_pred string"


def frame(spark, rows, schema):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f", "g") for r in rows], f"{schema}, {CLASH}")


ODD = [None, "", "  \n", "!!! 123", "x " * 40_000, "One one ÉCOLE"]


# Operator 1


@pytest.mark.parametrize("c,base,near", [(60, 0.3, 0.25), (1500, 0.3, 1.5), (1500, 0.002, 0.1)])
def test_seating_has_the_sequential_mean(c, base, near):
    rng = np.random.default_rng(1)
    others, d = 2.0, 0.6
    mean = pitman_yor.seat(np.full(4000, c), np.full(4000, others), np.full(4000, base), np.full(4000, d), pitman_yor.Draws(1, np.arange(4000))).mean()
    total = 0
    for _ in range(4000):
        t = 1
        for n in range(1, c):
            open_, sit = (others + d * t) * base, n - d * t
            t += rng.random() < open_ / (open_ + sit)
        total += t
    assert abs(mean - total / 4000) < near
    assert pitman_yor.seat(np.array([0, 1]), np.ones(2), np.ones(2), np.full(2, 0.5), pitman_yor.Draws(np.arange(2))).tolist() == [0, 1]


def test_grams():
    key, owner = pitman_yor.grams([b"ab", b""], order=2)
    text = {0: b" ab", 1: b" "}
    expected = []
    for w, t in text.items():
        for i in range(len(t)):
            context = t[max(0, i - 1) : i + 1]
            value = int.from_bytes(context, "big") | 1 << (8 * len(context))
            expected.append((value * 512 + (t[i + 1] if i + 1 < len(t) else 256), w))
    assert list(zip(key.tolist(), owner.tolist(), strict=True)) == expected


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    syllables = ["ka", "lo", "mi", "ter", "on", "ba"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(300)]
    return [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(300)], k=rng.randint(20, 120))) for _ in range(90)]


def test_language_model(spark, corpus):
    texts = corpus + ODD
    docs = frame(spark, [(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pitman_yor.language_model_scores(docs, n_symbols=20).collect()}
    learn = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i in got}
    tokens = {i: pitman_yor.tokens(None if t is None else t.encode()) + [b" end"] for i, t in enumerate(texts)}
    c = Counter(w for i, ws in tokens.items() if learn[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learn[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 * len(ws)
        assert np.isfinite(r.score) and r.score < 0
    held = [got[i] for i in range(len(corpus)) if not learn[i]]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert pitman_yor.language_model_scores(docs.limit(0)).count() == 0


def test_probabilities_sum_to_one(spark, corpus):
    docs = spark.createDataFrame([(True, t) for t in corpus[:40]] + [(False, "unseen kalokalo zzz")], "learn boolean, text string")
    sizes, contexts, words = pitman_yor.train(docs, 1, 1, 20)
    assert contexts.roots.shape == (pitman_yor.CONTEXT_SAMPLES, 22) and np.allclose(contexts.roots.sum(axis=1), 1.0)
    for r in contexts.rows.collect():
        unseen = np.setdiff1d(np.arange(22), r.s)
        assert abs(sum(r.p) + (np.array(r.ways) @ contexts.roots[:, unseen]).sum() / len(r.ways) - 1) < 1e-9
    rare = [(r.n, r.p) for r in words.where("p IS NOT NULL").collect()]
    assert abs(sum(p for n, p in rare if n > 0) + sizes.unknown - 1.0) < 1e-6 and all(p > 0 for _, p in rare)


def test_every_word_is_a_context(spark, corpus):
    """The counts of all pairs of context and dish, against a loop over the texts."""
    symbols = {b"ka": 2, b"lo": 3}
    docs = spark.createDataFrame([(True, t) for t in [*corpus, "", None, "zzz"]], "learn boolean, text string").repartition(5)
    got = {(r.r, r.s): r.n for r in pitman_yor.pair_counts(docs, symbols, 4).collect()}
    want = Counter()
    for t in [*corpus, "", "", "zzz"]:
        ws = t.encode().split() + [b""]
        for last, w in zip([b"", *ws], ws, strict=False):
            want[int(pitman_yor.context_ids([last])[0]), 0 if w == b"" else symbols.get(w, 1)] += 1
    assert got == want


def test_scores_are_the_models_whatever_is_held(spark, corpus):
    """Scores by hand from the model's tables; held words, held pairs and partitions change nothing."""
    texts = [*corpus[:30], "ka zzz ka ka lo zzz", "", None, "unseen unseen ka"]
    rows = [(i, i % 5 != 0, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, learn boolean, text string")
    sizes, contexts, words = model = pitman_yor.train(docs.repartition(3), 1, 2, 20)
    table = {r.r: r for r in contexts.rows.collect()}
    known = {r.word.encode(): r for r in words.collect()}

    def log(last, w):
        s = 0 if w == b"" else sizes.symbols.get(w, 1)
        r = table.get(int(pitman_yor.context_ids([last])[0]))
        if r is None:
            p = contexts.roots[:, s].mean()
        else:
            p = dict(zip(r.s, r.p, strict=True)).get(s) or (np.array(r.ways) * contexts.roots[:, s]).mean()
        return np.log10(p) + (np.log10(known[w].p if known[w].n else sizes.unknown) if s == 1 else 0)

    want = {}
    for i, _, t in rows:
        ws = (t or "").encode().split() + [b""]
        want[i] = sum(log(last, w) for last, w in zip([b"", *ws], ws, strict=False))
    for held_words, most_pairs, parts in ((10**5, 10**6, 2), (25, 60, 3), (0, 0, 16)):
        got = {r.doc_id: r.score for r in pitman_yor.score(docs.repartition(parts), model, held_words, most_pairs).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    again = pitman_yor.train(docs.repartition(16), 1, 2, 20)
    assert np.allclose(again[1].trace, contexts.trace) and np.allclose(again[1].roots, contexts.roots) and abs(again[0].unknown - sizes.unknown) < 1e-12
    assert {r.word: r.p for r in again[2].collect()} == pytest.approx({w.decode(): r.p for w, r in known.items()})
    assert contexts.trace[-1] > contexts.trace[0] - 0.05


def test_both_spellers_agree(spark):
    words = spark.createDataFrame([("kalo", 3, 1, 0.0), ("kamika", 1, 1, 0.0), ("lo", 9, 2, 0.0), ("zäz", 0, 0, 0.0), ("kalokalo", 0, 0, 0.0)], "word string, n bigint, t bigint, p_sum double")
    own = pitman_yor.spelled_counts(words).withColumn("level", pitman_yor._level(F.col("r")))
    state, _ = pitman_yor.sweep(own, pitman_yor.sweep(own, None, 0)[0], 1)
    held, joined = ({r.word: r.spell for r in pitman_yor.respelled(words, state, 4, 1, h).collect()} for h in (10**7, 0))
    assert held.keys() == joined.keys() and all(abs(held[w] / joined[w] - 1) < 1e-9 for w in held)
    # By hand, from the state's rows.
    rows = {(r.r, r.s): r for r in state.collect()}

    def p(context, byte):
        value = int.from_bytes(context, "big") | 1 << (8 * len(context))
        if (value, byte) in rows:
            return rows[value, byte].p
        above = p(context[1:], byte) if context else 1 / 257
        way = next((r.open / r["all"] for (v, _), r in rows.items() if v == value), 1.0)
        return way * above

    for w in held:
        text, by_hand = b" " + w.encode(), 1.0
        for i in range(len(text)):
            by_hand *= p(text[max(0, i + 1 - pitman_yor.ORDER) : i + 1], text[i + 1] if i + 1 < len(text) else 256)
        assert abs(held[w] / by_hand - 1) < 1e-9


# Operator 3


def test_language_id(spark):
    rng = random.Random(3)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["str", "önt", "ach"], "cc": ["ière", "eau", "oux"]}
    rows = []
    for i in range(240):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(rng.randint(5, 60))), lang))
    rows += [(1000 + i, t, "aa" if i % 2 else None) for i, t in enumerate(ODD)] + [(None, rows[0][1], "aa")]
    docs = frame(spark, rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs, sample=40)
    assert model.languages == ["aa", "bb", "cc"] and (model.weights == 0).mean() > 0.5
    got = {r.doc_id: r for r in langid.identify(docs, model, keep=["doc_id"]).select("doc_id", F.col("lang_pred"), F.col("score")).collect()}
    held = [r for r in rows if r[0] is not None and r[0] < 1000 and zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.95 and all(0 <= g.score <= 1 for g in got.values())
    assert [got[1000 + i].lang_pred for i in range(4)] == ["und"] * 4 and got[1004].lang_pred != "und"
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(["½ ② ²", "Ⅷ", "١٢", "語"])], "doc_id bigint, text string")
    assert [r.lang_pred == "und" for r in langid.identify(odd, model).orderBy("doc_id").collect()] == [True, True, True, False]
    every = langid.identify(docs, model)
    assert sorted(every.columns) == sorted(docs.columns) and every.where("doc_id = 1003").first().lang_pred == "und"
    nothing = langid.train(docs.limit(0))
    assert nothing.languages == [] and [r.lang_pred for r in langid.identify(docs.limit(1), nothing, keep=["doc_id"]).collect()] == ["und"]


# Operator 4


@pytest.mark.parametrize("n", [0, 1, 2, 59, 60, 61, 239, 240, 241, 5000])
@pytest.mark.parametrize("high", [1, 2, 50_000, 2**60, 2**63])
def test_simple8b_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64)
    if n > 1000:
        ids[300:900] = 0
    assert (tokenfile.unpack(tokenfile.pack(ids)) == ids).all()


def test_token_file(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*ODD, " a  b\n c ", "it's  é \t q", "a\x1c b", " \n x", "\0  y", "tail ", "a　 b", "<|endoftext|> x<|endoftext|>y", "汉字" * 300 + " 汉字，语言", "汉" * 5000, "y" * 1_000_000, "ab " * 3000 + " odd  end", "no id"]
    docs = frame(spark, [(None if t == "no id" else 100 - i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    path = f"{tmp_path}/tokens"
    got = {r.doc_id: r for r in tokenfile.token_output(docs, path, block_ids=50).collect()}
    ids = {r.doc_id: r for r in tokenfile.read_token_file(spark, path).collect()}
    start = 0
    for key, t in sorted(((None if t == "no id" else 100 - i, t) for i, t in enumerate(texts)), key=lambda x: (x[0] is not None, x[0])):
        expected = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (start, len(expected), zlib.crc32(np.array(expected, "<u4").tobytes())), t
        assert ids[key].ids == expected
        start += len(expected)
    few = {r.doc_id: r.ids_crc32 for r in tokenfile.token_output(docs, f"{tmp_path}/few", known_bytes=1).collect()}
    assert few == {k: r.ids_crc32 for k, r in got.items()}
    assert tokenfile.token_output(docs.limit(0), f"{tmp_path}/none").count() == 0
    assert tokenfile.token_output(docs.union(docs), f"{tmp_path}/twice").count() == 2 * len(texts)


# Operator 5


def test_forward_backward():
    rng = np.random.default_rng(5)
    n, starts, moves = 17, [0, 5, 6, 11], (0.3, -0.7, 1.1)
    e, first = rng.normal(size=n) * 2, np.isin(np.arange(n), starts)
    one, pairs = toxicity.marginals(e, first, moves, True)
    step, total = np.array([[0, moves[0]], [moves[1], moves[2]]]), np.zeros((2, 2))
    for a, b in itertools.pairwise([*starts, n]):
        z, m, p = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(step[0, y[0]] + sum(e[a + i] * y[i] for i in range(b - a)) + sum(step[y[i - 1], y[i]] for i in range(1, b - a)))
            z, m = z + w, m + w * np.array(y)
            for i in range(1, b - a):
                p[y[i - 1], y[i]] += w
        assert np.allclose(m / z, one[a:b])
        total += p / z
    assert np.allclose(total, pairs)


def test_toxicity(spark):
    rng = random.Random(6)
    common, bad = [f"wort{i}" for i in range(60)], ["grumk" + x for x in ("a", "olo", "ist", "e", "uu")]
    rows, labels = [], []
    for i in range(300):
        words, toxic = rng.choices(common, k=rng.randint(10, 60)), i % 4 == 0
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "grumka x grumke")]
    docs = frame(spark, rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (0, 0), (1000, 0)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, marks)
    found = toxicity.score(docs, model, keep=["doc_id", "text"])
    got = {r.doc_id: r for r in found.collect()}
    held = [(got[i].predicted, t) for i, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([p == t for p, t in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values()) and not any(got[1000 + i].predicted for i in range(4))
    r = next(got[i] for i, t in labels if t and got[i].predicted)
    assert r.spans and all("grumk" in r.text[s.start : s.end] for s in r.spans)
    assert toxicity.drop_toxic(docs, marks).columns == docs.columns
    constant = toxicity.train(docs, marks.limit(0))
    assert {r.score for r in toxicity.score(docs, constant, keep=["doc_id"]).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model, keep=["doc_id"]).count() == 0
    every = toxicity.score(docs, model)
    assert sorted(every.columns) == sorted({*docs.columns, "predicted"}) and every.where("doc_id = 5").first().score == got[5].score
    assert toxicity.features("a" * 50 + "b")[0] != toxicity.features("a" * 50 + "c")[0]


# Operator 6


PAGE = (
    '<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href="/">Home</a></nav><div class="cookie-notice"><p>We use cookies.</p></div>'
    "<article><h1>Head &amp; line</h1><p>First  <b>bold</b> para.<br>more<p>Second &eacute;&#233; one.<div class=ad>Buy</div><ul><li>item <a href=x>link</a></li></ul></article>"
    '<aside>Side</aside><form><input><button>Go</button></form><section id="comments"><p>Reader says.</p></section><footer>&copy; me</footer><script>var t="</p>";</script></body></html>'
)


def test_html_text(spark):
    rows = [(i, PAGE.replace("Second", f"Second {i}")) for i in range(12)] + [(100, None), (101, ""), (102, "just text &lt;"), (103, "<p>" + "long " * 50_000), (104, "<<<>>& <b"), (None, PAGE)]
    pages = frame(spark, rows, "page_id bigint, html string")
    model = dom.train(pages)
    got = {r.page_id: r for r in dom.extract(pages, model, keep=["page_id"]).collect()}
    assert len(got) == len(rows)
    assert got[3].blocks == ["Head & line", "First bold para.", "more", "Second 3 éé one.", "item link"] or got[3].text == "Head & line First bold para. more Second 3 éé one. item link"
    assert got[None].text == got[3].text.replace("Second 3", "Second") and got[100].text == got[101].text == ""
    assert got[102].text == "just text <" and len(got[103].text) == 50_000 * 5 - 1
    assert dom.extract(pages.limit(0), model, keep=["page_id"]).count() == 0 and dom.train(pages.limit(0)) is not None


def test_sum_product_is_exact():
    nodes = dom.parse("<div><p>a</p><ul><li>b</li></ul></div>")
    rng = np.random.default_rng(7)
    found = [[f"f{i}"] for i in range(len(nodes))]
    model = dom.Model({f"f{i}": tuple(rng.normal(size=3).tolist()) for i in range(len(nodes))}, rng.normal(size=(3, 3)), rng.normal(size=3))
    total, one = 0.0, np.zeros(len(nodes))
    for y in itertools.product(range(3), repeat=len(nodes)):
        w = np.exp(model.root[y[0]] + sum(model.evidence[f"f{i}"][t] for i, t in enumerate(y)) + sum(model.ties[y[n.parent], y[i]] for i, n in enumerate(nodes) if i))
        total, one = total + w, one + w * (np.array(y) == 1)
    assert np.allclose(one / total, model.marginals(nodes, found))


# Operator 8


def test_trie_counts(spark):
    import public_tokenizers

    score, longest = trie_counts.pieces(public_tokenizers.path(trie_counts.VOCABULARY))

    def best(w):
        b = [(0.0, 0)]
        for e in range(1, len(w) + 1):
            b.append(min((b[s][0] - score[w[s:e]], b[s][1] + 1) for s in range(e) if w[s:e] in score))
        return b[-1]

    texts = [*ODD, "the theory of theorems", "été naïve 東京 \x00\x01"]
    docs = frame(spark, [(i, t) for i, t in enumerate(texts)] + [(None, "the")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in trie_counts.token_counts(docs, keep=["doc_id"]).collect()}
    memo = {}
    for i, t in [*enumerate(texts), (None, "the")]:
        words = [b" " + w for w in (t or "").encode().split()]
        found = [memo.setdefault(w, best(w)) for w in words]
        assert (got[i].n_pretokens, got[i].n_tokens) == (len(words), sum(f[1] for f in found))
        assert abs(got[i].unigram_score + sum(f[0] for f in found)) < 1e-6 * (1 + len(words))
    clash = trie_counts.token_counts(docs.withColumn("n_tokens", F.lit("x")))
    assert sorted(clash.columns) == sorted([*docs.columns, "n_pretokens", "n_tokens", "unigram_score"]) and clash.where("doc_id = 5").first().n_tokens == got[5].n_tokens
    assert trie_counts.token_counts(docs.limit(0), keep=["doc_id"]).count() == 0


def test_language_sample_has_different_texts(spark):
    """5000 copies of a text and texts without a letter leave the sample's places to the others."""
    rng = random.Random(12)
    rows = [(lang, " ".join(rng.choice(words) for _ in range(12))) for lang, words in (("en", ["the", "dog", "runs", "home"]), ("de", ["der", "hund", "geht", "heim"])) for _ in range(60)]
    rows += [(lang, f"{k} {k * k} !") for lang in ("en", "de") for k in range(300)]
    distinct = spark.createDataFrame(rows, "lang string, text string")
    least = distinct.where("lang = 'en' AND text LIKE '% %e%'").orderBy(F.xxhash64("text")).first().text
    copies = spark.range(5000).select(F.lit("en").alias("lang"), F.lit(least).alias("text"))
    docs = distinct.union(copies).select(F.lit(None).cast("bigint").alias("doc_id"), "lang", "text")
    picked = langid.sampled(docs.select(F.col("text").alias("body"), "lang", F.xxhash64("text").alias("order")), 40).collect()
    seen = Counter(r.lang for r in picked)
    assert (seen["en"], seen["de"]) == (40, 40) and len({r.body for r in picked}) == 80 and not any(r.body.endswith("!") for r in picked)
    assert langid.train(docs, sample=40).languages == ["de", "en"]


def test_html_names_inside_slugs(spark):
    rows = [(i, PAGE.replace("Second", f"Second {i}")) for i in range(12)]
    slugs = '<article><h2 id="search-methods">Methods</h2><p>Text one.</p><section id="form-and-function"><p>Text two.</p></section><h2 id="legal-history">History</h2><h3 id="notice">Notice</h3></article>'
    rows += [(20, f"<html><body>{slugs}</body></html>"), (21, f'<html><body><nav>Menu</nav><div class="layout has-sidebar">{slugs}<div class="sidebar">Side</div></div></body></html>'), (22, f"<html><body><form><nav>Menu</nav>{slugs}</form></body></html>")]
    pages = frame(spark, rows, "page_id bigint, html string")
    got = {r.page_id: r.text for r in dom.extract(pages, dom.train(pages.where("page_id < 20")), keep=["page_id"]).collect()}
    assert [got[i] for i in (20, 21, 22)] == ["Methods Text one. Text two. History Notice"] * 3


def test_html_wrappers_and_broken_quotes(spark):
    """An article outvotes its wrapper's name; quotes count only after an equals sign; comments stay out."""
    rows = [(i, PAGE.replace("Second", f"Second {i}")) for i in range(12)]
    article = "<article><h1>Title</h1><p>The first paragraph of it.</p><p>And one more.</p></article>"
    names = ["no-sidebar", "has-share", "header-fixed", "comments-open", "search-results", "with-ads", "post-tags", "sidebar", "header"]
    rows += [(100 + i, f'<body><nav>Menu</nav><div id="page" class="{x}">{article}<footer>Foot</footer></div></body>') for i, x in enumerate(names)]
    broken = [
        ("<article><img alt=it's x><p>First.</p><p>We don't.</p><p>Last.</p></article>", "First. We don't. Last."),
        ('<article><p>One <a title="x>link</a> two.</p></article>', "One link two."),
        ('<article><p class=a"b>In "quotes" here</p></article>', 'In "quotes" here'),
        (f'<body>{article}<section id="comments"><article class="comment"><div class="content">Reader</div></article></section></body>', "Title The first paragraph of it. And one more."),
    ]
    rows += [(200 + i, f"<html><body>{p}</body></html>") for i, (p, _) in enumerate(broken)]
    pages = frame(spark, rows, "page_id bigint, html string")
    found = dom.extract(pages.withColumn("text", F.lit("clash")), dom.train(pages.where("page_id < 50")))
    assert [c for c in found.columns if c == "text"] == ["text"]
    got = {r.page_id: r.text for r in found.collect()}
    assert {names[i]: got[100 + i] for i in range(len(names))} == dict.fromkeys(names, "Title The first paragraph of it. And one more.")
    assert [got[200 + i] for i in range(len(broken))] == [t for _, t in broken]


def test_language_sample_is_bounded(spark):
    """A bound on the sample's n-grams leaves every language its texts of the least hashes, whatever the partitions."""
    words = {"aa": "alba anda arka", "bb": "bolo bonto brok", "cc": "cici citri crin"}
    rows = [(i, f"{w} {'xyz'[i % 3]}{i}", x) for i in range(240) for x, w in [list(words.items())[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    whole, small = langid.train(docs), langid.train(docs, most=900)
    again = langid.train(docs.repartition(5), most=900)
    assert whole.languages == small.languages == again.languages == list(words) and np.array_equal(small.weights, again.weights) and not np.array_equal(small.weights, whole.weights)
    got = langid.identify(spark.createDataFrame(list(words.values()), "string").toDF("text"), small).collect()
    assert {r.text: r.lang_pred for r in got} == {w: x for x, w in words.items()}
