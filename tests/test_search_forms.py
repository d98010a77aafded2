"""Faster forms of searches find what the plain ones find; what is not asked for is not searched; tasks don't grow with the tables."""

import random

from pyspark.sql import functions as F

from invoicelines.functions import first_match, fold, folded, found, normalize_text
from invoicelines.operators import records
from invoicelines.operators.text import noise
from invoicelines.patterns import ACCOUNT, EURO, FINAL, KWH, MULTIPLIER, NOISE, u
from invoicelines.plans import rendering
from invoicelines.plans.pipeline import extract, parse

from .conftest import SMALL


def texts(alphabet, n=4000, size=24):
    deal = random.Random(7)
    return ["".join(deal.choice(alphabet) for _ in range(deal.randrange(size))) for _ in range(n)]


def test_numbers_are_found_as_before(spark):
    before = {KWH: (r"(\d[\d\.\s]*)\s*kWh", "i", 1), EURO: (r"([\d\.\,]+)\s*€\s*$", "m", 1), MULTIPLIER: (r"(\d+)\s+(1|40|80)\s+[\d,]+", "", 2)}
    df = spark.createDataFrame([(t,) for t in texts(["1", "40", "80", "9", ".", ",", " ", "\n", "€", "kWh", "KWH", "x"])], "t string")
    for new, (old, flags, group) in before.items():
        strip = lambda c: F.regexp_replace(c, u(r"\s+$"), "")
        got = df.select(strip(found(F.col("t"), new, flags, group)).alias("a"), strip(found(F.col("t"), old, flags, group)).alias("b"))
        assert got.where("NOT (a <=> b)").count() == 0 and got.where("a IS NOT NULL").count() > 20


def test_folded_words_are_found_as_without_case(spark):
    odd = ["µ", "ͅ", "ι", "ϐ", "ϑ", "ϕ", "ϖ", "ϰ", "ϱ", "ϵ", "İ", "Ω", "K", "ß", "ΐ"]
    base = ["α/α λογαριασμού 12", "Α/Α ΛΟΓΑΡΙΑΣΜΟΎ 3", "εκκαθαριστικός", "ΕΚΚΑΘΑΡΙΣΤΙΚΟΣ", "Εκκαθαριστικοσ", "εκκαθαριστικος ", "ΕΚΚΑΘΑΡΙΣΤΙΚΟΣx", "x"]
    swaps = {"ϑ": "θ", "ϱ": "ρ", "ϰ": "κ", "ϵ": "ε", "ι": "ι"}
    rows = base + [o + b for o in odd for b in base] + [b.replace(v, k) for k, v in swaps.items() for b in base]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    t, f = F.col("t"), fold(F.col("t"))
    assert df.where(f.contains(folded(FINAL)) != t.rlike(u(FINAL, "i"))).count() == 0 and df.where(f.contains(folded(FINAL))).count() > 60
    assert df.where(~first_match(f, [folded(ACCOUNT)]).eqNullSafe(first_match(t, [ACCOUNT], "i"))).count() == 0
    assert df.where(F.length(f) != F.length(t)).count() == 0


def test_noise_and_blanks_are_as_before(spark):
    words = ["ΑΦΜ", "αφμ", "ΚΩΔ.ΕΤΑΙΡΟΥ", "κωδ.εταίρου", "ΚΩΔ.ΕΤΑΙΡΟΥ", "ΦΠΑ", "Σύνολο", "ΣΥΝΟΛΟ ΠΛΗΡΩΤΕΟ", "x"]
    df = spark.createDataFrame([(w,) for w in words] + [(t,) for t in texts([" ", "\t", " ", "a", "\n"])], "t string")
    for name in NOISE:
        assert df.where(noise(F.col("t"), NOISE[name]) != F.upper("t").rlike(u("|".join(NOISE[name]), "i"))).count() == 0
    assert df.where(noise(F.lit("İLiCENSE"), ("LICENSE",)) != F.upper(F.lit("İLiCENSE")).rlike(u("LICENSE", "i"))).count() == 0
    assert df.where(normalize_text(F.col("t")) != F.translate(F.regexp_replace("t", r"[ \t]+", " "), " ", " ")).count() == 0


def test_fields_that_nobody_reads_are_not_searched(spark):
    docs = rendering.render_modern(spark, SMALL).union(rendering.render_v2018(spark, SMALL))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert folded("Συμβολαίου") in plan(parse(docs))
    counts = plan(records.count_by(extract(docs)[0]))
    assert folded("Συμβολαίου") not in counts and "40|80" not in counts and "ΗΜΕΡΑΣ".lower() not in counts


def test_tasks_do_not_grow_with_the_orders(spark, monkeypatch):
    rows = rendering.orders(spark, SMALL).count()
    monkeypatch.setattr(rendering, "ORDERS", 100)
    docs = rendering.render_modern(spark, SMALL)
    assert docs.rdd.getNumPartitions() == -(-rows // 100)  # and they are dealt once
