"""Pairs of characters and noise are found by fewer matches, and they are the same ones."""

import random
import re

from pyspark.sql import functions as F

from invoicelines.functions import PAIRS, REPAIRS, collapse_doubled
from invoicelines.patterns import NOISE, of_upper, u
from invoicelines.plans.rendering import doubled


def test_pairs_are_collapsed_as_one_by_one(spark):
    deal = random.Random(3)
    texts = ["".join(deal.choice("ab\n€😀Α ") * deal.randrange(1, 6) for _ in range(deal.randrange(30))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    once = F.regexp_replace("t", r"(?s)(.)\1", "$1")
    for old, new in REPAIRS:
        once = F.replace(once, F.lit(old), F.lit(new))
    assert df.where(collapse_doubled(F.col("t")) != once).count() == 0
    assert df.where(doubled(F.col("t")) != F.regexp_replace("t", "(?s)(.)", "$1$1")).count() == 0
    assert len(re.findall(PAIRS, "aabbccdd" * 20)) == 10


def test_noise_begins_with_a_first_letter(spark):
    words = [w for p in NOISE["modern"] for w in (re.sub(r"\\s\+", " ", p).replace("\\", ""),)]
    rows = words + [f"x{w}1" for w in words] + [w.replace("Ω", "\u2126") for w in words] + [w[1:] for w in words] + [w.lower() for w in words] + ["ΩΑ", "\u2126Α", "Α"]
    df = spark.createDataFrame([(w,) for w in rows], "t string")
    for patterns in (NOISE["modern"], ("ΩΑ", "Β")):
        assert "(?=[" in of_upper(patterns)
        assert df.where(F.col("t").rlike(of_upper(patterns)) != F.col("t").rlike(u("|".join(patterns).replace("Ω", "[Ω\u2126]")))).count() == 0
        assert df.where(F.col("t").rlike(of_upper(patterns))).count() > 1
