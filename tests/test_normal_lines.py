"""Lines and texts are normalised by fewer searches, with the same results."""

import random

from pyspark.sql import functions as F

from invoicelines.functions import normalize_line, normalize_text, strip
from invoicelines.patterns import u


def test_lines_are_normalised_by_one_pattern(spark):
    deal = random.Random(7)
    odd = [" ", "  ", "\t", "\n", "\x0b", "\x1c", "\x85", "\u00a0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", "\ufeff"]
    texts = [None, "", *["".join(deal.choice(odd + ["Α", "b", "1", "€"] * 3) for _ in range(deal.randrange(12))) for _ in range(3000)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    twice = F.regexp_replace(strip(F.col("t")), u(r"\s+"), "  ")
    assert df.where(~normalize_line(F.col("t")).eqNullSafe(twice)).count() == 0
    plain = F.replace(F.regexp_replace("t", r"[ \t]{2,}|\t", " "), F.lit("\u00a0"), F.lit(" "))
    assert df.where(~normalize_text(F.col("t")).eqNullSafe(plain)).count() == 0
    plan = df.select(normalize_line(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split(" AS ")[0].count("regexp_replace(") == 1
