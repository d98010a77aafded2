import datetime as dt

import pytest
from pyspark.sql import functions as F

from invoicelines import functions as fn


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("text, value", [("*123,45 €", 123.45), ("456,78 €", 456.78), ("1.234,5", 1234.5), ("abc", None), ("", None), (None, None)])
def test_money(spark, text, value):
    found = one(spark, text, fn.parse_eu_money)
    assert (None if found is None else float(found)) == value


@pytest.mark.parametrize("text, value", [("31/12/2023", "31/12/2023"), ("31-12-2023", "31/12/2023"), ("32/01/2024", None), ("2024-01-01", None), (None, None)])
def test_date(spark, text, value):
    assert one(spark, text, fn.parse_date_multi) == value


@pytest.mark.parametrize("text, value", [("32/01/2024", "32/01/2024"), ("2024-01-01", "01/01/2024"), ("29/02/2024", "29/02/2024"), ("05/01/2024", "05/01/2024"), ("invalid", "invalid"), (None, None)])
def test_reformat_date(spark, text, value):
    assert one(spark, text, fn.reformat_date) == value


@pytest.mark.parametrize("text, plain, same_line", [("1 234 kWh", 1234.0, 1234.0), ("1.234 KWH", 1234.0, 1234.0), ("18/01/2019\n3706 kWh", None, 3706.0), ("none", None, None)])
def test_kwh(spark, text, plain, same_line):
    assert one(spark, text, fn.parse_kwh) == plain
    assert one(spark, text, lambda c: fn.parse_kwh(c, same_line=True)) == same_line


def test_period_and_span(spark):
    assert one(spark, "01.01.2024-31.01.2024", lambda c: fn.parse_dotted_period(c)[1]) == dt.date(2024, 1, 31)
    assert one(spark, "01.01.2024-31.02.2024", lambda c: fn.parse_dotted_period(c)[0]) is None
    assert one(spark, "19/09/2018 – 18-01-2019", lambda c: fn.parse_date_span(c)[1]) == dt.date(2019, 1, 18)


@pytest.mark.parametrize("text, flag", [("True", True), ("1", True), ("ναι", True), ("ΝΑΙ", True), ("1.0", False), ("on", False), ("όχι", False), (None, False)])
def test_truthy(spark, text, flag):
    assert one(spark, text, fn.is_truthy) is flag


def test_collapse_doubled(spark):
    def loop(s):
        out, i = "", 0
        while i < len(s):
            out, i = out + s[i], i + (2 if s[i : i + 2] == s[i] * 2 else 1)
        return out

    for s in ("aabb", "aaa", "1100", "x\n\n\ny", "ΔΔεε  ll", "", "😀😀a"):
        assert one(spark, s, fn.collapse_doubled) == loop(s)
    assert one(spark, "plain 1100", lambda c: fn.collapse_doubled(c, "auto")) == "plain 1100"
    assert one(spark, "ppaaiirr", lambda c: fn.collapse_doubled(c, "auto")) == "pair"


def test_normalize(spark):
    assert one(spark, "  a \t b c ", fn.normalize_line) == "a  b  c"
    assert one(spark, "a \t b c\nd", fn.normalize_text) == "a b c\nd"


def test_scores(spark):
    row = spark.createDataFrame([("1", None, "")], "a string, b string, c string")
    score = fn.confidence(F.col("a"), F.col("b"), F.col("c"))
    found = row.select(score.alias("s"), fn.review_reason(score, a=F.col("a"), b=F.col("b"), c=F.col("c")).alias("r"), fn.dedup_key(F.col("a"), F.col("b"), F.col("c")).alias("k")).first()
    assert (round(found.s, 2), found.r, found.k) == (0.33, "Missing: b, c (confidence: 0.33)", "1_None_None")
