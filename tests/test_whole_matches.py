"""Values that are whole matches are taken as such, and anchors that decide nothing are not searched; both find what they found before."""

import re

from pyspark.sql import functions as F

from invoicelines.functions import found, is_one_group
from invoicelines.operators.layout import has_anchors, layout_score
from invoicelines.patterns import ADDRESS, ANCHORS, EURO, KWH, NAME, STARRED, SUPPLY, u

from .test_search_forms import texts


def test_one_group_is_the_whole_match(spark):
    df = spark.createDataFrame([(t,) for t in texts(["ΔΗΜΟΣ", "ΑΓ.", "ΝΕΑ", "ΑΘΗΝΑ", "5", "1000000001", "-01", "720", "52", " ", " ", "\n", "x", "*1,5", "€", "kWh"])], "t string")
    before = {NAME[0]: r"(ΔΗΜΟΣ\s+[A-ZΆ-ώ\s]+?)(?:\s|$)", NAME[1]: r"([A-ZΆ-ώ]+\s+[A-ZΆ-ώ\s]+?)(?:\s|$)", ADDRESS[2]: r"(ΑΓ\.\s*[A-ZΆ-ώ\s]+?)(?:\s|$)", KWH: KWH, EURO: EURO, STARRED: STARRED} | {p: p for p in SUPPLY}
    for new, old in before.items():
        assert is_one_group(new)
        got = df.select(found(F.col("t"), new).alias("a"), F.nullif(F.regexp_extract("t", u(old), 1), F.lit("")).alias("b"))
        assert got.where("NOT (a <=> b)").count() == 0 and (got.where("a IS NOT NULL").count() > 20 or new in SUPPLY[1:])
        assert re.search(r"regexp_extract\([^()]*, \(\?dU\)" + re.escape(new[1:-1]) + ", 0\\)", df.select(found(F.col("t"), new))._jdf.queryExecution().optimizedPlan().toString())
    assert not any(map(is_one_group, ["(a)(b)", "(a)b(c)", "((a)b)", "(a\\)", "(?:a)", "(a)?", "(a\\1)", "a(b)"]))


def test_anchors_decide_as_their_number_does(spark):
    words = [a.replace(r"\s+", " ").replace("[άα]", "ά") for a in ANCHORS]
    rows = ["\n".join(w.upper() if n % 2 else w for k, w in enumerate(words) if n >> k & 1) for n in range(8)] + [None]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    for hits in range(5):
        assert df.where(F.coalesce(has_anchors(F.col("t"), ANCHORS, hits), F.lit(False)) != F.coalesce(layout_score(F.col("t")) >= hits, F.lit(False))).count() == 0
